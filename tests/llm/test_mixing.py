import math
import random
from collections import Counter, defaultdict

import pytest

from telerisk.llm import mixing as M


@pytest.mark.parametrize("seed", range(6))
def test_period_meets_release_times_and_deadlines(seed):
    rng = random.Random(seed)
    parts = M.shares({f"s{i}": rng.random() ** 3 + 1e-6 for i in range(rng.choice([1, 2, 7, 40]))}, rng.choice([64, 1000, 1024]))
    plan = M.period(parts)
    total = len(plan)
    weight = {k: n / sum(parts.values()) for k, n in parts.items()}
    seen = Counter()
    for t, (source, block, slot) in enumerate(plan):
        assert slot == t and block == seen[source]
        assert math.floor(block / weight[source] + 1e-9) <= slot < math.ceil((block + 1) / weight[source] - 1e-9)
        seen[source] += 1
        assert all(abs(seen[k] - weight[k] * (t + 1)) < 1 + 1e-9 for k in parts)
    assert total * max(weight.values()) == pytest.approx(seen.most_common(1)[0][1])


def test_shares_are_near_the_weights():
    parts = M.shares({"a": 0.7, "b": 0.2, "c": 0.1}, 1000)
    assert sum(parts.values()) == 1000 and all(abs(parts[k] / 1000 - w) < 0.003 for k, w in (("a", 0.7), ("b", 0.2), ("c", 0.1)))


def test_mix_is_whole_and_fair(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 100)
    rng = random.Random(1)
    data = [(i, rng.choice("aaaaaabbc") if i % 50 else None, f"t{i}", 9, i) for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string, mix_slot int, block long")
    rows = M.mix(docs, {"a": 0.5, "b": 0.3, "c": 0.15, "": 0.05}, block_rows=4).orderBy("mix_slot", "mix_place").collect()
    assert all(r.block == r.doc_id for r in rows) and sorted(r.doc_id for r in rows) == list(range(3000)) and len({(r.mix_slot, r.mix_place) for r in rows}) == 3000
    by_slot = defaultdict(set)
    for r in rows:
        by_slot[r.mix_slot].add(r.source or "")
    assert sorted(by_slot) == list(range(len(by_slot))) and all(len(s) == 1 for s in by_slot.values())
    sizes = Counter(r[1] or "" for r in data)
    blocks = {k: -(-n // 4) for k, n in sizes.items()}
    first_end = min(blocks[k] / w for k, w in (("a", 0.5), ("b", 0.3), ("c", 0.15), ("", 0.05)))
    seen = Counter()
    for t in range(int(first_end) - 1):
        seen[next(iter(by_slot[t]))] += 1
        for k, w in (("a", 0.5), ("b", 0.3), ("c", 0.15), ("", 0.05)):
            assert abs(seen[k] - w * (t + 1)) < 1.01 + 0.002 * (t + 1)
    assert seen and rows[0].mix_slot == 0


def test_edges(spark):
    schema = "doc_id long, source string"
    assert M.mix(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (None, None), (2, "")], schema)
    rows = M.mix(same, block_rows=1).collect()
    assert len(rows) == 5 and sorted(r.mix_slot for r in rows) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        M.mix(spark.range(2000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS source"))


def test_long_schedules_keep_to_exact_weights(spark, monkeypatch):
    """The weights of a table where one source has a third of the rows, and one of weight 0.5 among 20."""
    for weights in ({"hot": 7.0, **{f"s{i}": math.sqrt(2 + i) for i in range(19)}}, {"hot": 0.5, **{f"s{i}": 0.5 / 19 for i in range(19)}}):
        total, seen = sum(weights.values()), Counter()
        for source, block, slot in M.schedule(dict.fromkeys(weights, 2000), weights):
            assert block == seen[source]
            seen[source] += 1
            assert all(abs(seen[k] - w / total * (slot + 1)) < 1 + 1e-6 for k, w in weights.items())
            if seen[source] == 2000:
                break
    monkeypatch.setattr(M, "BUCKET", 100)
    sizes = {"hot": 800, **{f"s{i}": 60 for i in range(19)}}
    docs = spark.createDataFrame([(i, k) for i, k in enumerate(k for k, n in sizes.items() for _ in range(n))], "doc_id long, source string")
    rows = M.mix(docs, weights, block_rows=1).orderBy("mix_slot").collect()
    assert [r.mix_slot for r in rows] == list(range(sum(sizes.values())))
    seen = Counter()
    for t, r in enumerate(rows[:1100]):
        assert r.mix_block == seen[r.source]
        seen[r.source] += 1
        assert all(abs(seen[k] - w * (t + 1)) < 1 + 1e-6 for k, w in weights.items())


def test_sources_of_no_weight_come_last():
    order = [k for k, _, _ in M.schedule({"a": 3, "b": 2, "c": 2}, {"a": 1.0, "b": 0.0, "c": 0.0})]
    assert order[:3] == ["a"] * 3 and Counter(order[3:]) == {"b": 2, "c": 2}
