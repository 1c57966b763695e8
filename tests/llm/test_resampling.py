import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from telerisk.llm import resampling as R

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    return [zlib.crc32(b" ".join(w[i:i + n])) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def brute(docs, target, percent=5, least=20, seed=42):
    have = Counter(x for _, t in docs for x in features(t)[0])
    goal = Counter(x for t in target for x in features(t)[0])
    S, T = sum(have.values()), sum(goal.values())
    rows = []
    for i, text in docs:
        found, n = features(text)
        weight = sum(math.floor(1000 * math.log((goal[b] + 1) * (S + 10000) / ((have[b] + 1) * (T + 10000)))) for b in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    order = Counter()
    for rank, r in enumerate(fit[:percent * len(fit) // 100], 1):
        order[r] = order[r] or rank
    return rows, order


def random_text(rng, n):
    vocab = ["Alpha", "beta", "été", "GAMMA9", "x-y", "日本語", "z_z", "it's", "", "7"]
    return "".join(rng.choice(vocab) + rng.choice([" ", "\n", "\t", ", ", "\x00", "\x7f"]) for _ in range(n))


@pytest.mark.parametrize("percent", [5, 37])
def test_equals_brute_force(spark, percent):
    rng = random.Random(percent)
    docs = [(i, random_text(rng, rng.choice([0, 3, 18, 25, 60]))) for i in range(300)]
    docs += [(300, None), (None, random_text(rng, 40)), (301, ""), (302, "a " * 5000)]
    target = [random_text(rng, 30) for _ in range(10)] + [None]
    df = spark.createDataFrame([(i, t, 3, "p") for i, t in docs], "doc_id long, text string, rank int, weight string").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = R.resample(df, goal, percent=percent).collect()
    rows, order = brute(docs, target, percent)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_features, r.weight, r.score) for r in got) == sorted(
        (r[0] is not None, r[0] or 0, *r[1:]) for r in rows)
    assert {(r.doc_id, r.rank) for r in got if r.rank is not None} == {(r[0], rank) for r, rank in order.items()}
    picked = R.drawn(df, R.resample(df, goal, percent=percent))
    assert picked.columns == df.columns and {r.doc_id for r in picked.collect()} == {r[0] for r in order} - {None}


def test_pieces_of_a_long_text_give_the_runs_of_the_whole():
    rng = random.Random(1)
    text = random_text(rng, 3000).encode()
    whole = features(text.decode())
    for chunk in (1, 7, 100, 1 << 20):
        parts = list(R.checksums(text, chunk))
        assert sum(n for n, _ in parts) == whole[1]
        assert Counter(x % 10000 for _, found in R.checksums(text, chunk) for x in found) == Counter(whole[0])


def test_edges(spark):
    schema = "doc_id long, text string"
    none, some = spark.createDataFrame([], schema), spark.createDataFrame([(1, "a " * 30), (1, "a " * 30), (2, "b " * 30)], schema)
    assert R.resample(none, none).count() == 0 and R.resample(none, some).count() == 0
    rows = R.resample(some, none, percent=100).collect()
    assert sorted(r.rank for r in rows) == [1, 2, 3] and sorted(r.doc_id for r in rows) == [1, 1, 2]
    assert all(r.rank is None for r in R.resample(some, none, percent=33, min_words=31).collect())


def test_a_long_letter_run_is_one_word():
    assert [n for n, _ in R.checksums(b"q" * 3_000_000)] == [1] and np.sum([n for n, _ in R.checksums(b"ab " * 1_000_000)]) == 1_000_000
