import math
import random

import numpy as np

from telerisk.llm import nearest as N

SCHEMA = "vec_id long, embedding array<float>, query int, key string"


def brute(data, k, queries=None):
    """(query, rank) -> (vec_id, distance), all pairs in plain Python over the rows that take part."""
    fine = {(i, tuple(v)) for i, v in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for q, x in fine:
        if queries is not None and q not in queries:
            continue
        near = sorted((math.dist(x, y), i) for i, y in fine if i != q and len(y) == len(x))[:k]
        out += [(q, rank, i, round(d, 9)) for rank, (d, i) in enumerate(near, 1)]
    return sorted(out)


def found(rows):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in rows)


def frame(spark, data):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in data], SCHEMA)


def floats(rng, n):
    return [float(np.float32(x)) for x in rng.standard_normal(n)]


def test_equals_brute_force_with_copies_ties_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "QUERIES", 7)
    monkeypatch.setattr(N, "STEP", 500)
    rng = np.random.default_rng(3)
    hot, near = floats(rng, 12), floats(rng, 12)
    data = [(i, hot if i % 3 == 0 else floats(rng, 12)) for i in range(240)]
    data += [(300 + i, [x + 1e-3 * y for x, y in zip(near, floats(rng, 12))]) for i in range(30)]
    data += [(400, [0.0] * 12), (401, None), (402, [None] + [1.0] * 11), (403, [float("nan")] * 12), (404, [float("inf")] + [1.0] * 11), (405, [])]
    data += [(None, hot), (5, data[5][1]), (6, floats(rng, 12)), (500, [1.0, 2.0]), (501, [1.0, 2.5]), (502, [-0.0, 1.0]), (503, [0.0, 1.0]), (504, [3.0])]
    data = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in data]
    queries = {*range(0, 600, 4), 303, 305}
    df = frame(spark, data).repartition(3)
    got = N.neighbours(df, df.where(df.vec_id.isin(sorted(queries))), k=10).collect()
    assert found(got) == brute(data, 10, queries)


def test_recall_and_exact_scores_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    got = N.neighbours(df, df.where("vec_id % 10 = 0")).collect()
    want, hits = {}, 0
    for q in range(0, 500, 10):
        order = sorted((float(np.sqrt(np.cumsum((rows[q] - x) ** 2)[-1])), i) for i, x in rows.items() if i != q)[:10]
        want |= {(q, rank): x for rank, x in enumerate(order, 1)}
    for r in got:
        hits += want[r.query_id, r.rank] == (r.score, r.vec_id)
    assert len(got) == len(want) and hits >= 0.99 * len(want)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((3000, 64)), rng.standard_normal((40, 64))
    codes = N.fit(x, 128, 8, 3.0, 1)
    cell, length, along, packed = codes.encode(x)
    exact = ((x[:, None] - q[None]) ** 2).sum(-1)
    below = sharp = 0
    for c in range(8):
        at = np.flatnonzero(cell == c)
        away = np.sqrt(((q - codes.centroids[c]) ** 2).sum(1))
        low = codes.bounds(packed[at], length[at], along[at], (q - codes.centroids[c]) @ codes.turn, away)
        below += (low <= exact[at]).sum()
        sharp += (low > np.sort(exact, axis=0)[10]).sum()
    assert below >= 0.998 * exact.size and sharp > 0.8 * exact.size


def test_small_and_empty_tables(spark):
    assert N.neighbours(frame(spark, [])).count() == 0
    assert N.neighbours(frame(spark, [(1, [1.0])])).count() == 0
    assert N.neighbours(frame(spark, [(1, [1.0]), (2, [1.0]), (2, [1.0])])).count() == 2
    rng = random.Random(2)
    data = [(i, [rng.choice([0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(60)]
    assert found(N.neighbours(frame(spark, data), k=4).collect()) == brute(data, 4)
