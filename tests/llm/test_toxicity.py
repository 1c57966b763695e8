import itertools
import random
import zlib

import numpy as np
import pytest

from telerisk.llm import toxicity as T


@pytest.mark.parametrize("step", [1, 2, 3, 128])
def test_marginals_equal_enumeration(monkeypatch, step):
    monkeypatch.setattr(T, "STEP", step)
    rng = np.random.default_rng(step)
    rows = np.repeat([0, 1, 2, 4], [7, 1, 5, 6])
    e = rng.normal(0, 2, len(rows))
    transition, start = np.array([[0.0, -1.2], [0.3, 0.9]]), -0.7
    want = np.zeros(len(rows))
    for r in np.unique(rows):
        at = np.flatnonzero(rows == r)
        total, hit = 0.0, np.zeros(len(at))
        for path in itertools.product((0, 1), repeat=len(at)):
            s = start * path[0] + sum(e[i] * y for i, y in zip(at, path)) + sum(transition[a, b] for a, b in zip(path, path[1:]))
            total += np.exp(s)
            hit += np.exp(s) * np.array(path)
        want[at] = hit / total
    assert np.allclose(T.marginals(e, rows, transition, start), want)


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeou") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([5, 40, 300]))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(["Idiot,", "vequ" + rng.choice(words), "scum"]))
        out.append((i, " ".join(text), int(toxic)))
    return out


def test_held_out_accuracy_and_spans(spark):
    data = corpus(1200, 3)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(0, None), (None, 1), (1, data[1][2])], "doc_id long, toxic int")
    rows = T.score(docs, T.train(docs, labels)).select("row.doc_id", "score", "predicted", "spans").collect()
    truth, text = {i: y for i, _, y in data}, {i: t for i, t, _ in data}
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(rows) == len(data) and len(held) > 150
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all((r.score >= 0.5) == bool(r.predicted) for r in rows)
    assert all("idiot" in w.lower() or "vequ" in w or "scum" in w for r in held for s in r.spans for w in text[r.doc_id][s.start:s.end].split())


def test_edges(spark):
    data = corpus(300, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    model = T.train(docs, labels)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, " \n"), (3, "é" * 10), (4, "word " * 30000 + "idiot"), (5, "!!! ?")], "doc_id long, text string")
    rows = T.score(odd, model).select("row.doc_id", "score", "predicted", "spans").collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    long = next(r for r in rows if r.doc_id == 4)
    assert long.predicted == 1 and (long.spans[-1].start, long.spans[-1].end) == (150000, 150005)
    assert sum(r.predicted for r in rows) == 1
    assert T.score(odd.limit(0), model).count() == 0
    none = T.train(docs, labels.limit(0))
    assert {r.predicted for r in T.score(docs.limit(3), none).collect()} == {0}
    assert {r.predicted for r in T.score(docs.limit(3), T.train(docs, labels.where("toxic = 0"))).collect()} == {0}
