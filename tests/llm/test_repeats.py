import hashlib
import random

import pytest

from telerisk.llm import repeats


def brute(rows, length):
    """rows in order of (id, text): removed flags of each."""
    seen, out = set(), []
    for text in rows:
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i:i + length]
            if s in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(s)
        out.append((data, gone))
    return out


def expected(rows, length):
    out = []
    for data, gone in brute(rows, length):
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(df):
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.orderBy("doc_id").collect()]


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    assert got(repeats.repeats(docs)) == expected(texts, 100)


@pytest.mark.parametrize("chunk", [1 << 20, 700])
def test_edges_and_random_overlaps(spark, monkeypatch, chunk):
    rng = random.Random(chunk)
    pool = ["".join(rng.choice("ab é") for _ in range(rng.choice([90, 130, 400]))) for _ in range(6)]
    texts = ["", "x" * 99, "x" * 100, "x" * 350, "ab" * 200, pool[2], pool[2], pool[2] + "tail", "head" + pool[2][20:]]
    for _ in range(60):
        texts.append("".join(rng.choice(pool)[rng.randrange(40):] + "".join(rng.choice("abcd") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(8))))
    docs = spark.createDataFrame([(i, t or None) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS copy")
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    assert got(repeats.repeats(docs.repartition(7))) == expected(texts, 100)


def test_shared_and_null_ids(spark):
    text = "".join(chr(97 + (i * i) % 23) for i in range(300))
    docs = spark.createDataFrame([(5, text + "b"), (5, text + "a"), (5, text + "a"), (None, text), (7, None)], "doc_id long, text string")
    want = expected([text, text + "a", text + "b", ""], 100)
    rows = repeats.repeats(docs).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)) == sorted(
        (i is not None, i or 0, *w) for i, w in zip([None, 5, 5, 7], want))
    assert repeats.repeats(docs.limit(0)).count() == 0


def test_witness_that_copies_another_partitions_document(spark):
    """A copy and a document with the same passage in other words, in one partition; their first source in another."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    firsts, others = [], []
    for i in range(40):
        passage = word(160)
        first = word(120) + passage + word(120)
        firsts.append((3 * i, first))
        others += [(3 * i + 1, first), (3 * i + 2, word(120) + passage + word(120))]
    docs = spark.createDataFrame(spark.sparkContext.parallelize([firsts, others], 2).flatMap(lambda part: part), "doc_id long, text string")
    assert docs.rdd.getNumPartitions() == 2
    assert got(repeats.repeats(docs)) == expected([t for _, t in sorted(firsts + others)], 100)
