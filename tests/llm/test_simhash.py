import random
import re

import numpy as np
import xxhash

from telerisk.llm import simhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_fp(text):
    words = WORD.findall((text or "").encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(fps))]


def test_documents_and_edges(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    texts += [None, "", " \n", "One", "one", "one two", "one\n TWO", "a  b\t c\nd", "a b c d", texts[3], texts[3] + " x", "é É"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS root")
    fps = [brute_fp(t) for t in texts]
    want = brute_components(list(range(len(texts))), fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, want))}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    twice = simhash.near_duplicates(docs.limit(5).union(docs.limit(5)))
    assert twice.count() == 10


def test_links_are_exact_in_shards(spark, monkeypatch):
    """Clusters and background fingerprints, with trees several levels deep."""
    monkeypatch.setattr(simhash, "SHARD", 64)
    monkeypatch.setattr(simhash, "STEP_WORK", 2048)
    monkeypatch.setattr(simhash, "TASK_WORK", 20000)
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(1500)]
    for centre in fps[:40]:
        for _ in range(rng.choice([1, 3, 20])):
            fps.append(centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5]))))
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    from telerisk.llm.graph import components
    found = {r.node: r.root for r in components(edges).collect()}
    want = brute_components(signed, fps)
    assert [found.get(x, x) for x in signed] == want
