import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from telerisk.llm import decontaminate as D
from telerisk.llm.words import PUNCTUATION, blocks


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert D.common(a, b) == table[-1, -1]


def test_frequencies_cover_all_hops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    count, total = D.frequencies(docs.repartition(5), "text")
    hops, seen = 0, {}
    for text in [r.text for r in docs.collect()]:
        block = next(blocks(pa.array([text])), None)
        h = (D.word_hashes(block)[3] % np.uint64(D.BINS)).tolist()
        for k in range(0, len(h), 16):
            hops += 1
            for b in set(h[k:k + 16]):
                seen[b] = seen.get(b, 0) + 1
    assert total == hops and {int(b): int(count[b]) for b in np.flatnonzero(count)} == seen


def exact_cosines(texts, items, count, total):
    """Largest TF-IDF cosine of any passage of each text with any passage of each item, by brute force."""
    idf = D.idf_of(count, total)

    def vectors(text, step):
        block = next(blocks(pa.array([text])))
        bins = (D.word_hashes(block)[3] % np.uint64(D.BINS)).astype(int)
        out = []
        for a in range(0, max(1, len(bins) - 16), step):
            v = {}
            for b in bins[a:a + 32]:
                v[b] = v.get(b, 0.0) + idf[b]
            out.append((v, np.sqrt(np.sum(idf[bins[a:a + 32]] ** 2))))
        return out
    queries = [vectors(t, 16) for t in items]
    return {(i, j): max(sum(x * v.get(b, 0) for b, x in q.items()) / (n * m) for v, n in vectors(t, 16) for q, m in qs)
            for i, t in enumerate(texts) for j, qs in enumerate(queries)}


def test_recall_against_brute_force(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.length("text") < 3000).limit(250)
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rows, wanted = docs.orderBy("doc_id").collect(), items.orderBy("item_id").collect()
    count, total = D.frequencies(docs, "text")
    cos = exact_cosines([r.text for r in rows], [r.text for r in wanted], count, total)
    index = D.build(docs, [(r.item_id, r.text) for r in wanted], D.idf_of(count, total), "doc_id", "text")
    # candidates alone: no confirmation
    monkeypatch.setattr(D, "ANSWER", 0.0)
    table = pa.array([r.text for r in rows])
    found = {(b.lo + i, m["item_id"]) for b in blocks(table) for i, hits in enumerate(D.search(b, index, D.COSINE, -1.0)) for m in hits}
    truth = {(i, wanted[j].item_id) for (i, j), c in cos.items() if c >= D.COSINE + 0.03 and D.common(
        index.item_words[j], D.word_hashes(next(blocks(pa.array([rows[i].text]))))[3].tolist()) >= 0.6 * len(index.item_words[j])}
    assert len(truth) >= 5 and len(truth & found) >= 0.9 * len(truth)


def test_copies_and_paraphrases_are_found_and_others_left(spark):
    rng = random.Random(7)
    lexicon = ["w" + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(3000)] + ["the", "of", "and"] * 200
    prose = lambda n: [rng.choice(lexicon) for _ in range(n)]
    items = [prose(rng.randrange(16, 60)) for _ in range(30)]
    docs, want = [], set()
    for i in range(300):
        words = prose(rng.choice([8, 60, 400]))
        if i % 5 == 0:
            j = rng.randrange(30)
            leak = list(items[j])
            if i % 2:  # every eighth word another one, in other letters
                leak = [rng.choice(lexicon) if k % 8 == 3 else w.upper() + "," for k, w in enumerate(leak)]
            at = rng.randrange(len(words))
            words[at:at] = leak
            want.add((i, j))
        docs.append((i, " ".join(words), i))
    docs = spark.createDataFrame(docs, "doc_id long, text string, item_id int").repartition(6)
    bench = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)] + [(3, " ".join(items[3])), (None, "x"), (50, None), (51, "")],
                                  "item_id long, text string")
    rows = D.matches(docs, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got <= want and len(got & want) >= 0.95 * len(want)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(0 <= r.start < r.end <= len(text[r.doc_id]) for r in rows)
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(300)) - {i for i, _ in got}


def test_edges(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (2, "a b c"), (2, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c"), (2, "!!!")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in D.matches(docs, bench).collect()) in ([(2, 1), (2, 1)], [])
    assert D.matches(docs.limit(0), bench).count() == 0 and D.matches(docs, bench.limit(0)).count() == 0
    assert D.clean(docs, bench.limit(0)).count() == 4


def test_every_passage_of_long_benchmark_texts_is_found(spark, monkeypatch):
    rng = random.Random(11)
    lexicon = ["w" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(6000)]
    prose = lambda n: [rng.choice(lexicon) for _ in range(n)]
    items = [(j, prose(500)) for j in range(40)]
    docs = spark.createDataFrame([(i, " ".join(prose(200))) for i in range(100)], "doc_id long, text string")
    index = D.build(docs, [(j, " ".join(w)) for j, w in items], D.idf_of(*D.frequencies(docs, "text")), "doc_id", "text")
    monkeypatch.setattr(D, "ANSWER", 0.0)
    table = pa.array([" ".join(w[a:a + 32]) for _, w in items for a in range(0, 484, 16)])
    owner = [j for j, _ in items for a in range(0, 484, 16)]
    found = [{m["item_id"] for m in hits} for b in blocks(table) for hits in D.search(b, index, 0.9, -1.0)]
    assert len(found) == len(owner) and all(j in f for j, f in zip(owner, found))
    sizes = spark.createDataFrame([(j, " ".join(w)) for j, w in items], "item_id long, text string")
    assert len(list(D.item_blocks(sizes, "item_id", "text"))) > 1


def test_a_passage_out_of_a_long_benchmark_text_is_a_leak(spark):
    rng = random.Random(13)
    lexicon = ["w" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(6000)]
    prose = lambda n: [rng.choice(lexicon) for _ in range(n)]
    items = [prose(rng.choice([60, 300])) for _ in range(20)]
    docs, want = [], set()
    for i in range(80):
        words = prose(150)
        if i % 4 == 0:
            j = rng.randrange(20)
            a = 16 * rng.randrange((len(items[j]) - 32) // 16)
            at = 16 * rng.randrange(8)
            words[at:at] = items[j][a:a + 32]
            want.add((i, j))
        docs.append((i, " ".join(words)))
    rows = D.matches(spark.createDataFrame(docs, "doc_id long, text string"),
                     spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want


def test_short_texts_among_rarer_words(spark):
    rng = random.Random(11)
    common = [f"c{k}" for k in range(400)]
    rare = iter(f"r{k}" for k in range(10**6))
    items = [[rng.choice(common) for _ in range(size)] for size in (8, 15, 15, 15, 30, 30, 30, 60, 60, 60)]
    docs, want = [], {"rare": set(), "known": set(), "changed": set()}
    for i in range(400):  # the common words of the corpus
        docs.append((i, " ".join(rng.choice(common) for _ in range(120))))
    for i in range(60):
        j, kind = i % 10, ("rare", "known", "changed")[i // 20]
        around = [next(rare) for _ in range(200)] if kind != "known" else [rng.choice(common[350:]) for _ in range(200)]
        leak = [next(rare) if kind == "changed" and k % 5 == 2 else w for k, w in enumerate(items[j])]
        at = rng.randrange(200)
        docs.append((1000 + i, " ".join([*around[:at], *leak, *around[at:]])))
        want[kind].add((1000 + i, j))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in D.matches(table, bench).collect()}
    for kind, pairs in want.items():
        assert len(pairs & found) >= 0.9 * len(pairs), (kind, sorted(pairs - found))


def test_bound_loses_no_pair(monkeypatch, spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    index = D.build(docs, items, D.idf_of(*D.frequencies(docs, "text")), "doc_id", "text")
    table = pa.array([r.text for r in docs.collect()])
    monkeypatch.setattr(D, "ANSWER", 0.0)
    search = lambda: [D.search(b, index, D.COSINE, -1.0) for b in blocks(table)]
    bounded = search()
    index.__dict__["outside"] = np.full(len(index.query), 1e6, np.float32)  # every pair is taken exactly
    assert bounded == search()


def test_clashing_columns_long_texts_and_empty_tables(spark):
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    rows = [(1, "filler " * 50_000 + leak + " filler" * 50_000), (2, leak), (2, leak), (None, leak), (3, None), (4, ""), (5, "clean words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS matches", "'x' AS row", "2 AS item_id", "0.5 AS cosine")
    bench = spark.createDataFrame([(7, leak)], "item_id long, text string").selectExpr("*", "'y' AS id", "3 AS doc_id")
    found = sorted((r.doc_id or 0, r.item_id) for r in D.matches(docs, bench).collect())
    assert found == [(0, 7), (1, 7), (2, 7), (2, 7)]
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert D.matches(docs, bench.limit(0)).count() == 0 and D.matches(docs.limit(0), bench).count() == 0
    assert D.clean(docs, bench.limit(0)).count() == len(rows) and D.clean(docs.limit(0), bench).count() == 0


def test_latent_space_is_fitted_to_all_documents(spark, monkeypatch):
    """the sums behind the latent space are those of every passage, of more documents and longer ones than a sample held."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([0, 3, 16, 17, 40, 90]))) for _ in range(1200)]
    texts += [" ".join(f"w{rng.randrange(60)}" for _ in range(20000)), None]  # over 64 KB
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    idf = D.idf_of(*D.frequencies(docs, "text"))
    hashes = {w: int(D.word_hashes(next(blocks(pa.array([w]))))[3][0] % np.uint64(D.BINS)) for w in {w for t in texts if t for w in t.split()}}
    known = sorted(hashes.values())[::2]
    column = np.full(D.BINS, -1, np.int64)
    column[known] = np.arange(len(known))
    want, passages = np.zeros((len(known), len(known))), 0
    for text in texts:
        bins = [hashes[w] for w in (text or "").split()]
        for a in range(0, max(1, len(bins) - 16), 16):
            part = bins[a:a + 32]
            if part:
                v = np.zeros(len(known))
                for b in part:
                    if column[b] >= 0:
                        v[column[b]] += idf[b]
                want += np.outer(v, v) / np.sum(idf[part].astype(float) ** 2)
                passages += 1
    for cells in (D._CELLS, 1):  # in one pass, and in passes of 16 columns
        monkeypatch.setattr(D, "_CELLS", cells)
        got, count = np.zeros_like(want), 0
        for r in D.moments(docs, "text", column, idf).collect():
            sums = np.frombuffer(r.sums, np.float32)
            if r.part < 0:
                count = int(sums[0])
            else:
                rows = sums.reshape(-1, len(known))
                got[r.part:r.part + len(rows)] += rows
        assert count == passages
        np.testing.assert_allclose(got + got.T, want, rtol=1e-3, atol=1e-3 * want.max())


def test_answer_words_are_looked_up_without_sorting_the_text(monkeypatch):
    """op2's CPU: members of a sorted list, and words without punctuation, are the same as by their definitions."""
    rng = np.random.default_rng(3)
    known = np.unique(rng.integers(0, 60, 20).astype(np.uint64))
    for values in (rng.integers(0, 80, 500).astype(np.uint64), np.zeros(0, np.uint64)):
        assert (D.members(values, known) == np.isin(values, known)).all()
    texts = ["".join(rng.choice(list("aB9 .,-é\n"), 40)) for _ in range(60)] + ["", None, "...", "a", "(a)"]
    for block in blocks(pa.array(texts, pa.large_string())):
        starts, ends, _ = block.words()
        with monkeypatch.context() as m:
            m.setattr(np, "searchsorted", None)  # no word is looked up by bisection
            first, last = block.cores(starts, ends)
        for s, e, a, b in zip(starts, ends, first, last):
            word = block.data[s:e].tobytes()
            bare = word.strip(bytes(np.flatnonzero(PUNCTUATION).tolist()))
            assert block.data[a:b].tobytes() == (bare or word)
