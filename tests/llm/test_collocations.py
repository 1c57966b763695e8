import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from telerisk.llm import collocations as C
from telerisk.llm import trie as T


def brute(docs, least=10, top=2000, longest=3, absorb=50):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    rows = []
    for (lang, w), a in cand.items():
        score, k = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        longer = max((b for (g, v), b in cand.items() if g == lang and len(v) > len(w) and any(v[i:i + len(w)] == w for i in range(len(v)))), default=None)
        if longer is None or 100 * longer < absorb * a:
            rows.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out, place = [], Counter()
    for lang, score, a, phrase, left, right in sorted(rows):
        place[lang] += 1
        if place[lang] <= top:
            out.append((lang, place[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return out


def corpus(seed, rows=400):
    rng = random.Random(seed)
    vocab = ["the", "The", "of", "été", "日本", "a-b", "new", "york", "city", "x\x00y", "q\x1fz", "#"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!", " ;", "\r\n"]
    text = lambda: "".join(rng.choice(vocab) + rng.choice(ends) for _ in range(rng.choice([0, 1, 2, 9, 40])))
    docs = [(rng.choice(["en", "en", "en", "fr", None, "und", "日"]), text()) for _ in range(rows)]
    return docs + [("en", None), ("en", ""), (None, None), ("de", " \t.\n"), ("en", "new york city " * 2000)]


@pytest.mark.parametrize("seed,least,top", [(1, 10, 2000), (2, 3, 25)])
def test_equals_brute_force(spark, monkeypatch, seed, least, top):
    if seed == 2:
        for name, value in (("SLICE", 300), ("HELD", 50), ("SHARD", 500), ("PHRASES", 100), ("TRIES", 2), ("FILTER", 8), ("CELLS", 8), ("VECTOR", 16), ("VECTORS", 2)):
            monkeypatch.setattr(C, name, value)
        monkeypatch.setattr(C.slices, "__defaults__", (300,))
    docs = corpus(seed)
    df = spark.createDataFrame([(lang, t, "x", 1) for lang, t in docs], "lang string, text string, phrase string, n int").repartition(4)
    got = [tuple(r) for r in C.collocations(df, least=least, top=top).orderBy("lang", "rank").collect()]
    assert sorted(got) == sorted(brute(docs, least, top)) and len(got) > 8


def test_keys_held_in_several_lists_are_all_handed_on(spark, monkeypatch):
    docs = [("en", " ".join(f"{w}{i} {w}{i} x{w}{i}" for i in range(20)) + ".") for w in "abcdefgh" for _ in range(10)]
    monkeypatch.setattr(C, "HELD", 400)
    df = spark.createDataFrame(docs, "lang string, text string").coalesce(1)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "1")  # a slice for each text
    try:
        got = [tuple(r) for r in C.collocations(df).collect()]
    finally:
        spark.conf.unset(size)
    assert sorted(got) == sorted(brute(docs)) and len(got) > 100


def test_large_counts_stay_exact(spark):
    docs = spark.createDataFrame([("en", "p q " * 80000)] * 40, "lang string, text string")
    got = {r.phrase: r for r in C.collocations(docs).collect()}
    a = 80000 * 40  # a million times its square passes 64 bits
    assert got["p q p"].a == a - 40 and got["p q p"].score == 1000000 * (a - 40) ** 2 // (a * a)
    assert "p q" not in got and "q p" not in got


def test_edges(spark):
    schema = "lang string, text string"
    assert C.collocations(spark.createDataFrame([], schema)).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None), ("en", ". ,")], schema)).count() == 0
    assert C.collocations(spark.createDataFrame([("en", "one two")] * 9, schema)).count() == 0
    rows = C.collocations(spark.createDataFrame([("en", "One two")] * 10, schema)).collect()
    assert [tuple(r) for r in rows] == [("en", 1, "one two", 10, 10, 10, 20, 1000000)]


def test_slices_cut_only_between_pieces():
    rng = random.Random(4)
    rows = ["".join(rng.choice("ab .\n") for _ in range(rng.choice([0, 5, 200]))) + "c" * rng.choice([0, 90]) for _ in range(40)]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    for limit in (1, 10, 64, 10 ** 6):
        parts = list(C.slices(data, offsets, limit))
        assert [a for a, _ in parts] == [0, *(b for _, b in parts[:-1])] and parts[-1][1] == len(data)
        assert all(b in offsets or C.BREAK[data[b - 1]] for _, b in parts)


@pytest.mark.parametrize("seed,n,alphabet", [(1, 1, 1), (2, 300, 6), (3, 5000, 400), (4, 3000, 3000), (5, 20000, 70000)])
def test_trie_counts_every_sequence(seed, n, alphabet):
    rng = np.random.default_rng(seed)
    keys = rng.integers(1, 1 << 63, alphabet, dtype=np.uint64) * np.uint64(2)
    pick = keys[(alphabet * rng.random((n, 3)) ** 3).astype(int)]
    pick[rng.random(n) < 0.5, 2] = 0
    pick = np.unique(pick, axis=0)
    trie = T.build(pick, np.arange(len(pick)))
    assert len(trie.base) < 4 * 9 * len(pick) + 1000
    text = np.where(rng.random(20000) < 0.9, keys[(alphabet * rng.random(20000) ** 3).astype(int)], np.uint64(1))
    linked = rng.random(20000) < 0.8
    linked[-1] = False
    want = Counter()
    for i in range(len(text)):
        for k in (2, 3):
            if i + k <= len(text) and linked[i:i + k - 1].all():
                want[tuple(text[i:i + k].tolist())] += 1
    got = trie.count(text, linked)
    assert got.tolist() == [want[tuple(x for x in row if x)] for row in pick.tolist()]


def test_what_a_task_holds_is_bounded():
    """op12's memory: the hashes that a task holds, with the copies of their merge, and the tries of a pass stay small."""
    rng = np.random.default_rng(5)
    words = np.unique((rng.zipf(1.3, (C.PHRASES, 3)) % 50000 + 1).astype(np.uint64), axis=0)
    trie = T.build(words, np.arange(len(words)))
    size = sum(x.nbytes for x in (trie.symbols, trie.codes, trie.base, trie.check, trie.accept)) * C.PHRASES / len(words)
    assert C.TRIES * size < 40e6
    keys = rng.integers(0, 1 << 63, C.HELD).astype(np.uint64)
    tracemalloc.start()
    try:
        C.added([(keys, np.ones(len(keys), np.int64), np.zeros(len(keys), np.uint8))])
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("seed,n,alphabet", [(1, 1, 1), (2, 300, 6), (3, 5000, 400), (5, 20000, 70000)])
def test_trie_weighs_whole_sequences(seed, n, alphabet):
    rng = np.random.default_rng(seed)
    keys = rng.integers(1, 1 << 63, alphabet, dtype=np.uint64) * np.uint64(2)
    drawn = lambda m: np.where((np.arange(3) < 2) | (rng.random((m, 1)) < 0.5), keys[(alphabet * rng.random((m, 3)) ** 3).astype(int)], np.uint64(0))
    pick, others = np.unique(drawn(n), axis=0), drawn(500)
    trie = T.build(pick, np.arange(len(pick)))
    rows = np.concatenate([pick, others, pick[::2], [[1, 2, 3]]]).astype(np.uint64)
    weight = rng.integers(1, 1 << 40, len(rows))
    want = Counter()
    for row, w in zip(rows.tolist(), weight.tolist()):
        want[tuple(row)] += w
    assert trie.weigh(rows, weight).tolist() == [want[tuple(row)] for row in pick.tolist()]
    assert trie.weigh(rows[:0], weight[:0]).sum() == 0


def test_words_of_equal_hash_are_kept_apart():
    key, words = np.array([7, 7, 3, 7], np.uint64), np.array([[1, 2, 0], [1, 5, 0], [4, 4, 0], [1, 2, 0]], np.uint64)
    got = Counter()
    for n, w in zip(*C.entries([(key[:2], np.array([2, 3]), words[:2]), (key[2:], np.array([1, 9]), words[2:])])[1:]):
        got[tuple(w.tolist())] += int(n)
    assert got == {(1, 2, 0): 11, (1, 5, 0): 3, (4, 4, 0): 1}


def test_texts_are_read_the_same_number_of_times_however_many_phrases(spark, monkeypatch):
    """op12's time: with small blocks there are many tries, and still one pass for words, one a level, one for strings and one for counts."""
    docs = [("en", " ".join(f"{w}{i} x{w}{i}" for i in range(60)) + ".") for w in "abcdefgh" for _ in range(10)]
    for name, value in (("SHARD", 100), ("PHRASES", 10), ("TRIES", 2)):
        monkeypatch.setattr(C, name, value)
    reads = spark.sparkContext.accumulator(0)
    scan = C.scan

    def counted(batch, roller):
        reads.add(batch.num_rows)
        return scan(batch, roller)

    monkeypatch.setattr(C, "scan", counted)
    df = spark.createDataFrame(docs, "lang string, text string").coalesce(1)
    assert sorted(tuple(r) for r in C.collocations(df).collect()) == sorted(brute(docs))
    assert reads.value == 5 * len(docs)
