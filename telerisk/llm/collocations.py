"""Collocations: phrases whose parts occur together far more often than apart, counted by double-array tries.

Words are counted first.  Level by level, positions whose shorter phrases may all be frequent add to the count of
their phrase's hash; hashes that reach the least count form a filter of fixed size, which lets through every frequent
phrase and few others.  The phrases that pass it are the candidates.  They are dealt to blocks by their hashes, and one
pass over the texts deals the word keys of all occurrences to the same blocks, equal ones of a task as one entry with a
count.  Each block becomes a double-array trie in the task that counts it, and NumPy walks the block's entries through
it at once.  So texts are read the same number of times however many phrases there are.  Hashes and filters only choose
candidates and blocks: every count that is returned comes from a trie or from the words' own strings.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telerisk.llm.trie import Trie, build
from telerisk.llm.words import LOWER, Roller, column_bytes, mix
from telerisk.operators.ranges import numbered
from telerisk.session import materialise

#: bytes of text looked at in one step, hashes held by a task before they are handed on, hashes of one reducer, and strings held
SLICE, HELD, SHARD, STRINGS = 1 << 20, 1 << 19, 1 << 20, 1 << 17
#: phrases of one trie at most, tries counted by one task, and bits of a filter (log2)
PHRASES, TRIES, FILTER = 1 << 17, 3, 25
#: tags of texts are below this; cells of owners (log2); entries of one walk, and lists of entries merged before it
ANYONE, CELLS, VECTOR, VECTORS = 254, 24, 1 << 16, 256

BLANK, BREAK = np.zeros(256, bool), np.zeros(256, bool)
BLANK[[0x20, 0x09]] = True
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GOLD = np.uint64(0x9E3779B97F4A7C15)


def language_key(lang: str) -> int:
    return int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little")


class Words:
    """The words of a slice of a batch: places in the batch's bytes, language, key, and whether the next one continues."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, langs: np.ndarray, roller: Roller, tags: np.ndarray | None = None):
        part = data[lo:hi]
        solid = ~(BLANK | BREAK)[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[(offsets[(offsets >= lo) & (offsets <= hi)] - lo)] = True
        before = np.concatenate([[False], solid[:-1]])
        after = np.concatenate([solid[1:], [False]])
        start = np.flatnonzero(solid & (~before | edge[:-1]))
        end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        row = np.searchsorted(offsets, start + lo, "right") - 1
        breaks = np.cumsum(BREAK[part], dtype=np.int32)[start]
        self.linked = np.zeros(len(start), bool)
        self.linked[:-1] = (row[1:] == row[:-1]) & (breaks[1:] == breaks[:-1])
        self.row, self.start, self.end = row, start + lo, end + lo
        self.tag = None if tags is None else tags[row]
        self.key = mix(roller.spans(roller.sums(LOWER[part]), start, end) ^ langs[row])


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes that end where a row or a piece ends, so that no phrase is cut."""
    at, stop = int(offsets[0]), int(offsets[-1])
    while at < stop:
        end = min(at + limit, stop)
        if end < stop:
            row = int(offsets[np.searchsorted(offsets, end)])
            window = 1 << 12
            while end < row:
                found = np.flatnonzero(BREAK[data[end:min(end + window, row)]])
                end = end + int(found[0]) + 1 if len(found) else min(end + window, row)
                if len(found):
                    break
        yield at, end
        at = end


def scan(batch: pa.RecordBatch, roller: Roller) -> Iterator[tuple[np.ndarray, pa.Array, Words]]:
    """All slices of a batch of (lang, text): its bytes, its languages by row, and the slice's words.

    A text's tag is a number below ANYONE from its bytes; it does not depend on where the text lies.
    """
    langs = batch.column(0).dictionary_encode()
    codes = np.array([language_key(x) for x in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()] if len(langs) else np.zeros(0, np.uint64)
    data, offsets = column_bytes(batch.column(1))
    tags = np.array([crc32(data[a:b]) % ANYONE for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint8)
    for lo, hi in slices(data, offsets):
        yield data, batch.column(0), Words(data, offsets, lo, hi, codes, roller, tags)


def phrases(data: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Strings of lower-cased words, given by their places, joined by one space."""
    length = sum(e - s for s, e in parts) + len(parts) - 1
    offsets = np.concatenate([[0], np.cumsum(length)])
    out = np.full(int(offsets[-1]), 0x20, np.uint8)
    at = offsets[:-1].copy()
    for s, e in parts:
        n = e - s
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(at, n) + inner] = LOWER[data[np.repeat(s, n) + inner]]
        at += n + 1
    return pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * GOLD + b)


class Filter:
    """Bits of the keys that reached the least count: no such key is missing, others pass by chance."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.shift = bits, np.uint64(64 - size)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.shift
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    @classmethod
    def of(cls, keys: DataFrame, size: int | None = None) -> Filter:
        """From the column ``key`` (long); at most 2^(size - 6) rows reach the driver, however many keys there are."""
        size = size or FILTER
        at = F.shiftrightunsigned("key", 64 - size)
        rows = keys.select(at.alias("at")).groupBy(F.shiftrightunsigned("at", 6).alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).toArrow()
        bits = np.zeros(1 << (size - 6), np.uint64)
        bits[rows.column("w").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        return cls(bits, size)


class Owners:
    """For each frequent key the least tag of a text that holds it, in cells of fixed number.

    Only texts of that tag spell the key out as a candidate: at least one such text holds it, and few others.  Where
    keys of different tags share a cell, all texts do.
    """

    def __init__(self, cells: np.ndarray, size: int):
        self.cells, self.shift = cells, np.uint64(64 - size)

    def __call__(self, keys: np.ndarray, tags: np.ndarray) -> np.ndarray:
        owner = self.cells[keys >> self.shift]
        return (owner == tags.astype(np.uint16) + 1) | (owner == ANYONE + 1)

    @classmethod
    def of(cls, keys: DataFrame, size: int | None = None) -> Owners:
        """From ``key`` and ``tag``; at most 2^(size - 3) rows reach the driver, however many keys there are."""
        size = size or CELLS
        cell = keys.groupBy(F.shiftrightunsigned("key", 64 - size).alias("at")).agg(F.min("tag").alias("a"), F.max("tag").alias("b"))
        owner = F.when(F.col("a") == F.col("b"), F.col("a") + 1).otherwise(ANYONE + 1).cast("long")
        rows = cell.select("at", owner.alias("owner")).groupBy(F.shiftrightunsigned("at", 3).alias("w")).agg(
            F.bit_or(F.expr("shiftleft(owner, CAST(at & 7 AS INT) * 8)")).alias("owners")).toArrow()
        cells = np.zeros(1 << (size - 3), np.int64)
        cells[rows.column("w").to_numpy()] = rows.column("owners").to_numpy()
        return cls(cells.view(np.uint8), size)


def texts_of(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


class Strings:
    """Distinct phrases of one size with their counts, held as places in a batch's bytes until there are many."""

    def __init__(self, size: int):
        self.size, self.parts, self.held = size, [], 0

    def add(self, words: Words, at: np.ndarray, key: np.ndarray) -> None:
        key, first, n = np.unique(key, return_index=True, return_counts=True)
        places = [x for k in range(self.size) for x in (words.start[at[first] + k], words.end[at[first] + k])]
        self.parts.append((key, n, words.row[at[first]], *places))
        self.held += len(key)

    def take(self, data: np.ndarray, langs: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
        """Languages, phrases, counts and keys; nothing is held any more."""
        key, n, row, *places = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.held = [], 0
        key, first, which = np.unique(key, return_index=True, return_inverse=True)
        n = np.bincount(which, weights=n, minlength=len(key)).astype(np.int64)
        spans = [(places[2 * k][first], places[2 * k + 1][first]) for k in range(self.size)]
        return langs.take(pa.array(row[first])), phrases(data, spans), n, key


def count_words(texts: DataFrame, seed: int) -> DataFrame:
    """``lang``, ``word``, ``n`` and ``key`` of every word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, held = Roller(seed), Strings(1)

        def taken(data, langs):
            lang, word, n, key = held.take(data, langs)
            return pa.record_batch([lang, word, pa.array(n), pa.array(key.view(np.int64))], ["lang", "word", "n", "key"])

        for batch in batches:
            for data, langs, words in scan(batch, roller):
                held.add(words, np.arange(len(words.key)), words.key)
                if held.held > STRINGS:
                    yield taken(data, langs)
            if held.parts:
                yield taken(data, langs)

    rows = texts.mapInArrow(run, "lang string, word string, n long, key long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.max("key").alias("key"))


def words_of(texts: DataFrame, least: int) -> tuple[DataFrame, int]:
    """The counted words, and the seed by which no frequent word shares its key."""
    for seed in itertools.count(1):
        words = materialise(count_words(texts, seed), "words")
        if not words.groupBy("key").agg(F.count("*").alias("c"), F.max("n").alias("n")).where(f"c > 1 AND n >= {least}").limit(1).count():
            return words, seed


def frequent_keys(texts: DataFrame, found: Callable[[Words], tuple[np.ndarray, np.ndarray]], seed: int, total: int, least: int) -> DataFrame:
    """``key`` and ``tag`` (the least of its texts) of those that occur ``least`` times or more among the (position, key) that ``found`` takes from a slice."""
    shards = max(1, -(-total // SHARD))

    def packed(keys: np.ndarray, n: np.ndarray, tags: np.ndarray) -> Iterator[pa.RecordBatch]:
        shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        which, first = np.unique(shard, return_index=True)
        cuts = [*first.tolist(), len(keys)]
        yield pa.record_batch([pa.array(which.astype(np.int64)), *(pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for x in (keys, n, tags))],
                              ["shard", "keys", "n", "tags"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, held, size = Roller(seed), [], 0
        for batch in batches:
            for _, _, words in scan(batch, roller):
                at, keys = found(words)
                held.append(added([(keys, np.ones(len(keys), np.int64), words.tag[at])]))
                size += len(held[-1][0])
                if size > HELD:
                    held = [added(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from packed(*held.pop())
                        size = 0
        if size:
            yield from packed(*added(held))

    def reduce(group: pa.Table) -> pa.Table:
        parts = zip(*(group.column(x).to_pylist() for x in ("keys", "n", "tags")))
        keys, n, tags = added([(np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64), np.frombuffer(t, np.uint8)) for k, c, t in parts])
        return pa.table({"key": pa.array(keys[n >= least].view(np.int64)), "tag": pa.array(tags[n >= least].astype(np.int32))})

    return texts.mapInArrow(run, "shard long, keys binary, n binary, tags binary").groupBy("shard").applyInArrow(reduce, "key long, tag int")


def added(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of several lists of (key, count, tag), counts added, the least tag kept."""
    keys, n, tags = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, n, tags = keys[order], n[order], tags[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (keys[first], np.add.reduceat(n, first), np.minimum.reduceat(tags, first)) if len(first) else (keys, n, tags)


def levels(words: Words, filters: list[Filter]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and keys of the phrases of 1, 2, ... words that the filters let through, level by level, then the next ones."""
    at, key = np.arange(len(words.key)), words.key
    for known in filters:
        passed = known(key)
        at, key = at[passed], key[passed]
        yield at, key
        # the phrase of one word more: it and the one that starts a word later share all but their ends
        linked = words.linked[at]
        here, after = np.flatnonzero(linked), np.searchsorted(at, at[linked] + 1)
        there = (after < len(at)) & (at[np.minimum(after, len(at) - 1)] == at[here] + 1) if len(at) else np.zeros(0, bool)
        here, after = here[there], after[there]
        at, key = at[here], pair_keys(key[here], key[after])
    yield at, key


def candidates(texts: DataFrame, words: DataFrame, seed: int, total: int, least: int, longest: int) -> tuple[DataFrame, Broadcast]:
    """``lang``, ``phrase``, ``size`` and ``key`` of phrases of 2 to ``longest`` words, among them all that occur ``least`` times; and the filters of all sizes."""
    context, filters = texts.sparkSession.sparkContext, [Filter.of(words.where(F.col("n") >= least).select("key"))]
    shared = context.broadcast(filters)
    owners = []
    for _ in range(2, longest + 1):
        keys = materialise(frequent_keys(texts, lambda w, shared=shared: list(levels(w, shared.value))[-1], seed, total, least), "keys")
        filters = [*filters, Filter.of(keys)]
        owners.append(context.broadcast(Owners.of(keys)))
        shared = context.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, held = Roller(seed), [Strings(size) for size in range(2, longest + 1)]

        def taken(strings, data, langs):
            lang, phrase, n, key = strings.take(data, langs)
            return pa.record_batch([lang, phrase, pa.array(np.full(len(n), strings.size, np.int32)), pa.array(key.view(np.int64))], ["lang", "phrase", "size", "key"])

        for batch in batches:
            for data, langs, words in scan(batch, roller):
                for strings, owner, (at, key) in zip(held, owners, itertools.islice(levels(words, shared.value), 1, longest)):
                    mine = owner.value(key, words.tag[at])
                    strings.add(words, at[mine], key[mine])
                    if strings.held > STRINGS:
                        yield taken(strings, data, langs)
            for strings in held:
                if strings.parts:
                    yield taken(strings, data, langs)

    return texts.mapInArrow(run, "lang string, phrase string, size int, key long").distinct(), shared


def entries(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Several lists of (key, count, word keys) as one, counts added; entries of one key are only merged if their words are the same."""
    keys, n, words = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    keys, n, words = keys[order], n[order], words[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (words[1:] != words[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    return (keys[first], np.add.reduceat(n, first), words[first]) if len(first) else (keys, n, words)


def occurrences(texts: DataFrame, shared: Broadcast, seed: int, blocks: int, longest: int) -> DataFrame:
    """``team``, ``block``, and lists of ``words`` (their keys, 0 fills short phrases) and ``n`` of all phrases that the filters let through."""
    def packed(keys: np.ndarray, n: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
        block = ((keys >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)  # as ``block_of``
        which, first = np.unique(block, return_index=True)
        cuts = [*first.tolist(), len(keys)]
        return pa.record_batch([pa.array((which // np.uint64(TRIES)).astype(np.int64)), pa.array(which.astype(np.int64)),
                                *(pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for x in (words, n))],
                               ["team", "block", "words", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, held, size = Roller(seed), [], 0
        for batch in batches:
            for _, _, words in scan(batch, roller):
                for k, (at, keys) in enumerate(itertools.islice(levels(words, shared.value), 1, longest), 2):
                    spelled = np.zeros((len(at), longest), np.uint64)
                    for j in range(k):
                        spelled[:, j] = words.key[at + j]
                    held.append(entries([(keys, np.ones(len(keys), np.int64), spelled)]))
                    size += len(held[-1][0])
                if size > HELD:
                    held = [entries(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield packed(*held.pop())
                        size = 0
        if size:
            yield packed(*entries(held))

    return texts.mapInArrow(run, "team long, block long, words binary, n binary")


def block_of(blocks: int) -> Column:
    """Block of the column ``key``: equal parts of the range of its upper half."""
    return F.shiftright(F.shiftrightunsigned("key", 32) * F.lit(blocks), 32)


def trie_of(group: pa.Table, roller: Roller, longest: int) -> Trie:
    """Trie of candidates with ``number``, ``lang`` and ``phrase``."""
    langs = group.column("lang").combine_chunks().dictionary_encode()
    codes = np.array([language_key(x) for x in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()]
    words = Words(*(lambda d, o: (d, o, int(o[0]), int(o[-1])))(*column_bytes(group.column("phrase").combine_chunks())), codes, roller)
    place = np.arange(len(words.row)) - np.searchsorted(words.row, words.row)
    keys = np.zeros((len(group), longest), np.uint64)
    keys[words.row, place] = words.key
    return build(keys, group.column("number").to_numpy())


def count_phrases(placed: DataFrame, found: DataFrame, seed: int, least: int, longest: int) -> DataFrame:
    """``block``, ``number`` and ``a`` (occurrences, ``least`` or more) of the candidates ``placed``, from the entries ``found`` of their blocks."""
    def lists(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for w, n in zip(group.column("words"), group.column("n")):
            words = np.frombuffer(w.as_py(), np.uint64).reshape(-1, longest)
            yield functools.reduce(pair_keys, words.T), np.frombuffer(n.as_py(), np.int64), words

    def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        roller, out = Roller(seed), []
        for block in np.unique(ours.column("block").to_numpy()).tolist():
            trie = trie_of(ours.filter(pc.equal(ours.column("block"), block)), roller, longest)
            total = np.zeros(trie.sequences, np.int64)
            parts = lists(theirs.filter(pc.equal(theirs.column("block"), block)))
            while some := list(itertools.islice(parts, VECTORS)):
                _, n, words = entries(some)
                for i in range(0, len(n), VECTOR):
                    total += trie.weigh(words[i:i + VECTOR], n[i:i + VECTOR])
            at = np.flatnonzero(total >= least)
            out.append(pa.table({"block": pa.array(np.full(len(at), block, np.int64)), "number": pa.array(at.astype(np.int64)), "a": pa.array(total[at])}))
        return pa.concat_tables(out) if out else pa.table({x: pa.array([], pa.int64()) for x in ("block", "number", "a")})

    return placed.groupBy("team").cogroup(found.groupBy("team")).applyInArrow(run, "block long, number long, a long")


def frequent_phrases(docs: DataFrame, least: int = 10, longest: int = 3, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All phrases of 2 to ``longest`` words that occur ``least`` times or more (``lang``, ``phrase``, ``size``, ``a``), and all words
    (``lang``, ``word``, ``n``)."""
    spark = docs.sparkSession
    texts = texts_of(docs, lang_col, text_col)
    words, seed = words_of(texts, least)
    total = words.agg(F.sum("n")).first()[0] or 0
    found, shared = candidates(texts, words, seed, total, least, longest)
    # a block has at most about SHARD entries, however many tasks hand them on, and so no more than SHARD / least phrases
    blocks = max(1, -(-total * (longest - 1) // min(SHARD, PHRASES * least)))
    place = F.row_number().over(Window.partitionBy("block").orderBy("lang", "phrase")) - 1
    placed = found.withColumn("block", block_of(blocks)).select(
        F.expr(f"block div {TRIES}").alias("team"), "block", place.cast("long").alias("number"), "lang", "phrase", "size")
    placed = materialise(placed, "numbered")
    counts = materialise(count_phrases(placed, occurrences(texts, shared, seed, blocks, longest), seed, least, longest), "phrases")
    return materialise(placed.join(counts, ["block", "number"]).select("lang", "phrase", "size", "a"), "frequent"), words


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, absorb: int = 50, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank`` (from 1), ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``.

    Words are runs of bytes other than blank and tab, ASCII letters lower-cased, inside pieces that end at ``.,;:!?`` or a
    line break.  A phrase occurs a times; its cut into parts of l and r occurrences with the least
    floor(1000000 * a * a / (l * r)) counts (ties: the shorter first part); n is the number of words of the language.
    Phrases inside a longer one with at least ``absorb`` percent of their occurrences are left out.  Order: score and a
    descending, then the phrase by its bytes.  Null texts are empty, null languages ``und``; repeated rows count each;
    an empty table gives no rows; other columns are not read.
    """
    phrases, words = frequent_phrases(docs, least, longest, lang_col, text_col)
    parts = F.split("phrase", " ")
    known = phrases.select("lang", "phrase", "a").union(words.where(F.col("n") >= least).select("lang", F.col("word"), "n"))
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "size", "a", "k", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice(parts, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail"))
    cut = (cut.join(known.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
           .join(known.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"]))
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    # score is at most a million, as a is at most l and at most r
    cut = cut.withColumn("score", F.expr(f"CAST({wide('a')} * {wide('a')} * 1000000BD AS DECIMAL(38, 0)) DIV CAST({wide('l')} * {wide('r')} AS DECIMAL(38, 0))"))
    order = F.col("score") * 64 + F.col("k")
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min("score").alias("score"), F.min_by("l", order).alias("l"), F.min_by("r", order).alias("r"))
    inner = phrases.where("size > 2").withColumn("inside", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("from", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("inside") + 1)))
    inner = inner.select("lang", F.array_join(F.slice(parts, F.col("from"), F.col("inside")), " ").alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(inner, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {absorb} * a")
    # numbered over ranges, so that no task sorts all phrases of a language
    left = left.select("lang", "phrase", "a", "l", "r", "score", (-F.col("score")).alias("by_score"), (-F.col("a")).alias("by_count"))
    best = numbered(left, ["lang"], ["by_score", "by_count", "phrase"], "rank").where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
