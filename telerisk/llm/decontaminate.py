"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of 32 words, one every 16 words, and weighted by TF-IDF; document frequencies
cover all passages of the corpus.  A randomised SVD gives the latent space: subspace iterations with the Gram
matrix of all passages of the corpus and of the benchmark, which Spark sums once over the documents.  Passages with
enough of the benchmark's answer words near them (which a confirmation needs) are folded in and compared with every
benchmark passage in that space.  What lies outside the space adds at most the product of both parts' norms, so pairs
that could reach the threshold, and only those, get their exact inner product too.  The cosine counts the words of the
passage that the benchmark passage has, so the words around a short text do not hide it.  What is near enough is
confirmed against the whole benchmark text, or against the passage that was met, by the longest common subsequence of
words and by its answer, so paraphrases count and chance similarity does not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telerisk.llm.words import LOWER, WORDS, Block, blocks
from telerisk.session import materialise

HOP, BINS, EXTRA, ITERATIONS = 16, 1 << 18, 16, 2
#: dimensions of the latent space, as a share of the benchmark passages
RANK_SHARE = 0.7
#: energy of the benchmark passages in the fit, as a multiple of the documents'
BOOST = 25.0
#: benchmark texts and their passages searched for in one pass, about; more go in further passes
ITEMS, PASSAGES = 400, 1000
COSINE, COMMON = 0.5, 0.6
#: the rarest words of a benchmark text (or passage) stand for its answer; this share of them must be near the passage
ANSWER_WORDS, ANSWER = 5, 0.4
#: passages compared at once, and what float sums may lack
STEP, SLACK = 256, 1e-3
_COLUMNS = 512
#: sums that a task holds, columns of a part of them, and pairs of words taken at once
_CELLS, _ROWS, _PAIRS = 1 << 25, 16, 1 << 18


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of each word, lower case and without punctuation around it."""
    starts, ends, rows = block.words()
    a, b = block.cores(starts, ends)
    return starts, ends, rows, WORDS.spans(WORDS.sums(LOWER[block.data]), a, b)


def hops(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hop (16 words of one row) of each word, and the row of each hop."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    size = np.diff(np.append(first, len(rows)))
    per = -(-size // HOP)
    inside = np.arange(len(rows)) - np.repeat(first, size)
    return np.repeat(np.cumsum(per) - per, size) + inside // HOP, np.repeat(rows[first], per)


def frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Hops that hold each hashed word, over the whole corpus, and the number of hops."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hop_count = np.zeros(BINS, np.int64), 0
        for batch in batches:
            for block in blocks(batch.column(0)):
                _, _, rows, hashes = word_hashes(block)
                hop, hop_rows = hops(rows)
                key = np.sort(hop * BINS + (hashes % np.uint64(BINS)).astype(np.int64))
                new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
                total += np.bincount(key[new] % BINS, minlength=BINS)
                hop_count += len(hop_rows)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], hop_count))], ["bin", "n"])

    # at most BINS + 1 rows reach the driver
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BINS + 1, np.int64)
    out[found.column("bin").to_numpy()] = found.column("n").to_numpy()
    return out[:BINS], int(out[BINS])


@dataclass
class Index:
    idf: np.ndarray            # by bin
    column: np.ndarray         # by bin; -1 where no benchmark text has the word
    basis: np.ndarray          # columns x rank, each row times its word's weight
    query: np.ndarray          # benchmark passages in the latent space, divided by their norms
    query_item: np.ndarray
    item_ids: list
    item_words: list           # word hashes of each benchmark text
    answers: list              # word hashes that an answer check asks for
    query_words: tuple         # columns and weights of each benchmark passage
    passage_words: list        # word hashes of each benchmark passage
    passage_answers: list

    @cached_property
    def exact(self) -> np.ndarray:
        """Columns x benchmark passages: what a word adds to the inner product."""
        out = np.zeros((len(self.basis), len(self.query)), np.float32)
        for k, (cols, weights) in enumerate(zip(*self.query_words)):
            np.add.at(out[:, k], cols, weights)
        return out * self.weight[:, None]

    @cached_property
    def weight(self) -> np.ndarray:
        """Weight of each column's word."""
        return self.idf[np.flatnonzero(self.column >= 0)]

    @cached_property
    def outside(self) -> np.ndarray:
        """Norm of each benchmark passage's part outside the latent space."""
        whole = np.array([np.sum(np.bincount(np.unique(c, return_inverse=True)[1], weights=w) ** 2) for c, w in zip(*self.query_words)])
        return np.sqrt(np.maximum(whole - np.sum(self.query.astype(np.float64) ** 2, axis=1), 0)).astype(np.float32)

    @cached_property
    def answer_words(self) -> np.ndarray:
        """Sorted hashes of all words that an answer check asks for; each has a column."""
        return np.array(sorted({w for a in (*self.answers, *self.passage_answers) for w in a}), np.uint64)

    @cached_property
    def norm(self) -> np.ndarray:
        """Norm of each benchmark passage."""
        return np.array([np.linalg.norm(self.weight[c]) for c in self.query_words[0]], np.float32)


def members(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which ``values`` are in ``known`` (sorted, not empty), without sorting them."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def gram(columns: list[np.ndarray], weights: list[np.ndarray], by: np.ndarray) -> np.ndarray:
    """A' (A by) for sparse rows A."""
    out = np.zeros_like(by)
    for lo in range(0, len(columns), 512):
        cols, w = columns[lo:lo + 512], weights[lo:lo + 512]
        size = np.array([len(c) for c in cols])
        if not size.sum():
            continue
        row, col, value = np.repeat(np.arange(len(cols)), size), np.concatenate(cols), np.concatenate(w)[:, None]
        used, local = np.unique(col, return_inverse=True)
        dense = np.zeros((len(cols), len(used)), np.float32)
        np.add.at(dense, (row, local), value[:, 0])
        out[used] += dense.T @ (dense @ by[used])
    return out


def pair_sums(block: Block, column: np.ndarray, idf: np.ndarray, sums: np.ndarray, first: int) -> int:
    """Adds the pairs of words that share a passage to ``sums``, and returns the number of passages.

    ``sums`` holds the columns from ``first`` on against all columns: for each pair of places, the earlier column's row gets
    1 / norm^2 of every passage with both.  A place and itself count half, so ``sums`` and its transpose add up to the whole.
    """
    _, _, rows, hashes = word_hashes(block)
    hop, hop_rows = hops(rows)
    if not len(hop):
        return 0
    bins = (hashes % np.uint64(BINS)).astype(np.int64)
    pair = np.append(hop_rows[1:] == hop_rows[:-1], False)
    begins = pair | np.append(True, hop_rows[1:] != hop_rows[:-1])  # the last hop belongs to the passage before
    energy = np.bincount(hop, weights=idf[bins].astype(np.float64) ** 2, minlength=len(hop_rows))
    energy += np.where(pair, np.append(energy[1:], 0), 0)
    apart = np.where(begins, 1 / np.maximum(1e-18, energy), 0).astype(np.float32)
    near = apart + np.append(np.float32(0), np.where(pair, apart, 0)[:-1])
    col = column[bins]
    hop, col = hop[col >= 0], col[col >= 0]
    edge = np.searchsorted(hop, np.arange(len(hop_rows) + 1))
    own, last = edge[hop + 1], edge[hop + 1 + pair[hop]]
    near, apart, count = near[hop], apart[hop], last - np.arange(len(hop))
    flat, n = sums.reshape(-1), sums.shape[1]
    reach = np.concatenate([[0], np.cumsum(count)])
    lo = 0
    while lo < len(hop):
        hi = max(lo + 1, int(np.searchsorted(reach, reach[lo] + _PAIRS, side="right")) - 1)
        one = np.repeat(np.arange(lo, hi), count[lo:hi])
        two = np.arange(reach[hi] - reach[lo]) - (reach[one] - reach[lo]) + one
        value = np.where(two < own[one], near[one], apart[one])
        value[one == two] /= 2
        i, j = col[one], col[two]
        key = (np.minimum(i, j) - first) * n + np.maximum(i, j)
        if sums.shape[0] < n:
            inside = (key >= 0) & (key < len(flat))
            key, value = key[inside], value[inside]
        np.add.at(flat, key, value)
        lo = hi
    return int(begins.sum())


def moments(docs: DataFrame, text_col: str, column: np.ndarray, idf: np.ndarray) -> DataFrame:
    """Sum of the outer products of all passages (benchmark words only): ``part`` is its first column, ``sums`` _ROWS rows.

    Each pair of columns is held once; this table and its transpose add up to the whole.  Rows with part -1 count the passages.
    A task adds up at most _CELLS sums at once (further columns take further passes), and there are no more than a few tasks
    for each core, so what is shuffled does not grow with the documents.
    """
    spark = docs.sparkSession
    n = int(column.max()) + 1
    weight = idf[np.flatnonzero(column >= 0)].astype(np.float32)
    shared = spark.sparkContext.broadcast((column, idf, weight))
    texts = docs.select(F.col(text_col).alias("text")).coalesce(2 * spark.sparkContext.defaultParallelism)
    stripe = max(_ROWS, _CELLS // n // _ROWS * _ROWS)
    kind = pa.schema([("part", pa.int32()), ("sums", pa.binary())])

    def sweep(lo: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            column, idf, weight = shared.value
            sums, count = np.zeros((min(stripe, n - lo), n), np.float32), 0
            for batch in batches:
                for block in blocks(batch.column(0)):
                    count += pair_sums(block, column, idf, sums, lo)
            if count:
                for a in range(0, len(sums), _ROWS):
                    part = sums[a:a + _ROWS] * weight[lo + a:lo + a + _ROWS, None] * weight
                    yield pa.record_batch([pa.array([lo + a], pa.int32()), pa.array([part.tobytes()], pa.binary())], schema=kind)
                if lo == 0:
                    yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([np.float32([count]).tobytes()], pa.binary())], schema=kind)

        return texts.mapInArrow(run, "part int, sums binary")

    out = sweep(0)
    for lo in range(stripe, n, stripe):
        out = out.union(sweep(lo))
    return out.groupBy("part").applyInArrow(_add, "part int, sums binary")


def _add(key: tuple, group: pa.Table) -> pa.Table:
    """The sum of a group's float arrays."""
    total = None
    for x in group.column("sums"):
        part = np.frombuffer(x.as_buffer(), np.float32)
        total = part.astype(np.float64) if total is None else np.add(total, part, out=total)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def latent_basis(docs: DataFrame, text_col: str, column: np.ndarray, idf: np.ndarray, own: tuple[list, list]) -> np.ndarray:
    """Orthonormal columns x rank basis by randomised subspace iteration over the passages of all documents."""
    spark = docs.sparkSession
    n = int(column.max()) + 1
    keep = min(n, max(16, int(RANK_SHARE * len(own[0]))))
    rank = min(keep + EXTRA, n)
    table = materialise(moments(docs, text_col, column, idf), "moments")
    count = sum(float(np.frombuffer(r.sums, np.float32)[0]) for r in table.where("part = -1").collect())
    table = table.where("part >= 0")
    boost = np.float32(np.sqrt(BOOST * max(1.0, count / max(1, len(own[0])))))

    def product(by: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(by.astype(np.float32))  # columns x rank, bounded by PASSAGES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by = shared.value
            total = np.zeros_like(by)
            for batch in batches:
                for lo, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                    half = np.frombuffer(sums.as_buffer(), np.float32).reshape(-1, len(by))
                    total[lo:lo + len(half)] += half @ by
                    total += half.T @ by[lo:lo + len(half)]
            at = range(0, len(total), _COLUMNS)
            yield pa.record_batch([pa.array(list(range(len(at))), pa.int32()), pa.array([total[a:a + _COLUMNS].tobytes() for a in at])], ["part", "sums"])

        parts = table.mapInArrow(run, "part int, sums binary").groupBy("part").applyInArrow(_add, "part int, sums binary").collect()
        total = gram(own[0], [w * boost for w in own[1]], by.astype(np.float32))
        for part in parts:
            total[part.part * _COLUMNS:(part.part + 1) * _COLUMNS] += np.frombuffer(part.sums, np.float32).reshape(-1, by.shape[1])
        return total.astype(np.float64)

    basis = np.random.default_rng(0).standard_normal((n, rank))
    for _ in range(ITERATIONS):
        basis, _ = np.linalg.qr(product(basis))
    values, turn = np.linalg.eigh(basis.T @ product(basis))
    return (basis @ turn[:, np.argsort(-values)[:keep]]).astype(np.float32)


def build(docs: DataFrame, items: list[tuple], idf: np.ndarray, id_col: str, text_col: str) -> Index | None:
    """Index of benchmark texts (id, text); None if none has a word."""
    texts = pa.array([t for _, t in items], pa.large_string())
    words, cols, weights, query_item, passage_words = [], [], [], [], []
    column = np.full(BINS, -1, np.int64)
    parts = list(blocks(texts))
    for block in parts:
        _, _, rows, hashes = word_hashes(block)
        first = np.searchsorted(rows, np.arange(block.rows + 1))
        words += [hashes[a:b] for a, b in zip(first, first[1:])]
    if not any(len(w) for w in words):
        return None
    seen = np.unique(np.concatenate(words) % np.uint64(BINS)).astype(np.int64)
    column[seen] = np.arange(len(seen))
    for i, w in enumerate(words):
        bins = (w % np.uint64(BINS)).astype(np.int64)
        for a in range(0, max(1, len(w) - HOP), HOP):
            part = bins[a:a + 2 * HOP]
            if len(part):
                cols.append(column[part])
                weights.append(idf[part] / np.linalg.norm(idf[part]))
                query_item.append(i)
                passage_words.append(w[a:a + 2 * HOP])
    basis = latent_basis(docs, text_col, column, idf, (cols, weights))
    query = np.stack([(w[:, None] * basis[c]).sum(axis=0) for c, w in zip(cols, weights)])
    answers, passage_answers = ([w[np.argsort(-idf[(w % np.uint64(BINS)).astype(np.int64)], kind="stable")][:ANSWER_WORDS] for w in each]
                                for each in (words, passage_words))
    return Index(idf, column, basis * idf[seen][:, None], query.astype(np.float32), np.array(query_item), [i for i, _ in items],
                 [w.tolist() for w in words], [a.tolist() for a in answers], (cols, weights),
                 [w.tolist() for w in passage_words], [a.tolist() for a in passage_answers])


def common(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, bits of one integer for the item's words."""
    places: dict[int, int] = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in text:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def search(block: Block, index: Index, cosine: float, least: float) -> list[list[dict]]:
    """Confirmed matches of each row: at most one for each benchmark text, the best."""
    found: list[dict] = [{} for _ in range(block.rows)]
    starts, ends, rows, hashes = word_hashes(block)
    if not len(starts):
        return [[] for _ in found]
    hop, hop_rows = hops(rows)
    bins = (hashes % np.uint64(BINS)).astype(np.int64)
    known = index.column[bins] >= 0
    bounds = np.searchsorted(hop, np.arange(len(hop_rows) + 1))
    pair = np.append(hop_rows[1:] == hop_rows[:-1], False)
    lone = ~pair & np.append(True, hop_rows[1:] != hop_rows[:-1])
    # a word is asked for by how many answers; few passages have enough of them near
    answer = np.zeros(len(hashes), bool)
    answer[known] = members(hashes[known], index.answer_words)
    asked = np.concatenate([[0], np.cumsum(answer)])
    need, passage_need = (np.array([int(np.ceil(ANSWER * len(a))) for a in each]) for each in (index.answers, index.passage_answers))
    length = np.array([len(w) for w in index.item_words])
    edge = np.searchsorted(rows, np.arange(block.rows + 1))
    whole = np.flatnonzero(pair | lone)
    last = bounds[whole + 1 + pair[whole]]
    reach = asked[np.minimum(edge[hop_rows[whole] + 1], last + length.max())] - asked[np.maximum(edge[hop_rows[whole]], bounds[whole] - length.max())]
    near = whole[reach >= min(need[index.query_item].min(), passage_need.min())]
    columns = len(index.basis)
    for lo in range(0, len(near), STEP):
        at = near[lo:lo + STEP]
        size = bounds[at + 1 + pair[at]] - bounds[at]
        word = np.repeat(bounds[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        inside = known[word]
        # the passages' known words: passage, column and times
        cell, times = np.unique(np.repeat(np.arange(len(at)), size)[inside] * columns + index.column[bins[word[inside]]], return_counts=True)
        if not len(cell):
            continue
        owner, column = cell // columns, cell % columns
        latent = np.zeros((len(at), index.basis.shape[1]), np.float32)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        parts = index.basis[column]
        again = np.flatnonzero(times > 1)
        parts[again] *= times[again, None].astype(np.float32)
        latent[owner[first]] = np.add.reduceat(parts, first, axis=0)
        inner = latent @ index.query.T
        rest = np.bincount(owner, weights=(times * index.weight[column]) ** 2, minlength=len(at)) - np.sum(latent.astype(np.float64) ** 2, axis=1)
        wanted = cosine * cosine * index.norm
        bound = inner + np.sqrt(np.maximum(rest, 0))[:, None] * index.outside * (1 + SLACK)
        one, query = np.nonzero(bound >= wanted * (1 - SLACK))
        begin = np.searchsorted(owner, np.arange(len(at) + 1))
        cells = np.diff(begin)[one]
        which = np.repeat(np.arange(len(one)), cells)
        place = np.repeat(begin[one] - np.cumsum(cells) + cells, cells) + np.arange(len(which))
        spot = (column * len(index.query))[place] + np.repeat(query, cells)
        exact = np.bincount(which, weights=index.exact.reshape(-1).take(spot) * times[place], minlength=len(one))
        product = np.maximum(exact, inner[one, query])
        good = (product >= wanted[query] * (1 - SLACK)) & (product > 0)
        hit, query = one[good], query[good]
        cos = np.sqrt(product[good] / index.norm[query])
        item, row = index.query_item[query], hop_rows[at[hit]]
        begin = np.maximum(edge[row], bounds[at[hit]] - length[item])
        last = bounds[at[hit] + 1 + pair[at[hit]]]
        finish = np.minimum(edge[row + 1], last + length[item])
        enough = asked[finish] - asked[begin] >= np.minimum(need[item], passage_need[query])
        for k in np.flatnonzero(enough).tolist():
            j, r, score = int(item[k]), int(row[k]), float(cos[k])
            best = found[r].get(j)
            if best is not None and best["cosine"] >= score:
                continue
            text = hashes[begin[k]:finish[k]].tolist()
            present = set(text)
            q, share = int(query[k]), None
            # the whole text, or else the passage alone
            for words, answer, asks in ((index.item_words[j], index.answers[j], need[j]), (index.passage_words[q], index.passage_answers[q], passage_need[q])):
                if (share is None or share < least) and sum(w in present for w in answer) >= asks:
                    share = max(share or 0.0, common(words, text) / len(words))
            if share is not None and share >= least:
                found[r][j] = {"item_id": index.item_ids[j], "cosine": score, "common": share, "first": int(bounds[at[hit[k]]]), "last": int(last[k])}
    places = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)]) if any(found) else None
    out = []
    for row, hits in enumerate(found):
        zero = places[block.offsets[row]] if hits else 0
        out.append([{"item_id": h["item_id"], "cosine": h["cosine"], "common": h["common"], "start": int(places[starts[h["first"]]] - zero),
                     "end": int(places[ends[h["last"] - 1]] - zero)} for _, h in sorted(hits.items())])
    return out


def idf_of(count: np.ndarray, total: int) -> np.ndarray:
    return np.log((total + 1.0) / (count + 1.0)).astype(np.float32).clip(1e-3)


def item_blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple]]:
    """Benchmark texts in blocks of about ITEMS and PASSAGES, so that what is broadcast stays bounded."""
    rows = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL").distinct()
    words = F.size(F.split(F.trim("text"), r"\s+"))
    texts, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.lit(1), F.ceil(words / HOP) - 1)), F.lit(0))).first()
    n = max(1, -(-texts // ITEMS), -(-int(total) // PASSAGES))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.orderBy("id", "text").collect()]


def find(docs: DataFrame, index: Index, text_col: str = "text", cosine: float = COSINE, least: float = COMMON) -> DataFrame:
    """Each row of ``docs`` as the struct ``row`` with its ``matches``, at most one for each benchmark text."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("common", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [m for block in blocks(batch.column(1)) for m in search(block, shared.value, cosine, least)]
            yield pa.record_batch([batch.column(0), pa.array(found, kind)], ["row", "matches"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, "
                                "matches array<struct<item_id:long,cosine:double,common:double,start:long,end:long>>")


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
            item_text: str = "text") -> DataFrame:
    """``doc_id``, ``item_id``, ``cosine``, ``common``, ``start``, ``end`` of each benchmark text found in each document.

    ``cosine`` is that of the benchmark passage and those words of the document's passage that it has.  ``common`` is the
    share of the whole benchmark text, or, where that is too small, of its passage that was met.
    start and end (code points) are those of the passage that led to it.  Whole texts are searched, all documents
    against all benchmark texts.  Null and empty texts match nothing, nor do benchmark texts without a word or with a
    null id; repeated documents each get their rows, repeated benchmark texts count once; empty tables give no rows.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    idf = idf_of(*frequencies(slim, "text"))
    out = None
    for part in item_blocks(items, item_id, item_text):
        index = build(slim, part, idf, "doc_id", "text")
        if index is not None:
            rows = find(slim, index).where(F.size("matches") > 0).select("row.doc_id", F.inline("matches"))
            out = rows if out is None else out.union(rows)
    return out if out is not None else slim.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, common double, start long, end long")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark text is found, with all their columns.

    Null texts and rows with a null id stay; repeated rows stay or go together; without benchmark texts all rows stay.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    idf = idf_of(*frequencies(slim, "text"))
    for part in item_blocks(items, item_id, item_text):
        index = build(slim, part, idf, "doc_id", "text")
        if index is not None:
            docs = find(docs, index, text_col).where(F.size("matches") == 0).select("row.*")
    return docs
