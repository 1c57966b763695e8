"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

A vector is taken relative to the nearest of a few centroids, rotated into ``bits`` dimensions, and kept as the
signs of its components, its length, and the inner product of its direction with its signs.  A query's inner
product with the signs, divided by that scalar, estimates its inner product with the vector without bias; the
error is within ``sureness * sqrt((1 - f^2) / f^2 / (bits - 1))`` but for a vanishing share of cases.  The exact
distance is worked out, on the original vectors, only where the estimate less its error could still enter a
query's list.

The index holds each distinct vector once, with its smallest ids: no more than k + 1 ids of a vector can be
among the k nearest of any query.  So a vector that a third of all rows share costs no more than any other.
Queries go in blocks of a bounded size, each against the whole index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telerisk.session import materialise

#: vectors that the centroids and the first bounds of queries come from, at most
SAMPLE = 16384
#: queries of one pass over the index; pairs of a query and a vector in one step
QUERIES, STEP = 4096, 1 << 21


@dataclass
class Codes:
    """Rotation, centroids and the confidence of the bounds: all that a code depends on."""

    turn: np.ndarray
    centroids: np.ndarray
    sureness: float

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        near = (self.centroids ** 2).sum(1) - 2 * x @ self.centroids.T
        return near.argmin(1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, length, share of the direction that lies along its signs, and packed signs of each row."""
        cell = self.cells(x)
        rest = x - self.centroids[cell]
        length = np.sqrt((rest ** 2).sum(1))
        turned = rest @ self.turn
        along = np.abs(turned).sum(1) / np.sqrt(self.bits) / np.where(length > 0, length, 1)
        return cell, length, np.where(length > 0, along, 1.0), np.packbits(turned > 0, axis=1)

    def bounds(self, packed: np.ndarray, length: np.ndarray, along: np.ndarray, query: np.ndarray, away: np.ndarray) -> np.ndarray:
        """Lower bounds of squared distances of the vectors (rows) of one cell to turned queries ``away`` from its centroid."""
        signs = np.unpackbits(packed, axis=1, count=self.bits).astype(np.float32) * 2 - 1
        product = signs @ (query.T / np.sqrt(self.bits)).astype(np.float32) / along[:, None]
        error = self.sureness * np.sqrt(np.maximum(1 - along ** 2, 0) / along ** 2 / max(self.bits - 1, 1)) + 1e-5
        at_most = np.minimum(product + error[:, None] * away[None], away[None])
        return length[:, None] ** 2 + away[None] ** 2 - 2 * length[:, None] * at_most


def fit(sample: np.ndarray, bits: int, cells: int, sureness: float, seed: int, rounds: int = 5) -> Codes:
    if bits < sample.shape[1] or bits % 8:
        raise ValueError("a code has whole bytes and at least one bit for each dimension")
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.standard_normal((bits, sample.shape[1])))[0].T
    codes = Codes(turn, sample[rng.permutation(len(sample))[:cells]], sureness)
    for _ in range(rounds):
        cell = codes.cells(sample)
        n = np.bincount(cell, minlength=len(codes.centroids))
        total = np.zeros_like(codes.centroids)
        np.add.at(total, cell, sample)
        codes.centroids = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], codes.centroids)
    return codes


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, the squares added one after the other."""
    out = np.empty(len(a))
    for i in range(0, len(a), 1 << 15):
        out[i:i + (1 << 15)] = np.sqrt(np.cumsum((a[i:i + (1 << 15)] - b[i:i + (1 << 15)]) ** 2, axis=1)[:, -1])
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``key`` (digest of the vector), ``vec_id``, ``dim`` and ``vector`` of the rows that take part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector = batch.column(1)
            at = vector.offsets.to_numpy() - vector.offsets[0].as_py() if batch.num_rows else np.zeros(1, int)
            flat = vector.flatten().to_numpy(zero_copy_only=False) + 0.0  # one form of zero
            key = [blake2b(flat[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at[:-1], at[1:])]
            yield pa.record_batch([pa.array(key, pa.binary()), *batch.columns], ["key", "vec_id", "vector", "dim"])

    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & fine).withColumn("dim", F.size("vector"))
    return rows.mapInArrow(run, "key binary, vec_id long, vector array<double>, dim int")


def sample_of(index: DataFrame) -> np.ndarray:
    """At most SAMPLE vectors, those with the smallest digests."""
    rows = index.select("key", "vector").orderBy("key").limit(SAMPLE).toArrow()
    return matrix(rows.column("vector").combine_chunks())


def merge(best: list[np.ndarray], more: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k first entries by (distance, smallest id) of each query, from entries (query, distance, smallest id, vector)."""
    q, d, first, v = (np.concatenate(x) for x in zip(best, more))
    order = np.lexsort((v, first, d, q))
    place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
    return [x[order][place < k] for x in (q, d, first, v)]


def nothing() -> list[np.ndarray]:
    return [np.zeros(0, t) for t in (np.int64, float, np.int64, np.int64)]


def search_block(index: DataFrame, codes: Codes, keys: np.ndarray, queries: np.ndarray, limit: np.ndarray, k: int) -> DataFrame:
    """``query`` (digest), ``d``, ``key`` and ``ids``: the k nearest vectors of each query that a task holds, within its limit."""
    shared = index.sparkSession.sparkContext.broadcast((codes, keys, queries, limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, keys, queries, limit = shared.value
        limit = limit.copy()
        away = [np.sqrt(((queries - c) ** 2).sum(1)) for c in codes.centroids]
        turned = [(queries - c) @ codes.turn for c in codes.centroids]
        best, held, seen = nothing(), {}, 0
        for batch in batches:
            key, ids, vector, cell, length, along, packed = (batch.column(i) for i in range(7))
            x, length, along = matrix(vector), length.to_numpy(), along.to_numpy()
            packed = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(x), -1)
            cell, number = cell.to_numpy(), np.arange(seen, seen + len(x))
            found, first = nothing(), pc.list_element(ids, 0).to_numpy()
            for c in np.unique(cell):
                rows = np.flatnonzero(cell == c)
                for part in np.array_split(rows, -(-len(rows) * len(queries) // STEP)):
                    # the triangle bound of the whole part, then that of each pair
                    near = np.flatnonzero((away[c] - length[part].max() <= limit) & (length[part].min() - away[c] <= limit))
                    low = codes.bounds(packed[part], length[part], along[part], turned[c][near], away[c][near])
                    r, q = np.nonzero(low <= (limit[near] ** 2)[None] * (1 + 1e-9) + 1e-12)
                    r, q = part[r], near[q]
                    d = distances(x[r], queries[q])
                    kept = d <= limit[q]
                    found = merge(found, [q[kept], d[kept], first[r[kept]], number[r[kept]]], k)
                    full = np.flatnonzero(np.bincount(found[0], minlength=len(queries)) == k)
                    limit[full] = np.minimum(limit[full], found[1][np.searchsorted(found[0], full, "right") - 1])
            best = merge(best, found, k)
            held = {n: held[n] if n < seen else (key[n - seen].as_py(), ids[n - seen].as_py()) for n in np.unique(best[3]).tolist()}
            seen += len(x)
            full = np.flatnonzero(np.bincount(best[0], minlength=len(queries)) == k)
            limit[full] = np.minimum(limit[full], best[1][np.searchsorted(best[0], full, "right") - 1])
        for i in range(0, len(best[0]), 1 << 14):
            q, d, _, v = (x[i:i + (1 << 14)] for x in best)
            yield pa.record_batch([pa.array([keys[j] for j in q], pa.binary()), pa.array(d), pa.array([held[n][0] for n in v.tolist()], pa.binary()),
                                   pa.array([held[n][1] for n in v.tolist()], pa.list_(pa.int64()))], ["query", "d", "key", "ids"])

    rows = index.select("key", "ids", "vector", "cell", "length", "along", "code").mapInArrow(run, "query binary, d double, key binary, ids array<long>")
    first = Window.partitionBy("query").orderBy("d", F.col("ids")[0], "key")
    return rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)


def neighbours(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, bits: int | None = None, cells: int = 16, sureness: float = 3.0,
               seed: int = 42, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``: the k rows of ``vectors`` at the smallest Euclidean distance.

    ``queries`` are rows of the same form; without them, all rows of ``vectors`` are queries.  A row with the
    query's own id is no candidate.  Ties go to the smaller id; where there are fewer than k candidates, all are
    returned.  Rows without an id, and vectors that are null, zero, or hold null or non-finite components, take no
    part; vectors meet only those of their own length.  Equal rows count once; different vectors with one id are rows
    of their own.  Empty tables give no rows.  Columns beside the id and the vector are not read.

    ``bits`` (two for each dimension by default, in whole bytes) and ``sureness`` set how many exact distances are worked
    out, and how unlikely it is that a neighbour's bound lies wrong.  Centroids and each query's first limit come from at
    most SAMPLE vectors; the codes cover all of them.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors, id_col, vector_col).distinct(), "vectors")
    if queries is None:
        asked = rows
    else:
        asked = materialise(usable(queries, id_col, vector_col).select("key", "vec_id", "vector", "dim").distinct(), "asked")
    place = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    distinct = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("key", "dim").agg(
        F.array_sort(F.collect_list("vec_id")).alias("ids"), F.any_value("vector").alias("vector"))
    distinct = materialise(distinct, "distinct")
    found = []
    for dim, in sorted(asked.select("dim").distinct().collect()):
        index = distinct.where(F.col("dim") == dim)
        sample = sample_of(index)
        if not len(sample):
            continue
        codes = fit(sample, bits or -(-2 * dim // 8) * 8, cells, sureness, seed)
        found += search(encoded(index, codes), asked.where(F.col("dim") == dim), codes, sample, k)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    near = reduce(DataFrame.union, found).select("query", "d", F.explode("ids").alias("vec_id"))
    # per distinct query no more than (k + 1) vectors with (k + 1) ids each
    lists = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("d", "vec_id"))).alias("near"))
    own = asked.select(F.col("key").alias("query"), F.col("vec_id").alias("query_id"))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.join(lists, "query").select("query_id", F.posexplode(others).alias("at", "one")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "one.vec_id", F.col("one.d").alias("score"))


def encoded(index: DataFrame, codes: Codes) -> DataFrame:
    """The index with cell, length, scalar and packed signs, sorted by cell inside each part, written once."""
    shared = index.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, length, along, packed = shared.value.encode(matrix(batch.column(2)))
                yield pa.record_batch([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(length), pa.array(along),
                                       pa.array([r.tobytes() for r in packed], pa.binary())], ["key", "ids", "vector", "cell", "length", "along", "code"])

    schema = "key binary, ids array<long>, vector array<double>, cell int, length double, along double, code binary"
    return materialise(index.select("key", "ids", "vector").mapInArrow(run, schema).sortWithinPartitions("cell"), "codes")


def search(index: DataFrame, asked: DataFrame, codes: Codes, sample: np.ndarray, k: int) -> list[DataFrame]:
    """The k + 1 nearest distinct vectors of each distinct query vector, by blocks of QUERIES."""
    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1)) if batch.num_rows else np.zeros((0, 1))
            limit = np.full(len(x), np.inf)
            if len(shared.value) > k:
                for i in range(0, len(x), 64):
                    square = (x[i:i + 64] ** 2).sum(1)[:, None] + (shared.value ** 2).sum(1)[None] - 2 * x[i:i + 64] @ shared.value.T
                    at = np.argpartition(square, k, axis=1)[:, :k + 1]
                    exact = distances(np.repeat(x[i:i + 64], k + 1, axis=0), shared.value[at.ravel()])
                    limit[i:i + 64] = exact.reshape(at.shape).max(1)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(limit)], ["key", "vector", "reach"])

    shared = index.sparkSession.sparkContext.broadcast(sample)
    wanted = asked.groupBy("key").agg(F.any_value("vector").alias("vector")).mapInArrow(limits, "key binary, vector array<double>, reach double")
    total = asked.select("key").distinct().count()
    blocks = -(-total // QUERIES)
    wanted = materialise(wanted.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(max(blocks, 1)))), "queries")
    found = []
    for block in range(blocks):
        part = wanted.where(F.col("block") == block).toArrow()
        if part.num_rows:
            keys, limit = part.column("key").to_pylist(), part.column("reach").to_numpy()
            found.append(materialise(search_block(index, codes, keys, matrix(part.column("vector").combine_chunks()), limit, k + 1), "near"))
    return found
