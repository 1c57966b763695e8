"""Near-duplicates by SimHash: exact pairs within a Hamming radius from vantage-point trees.

Fingerprints take the majority of each bit over the XXH64 hashes of all word shingles.  Fingerprints
that differ in at most three bits differ in at most one bit in their low or in their high half, so two
trees with radius one, one over each half, find every pair; a full comparison confirms it.  A tree splits
by the distance to a vantage point: members go to one side, queries to each side that the triangle bound
cannot rule out.  The upper levels, grown on a bounded sample of fingerprints, deal fingerprints to
shards; every shard grows the rest of its tree over all its own members.  The sample only shapes the
shards: pairs are exact whatever it holds.  A shard with much work is split by its queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telerisk.llm.graph import components
from telerisk.llm.words import LOWER, SPACE, blocks, segments
from telerisk.session import materialise

HALF = np.uint64(32)
LOW = np.uint64(0xFFFFFFFF)
#: fingerprints that shape the upper tree, at most
TREE_SAMPLE = 16384
#: members of a shard aimed at, comparisons of one task at most, and of one brute-force step
SHARD, TASK_WORK, STEP_WORK = 1024, 1 << 26, 1 << 20


def block_fingerprints(block, shingle: int = 3, seed: int = 42) -> np.ndarray:
    starts, ends, rows = block.words()
    keep = ~SPACE[block.data]
    keep[1:] |= keep[:-1]
    place = np.cumsum(keep) - 1
    text = LOWER[block.data[keep]]
    text[SPACE[text]] = 0x20
    text = text.tobytes()
    first, count = segments(rows, block.rows)
    begin = place[starts] if len(starts) else starts
    finish = begin + (ends - starts)
    inner = np.flatnonzero(rows[:len(rows) - shingle + 1] == rows[shingle - 1:]) if len(rows) >= shingle else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < shingle))
    s = np.concatenate([begin[inner], begin[first[short]]])
    e = np.concatenate([finish[inner + shingle - 1], finish[first[short] + count[short] - 1]])
    row = np.concatenate([rows[inner], short])
    order = np.argsort(row, kind="stable")
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], seed) for a, b in zip(s[order].tolist(), e[order].tolist())), np.uint64, len(s))
    out = np.zeros(block.rows, np.uint64)
    first, count = segments(row[order], block.rows)
    full = np.flatnonzero(count)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > count[full][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, with ``fp`` (signed 64-bit); texts without a word have zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [block_fingerprints(b, shingle, seed) for b in blocks(batch.column(1))]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], ["row", "fp"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, fp long")


def distance(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to)


def choose_split(points: np.ndarray, radius: int, tries: int = 6) -> tuple[float, np.uint64, int]:
    """The vantage point and threshold with the least expected share of comparisons."""
    sample = points[:: max(1, len(points) // 512)]
    best = (1.0, np.uint64(0), 0)
    for vantage in sample[:: max(1, len(sample) // tries)][:tries]:
        d = distance(sample, vantage)
        middle = int(np.median(d))
        for t in (middle - 1, middle, middle + 1):
            inside = np.mean(d <= t)
            cost = inside * np.mean(d <= t + radius) + (1 - inside) * np.mean(d > t - radius)
            if cost < best[0]:
                best = (float(cost), vantage, t)
    return best


def grow(points: np.ndarray, depth: int, radius: int) -> list | None:
    """Upper tree as nested [vantage, threshold, near, far]; None is a shard."""
    if depth == 0 or len(points) < 32:
        return None
    cost, vantage, t = choose_split(points, radius)
    if cost > 0.9:
        return None
    near = distance(points, vantage) <= t
    return [int(vantage), t, grow(points[near], depth - 1, radius), grow(points[~near], depth - 1, radius)]


def route(tree: list | None, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shard number, indexes of its members, and indexes of the queries that may meet them."""
    stack, shard = [(tree, np.arange(len(points)), np.arange(len(points)))], 0
    while stack:
        node, members, queries = stack.pop()
        if node is None:
            yield shard, members, queries
            shard += 1
            continue
        vantage, t, near, far = node
        dm, dq = (distance(points[i], np.uint64(vantage)).astype(int) for i in (members, queries))
        stack.append((far, members[dm > t], queries[dq > t - radius]))
        stack.append((near, members[dm <= t], queries[dq <= t + radius]))


class Forest:
    """Union-find over array indexes, hooked in bulk."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def search(points: np.ndarray, members: np.ndarray, queries: np.ndarray, half: np.uint64, radius: int, bits: int, forest: Forest) -> None:
    """Link all (query, member) pairs within ``bits``, descending a tree over the members."""
    stack = [(members, queries)]
    while stack:
        m, q = stack.pop()
        if not len(m) or not len(q):
            continue
        if len(m) * len(q) > STEP_WORK and len(m) > 64:
            side = (points[m] >> half) & LOW
            cost, vantage, t = choose_split(side, radius)
            if cost < 0.8:
                dm = distance(side, vantage).astype(int)
                dq = distance((points[q] >> half) & LOW, vantage).astype(int)
                stack.append((m[dm <= t], q[dq <= t + radius]))
                stack.append((m[dm > t], q[dq > t - radius]))
                continue
        step = max(1, STEP_WORK // len(m))
        for k in range(0, len(q), step):
            part = q[k:k + step]
            i, j = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[m][None, :]) <= bits)
            forest.link(part[i], m[j])


def links(distinct: DataFrame, bits: int = 3) -> DataFrame:
    """Edges ``a``, ``b`` that connect all distinct fingerprints ``fp`` within ``bits``: every linked pair
    is joined by a path of edges, each of which ends in the same component; not all pairs are listed."""
    radius = bits // 2
    total = distinct.count()
    sample = np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp")).limit(TREE_SAMPLE).collect()], np.int64).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(max(1, total) / SHARD))))
    trees = [grow((sample >> h) & LOW, depth, radius) for h in (np.uint64(0), HALF)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for half, tree in enumerate(trees):
                side = (fp.view(np.uint64) >> np.uint64(32 * half)) & LOW
                for shard, members, queries in route(tree, side, radius):
                    n = len(members) + len(queries)
                    if n:
                        yield pa.record_batch([
                            pa.array(np.full(n, 2 * shard + half, np.int32)), pa.array(np.concatenate([fp[members], fp[queries]])),
                            pa.array(np.arange(n) < len(members))], ["shard", "fp", "member"])

    dealt = materialise(distinct.select("fp").mapInArrow(deal, "shard int, fp long, member boolean"), "shards")
    # a few numbers per shard; the shards are at most TREE_SAMPLE / 16
    work = dealt.groupBy("shard").agg(F.sum(F.col("member").cast("long")).alias("m"), F.count("*").alias("n"))
    parts = work.select("shard", F.greatest(F.lit(1), F.ceil(F.col("m") * (F.col("n") - F.col("m")) / TASK_WORK)).cast("int").alias("parts"))
    spread = dealt.join(F.broadcast(parts), "shard").withColumn(
        "part", F.explode(F.when(F.col("member"), F.sequence(F.lit(0), F.col("parts") - 1))
                          .otherwise(F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")))))

    def match(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy()
        member = group.column("member").to_numpy(zero_copy_only=False).astype(bool)
        points, index = np.unique(fp, return_inverse=True)
        forest = Forest(len(points))
        half = np.uint64(32 * (group.column("shard")[0].as_py() % 2))
        search(points.view(np.uint64), index[member], index[~member], half, radius, bits, forest)
        away = np.flatnonzero(forest.root != np.arange(len(points)))
        return pa.table({"a": points[away], "b": points[forest.root[away]]})

    return spread.select("shard", "part", "fp", "member").groupBy("shard", "part").applyInArrow(match, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42,
                    bits: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row of ``docs``.

    component_id is the smallest doc_id that can be reached over links of at most ``bits`` (3) differing bits.
    Copies count once: trees hold distinct fingerprints only.  Null and empty texts have fingerprint zero and
    are linked like any other; repeated rows each get their row; a null doc_id takes part in links but is
    never a component_id unless the component has no other.  Only the named columns are read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = materialise(fingerprints(slim, "text", shingle, seed).select("row.doc_id", "fp"), "fingerprints")
    return known.join(grouped(known, bits), "fp").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def grouped(known: DataFrame, bits: int) -> DataFrame:
    """``fp``, ``root`` (names the component) and ``component_id`` of each fingerprint in ``known(doc_id, fp)``."""
    distinct = materialise(known.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "distinct")
    roots = components(links(distinct, bits))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "smallest", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("smallest").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, bits: int = 3) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, with all its columns: that of the smallest doc_id.

    Of rows that share that id and fingerprint one stays.  Rows with a null id stay only where no other does.
    """
    shared = docs.groupBy(id_col).count().where("count > 1").limit(1).count() > 0
    known = materialise(fingerprints(docs, text_col, shingle, seed), "fingerprints")
    at = known.select(F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), "fp")
    last = F.lit((1 << 63) - 1)  # null ids come last
    first = at.select(F.coalesce("doc_id", last).alias("doc_id"), "fp").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    chosen = first.join(grouped(at, bits), "fp").groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("k")).select(
        F.col("k.doc_id").alias("_id"), F.col("k.fp").alias("_fp"))
    kept = known.withColumn("_id", F.coalesce(F.col(f"row.`{id_col}`").cast("long"), last)).withColumnRenamed("fp", "_fp").join(chosen, ["_id", "_fp"])
    return (kept.dropDuplicates(["_id", "_fp"]) if shared else kept).select("row.*")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
