"""Mixing sources to target weights by proportional-fair (Pfair) scheduling.

A source's rows form blocks.  While a source of weight w is active, its block j may start at slot floor((j - 1) / w)
and must end by slot ceil(j / w); in each slot the eligible block with the earliest deadline goes.  On one processor
that meets every deadline, so after t slots a source has had more than w t - 1 and less than w t + 1 blocks.

Weights are taken as they are, as exact fractions, so the bound holds for a schedule of any length.  Which block goes
depends on all blocks before, so one task walks the slots, one step for each block, holding one entry for each source,
and hands the slots on in chunks; Spark brings each bucket of rows the slots of its blocks.  When a source has no block
left, the others go on in a new phase with their weights scaled up.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice
from math import gcd, lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: the most sources that can be mixed
UNITS = 1024
#: blocks of a source whose slots are handed on as one row
CHUNK = 64
#: rows of a numbering bucket aimed at
BUCKET = 4_000
OUTPUTS = ("mix_block", "mix_slot", "mix_place")


def shares(weights: Mapping[str, float], units: int = UNITS) -> dict[str, int]:
    """Whole parts of ``units``, at least one each, nearest to the weights (largest remainders)."""
    total = sum(weights.values())
    exact = {k: Fraction(w).limit_denominator(10**9) / Fraction(total).limit_denominator(10**9) * (units - len(weights)) for k, w in weights.items()}
    out = {k: 1 + int(x) for k, x in exact.items()}
    short = sorted(weights, key=lambda k: (int(exact[k]) - exact[k], k))
    for k in short[:units - sum(out.values())]:
        out[k] += 1
    return out


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[tuple[str, int, int]]:
    """(source, block from 0, slot) of every block, in the order of the slots.

    Sources of weight 0 come when no other has a block left, all alike.
    """
    done = {k: 0 for k, n in blocks.items() if n > 0}
    slot = 0
    while left := [k for k in done if done[k] < blocks[k]]:
        exact = {k: Fraction(weights[k]) for k in left if weights[k] > 0} or dict.fromkeys(left, Fraction(1))
        common = lcm(*(x.denominator for x in exact.values()))
        part = {k: int(x * common) for k, x in exact.items()}
        total, start, first = sum(part.values()), slot, dict(done)
        # the next block of each source: not yet released, and ready by deadline
        waiting: list = []
        ready = [(-(-total // n), k) for k, n in part.items()]
        heapq.heapify(ready)
        while True:
            while waiting and waiting[0][0] <= slot - start:
                heapq.heappush(ready, heapq.heappop(waiting)[1:])
            deadline, k = heapq.heappop(ready)
            if deadline <= slot - start:
                raise ArithmeticError("a deadline was missed")
            yield k, done[k], slot
            slot += 1
            done[k] += 1
            if done[k] == blocks[k]:
                break
            j = done[k] - first[k]
            heapq.heappush(waiting, (j * total // part[k], -(-(j + 1) * total // part[k]), k))


def period(parts: Mapping[str, int]) -> list[tuple[str, int, int]]:
    """(source, block from 0, slot) over one period of earliest-deadline-first scheduling."""
    common = gcd(*parts.values())
    return list(islice(schedule({k: n // common + 1 for k, n in parts.items()}, parts), sum(parts.values()) // common))


def chunks(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[tuple[str, int, list[int]]]:
    """(source, chunk, slots of its CHUNK blocks; the last chunk of a source may be shorter)."""
    slots: dict[str, list[int]] = {k: [] for k in blocks}
    for k, block, slot in schedule(blocks, weights):
        slots[k].append(slot)
        if len(slots[k]) == CHUNK or block + 1 == blocks[k]:
            yield k, block // CHUNK, slots[k]
            slots[k] = []


def planned(spark: SparkSession, blocks: Mapping[str, int], weights: Mapping[str, float]) -> DataFrame:
    """``source``, ``chunk`` and ``slots`` of :func:`chunks`, walked in one task and never held as a whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            rows = chunks(blocks, weights)
            while part := list(islice(rows, 1024)):
                source, chunk, slots = zip(*part)
                yield pa.record_batch([pa.array(source, pa.string()), pa.array(chunk, pa.int64()), pa.array(slots, pa.list_(pa.int64()))], ["source", "chunk", "slots"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "source string, chunk long, slots array<long>")


def numbered(docs: DataFrame, plan: DataFrame, block_rows: int, id_col: str, source_col: str) -> DataFrame:
    """``row`` (a struct), ``source``, ``block``, ``slot`` and ``place`` (from 0) in a fixed pseudo-random order of each source.

    Rows are numbered inside buckets of a hash of the id, and the buckets' totals carry over, so no task holds a source.
    A bucket holds consecutive blocks of a source; their slots come with its total.
    """
    buckets = max(1, docs.count() // BUCKET)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
                       F.xxhash64(id_col).alias("key"), F.col(id_col).alias("id")).withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    before = rows.groupBy("source", "bucket").count().select("source", "bucket", "count", F.coalesce(F.sum("count").over(
        Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    block_of = lambda place: F.floor(place / block_rows).cast("long")
    spans = before.withColumn("first", block_of(F.col("before"))).withColumn("last", block_of(F.col("before") + F.col("count") - 1))
    chunk_of = lambda block: F.floor(F.col(block) / CHUNK).cast("long")
    parts = spans.withColumn("chunk", F.explode(F.sequence(chunk_of("first"), chunk_of("last")))).join(plan, ["source", "chunk"])
    listed = parts.groupBy("source", "bucket", "before", "first", "last").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("chunk", "slots"))), lambda x: x["slots"])).alias("slots"))
    listed = listed.select("source", "bucket", "before", "first", F.slice(
        "slots", (F.col("first") % CHUNK + 1).cast("int"), (F.col("last") - F.col("first") + 1).cast("int")).alias("slots"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id")
    at = rows.withColumn("n", F.row_number().over(inside) - 1).join(listed, ["source", "bucket"])
    place = F.col("before") + F.col("n")
    return at.select("row", "source", block_of(place).alias("block"), F.element_at("slots", (block_of(place) - F.col("first") + 1).cast("int")).alias("slot"),
                     (place % block_rows).cast("int").alias("place"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, block_rows: int = 16,
        id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with ``mix_block`` (of its source), ``mix_slot`` (of the mix) and ``mix_place`` (in the block).

    Reading in the order of (mix_slot, mix_place) gives every row once, and any prefix holds each source that still
    has blocks to within one block of its target weight.  Without ``weights`` they are the sources' sizes to the given
    power; sources that ``weights`` lacks get its smallest weight, and those of weight 0 come last.  A null source is the source ''; null and repeated
    ids and repeated rows keep a row each; an empty table gives an empty mix.  Columns of docs that bear an output's
    name are replaced.  More than 1,024 sources raise ValueError.
    """
    # one row per source, and no more than UNITS of them may come
    sizes = {r[0]: r[1] for r in docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit(""))).count().limit(UNITS + 1).collect()}
    if len(sizes) > UNITS:
        raise ValueError(f"more than {UNITS} sources")
    if weights is None:
        target = {k: float(n) ** power for k, n in sizes.items()}
    else:
        target = {k: float(weights.get(k, min(weights.values()))) for k in sizes}
    if any(w < 0 for w in target.values()):
        raise ValueError("a weight is negative")
    # the sources' names and sizes go into the task; its rows are one for CHUNK blocks
    plan = planned(docs.sparkSession, {k: -(-n // block_rows) for k, n in sizes.items()}, target)
    out = numbered(docs, plan, block_rows, id_col, source_col)
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in OUTPUTS], F.col("block").alias("mix_block"),
                      F.col("slot").alias("mix_slot"), F.col("place").alias("mix_place"))
