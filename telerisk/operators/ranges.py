"""Ranks and running counts of rows over range partitions.

Rows are dealt once to ranges of (group, value, hash of the row) and written, so every range holds about the same
number of rows, however many of them share one value or one group.  Counts are taken inside each range; the totals of
the ranges carry over, and a value that fills several ranges is put together from its few edge cells.  No rows are
joined on their values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telerisk.session import materialise

RANGE = "_range"


def spread(df: DataFrame, order: Sequence[Column | str], purpose: str, ranges: int | None = None) -> DataFrame:
    """``df`` dealt to ranges of ``order`` and written, with ``_range``, which rises with the order.

    Boundaries come from a sample, so the dealt rows are written before anything reads them: a range must not move
    between two reads.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(ranges, *order).withColumn(RANGE, F.spark_partition_id()), purpose)


def row_hash(df: DataFrame) -> Column:
    """Hash of all columns that can be hashed; rows of one value fall apart by it."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")])


def earlier_totals(df: DataFrame, groups: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Per (group, range): totals of the group's earlier ranges (``_o_m``) and of the whole group (``m_total``)."""
    before = Window.partitionBy(*groups).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*groups, RANGE).agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    return sums.select(*groups, RANGE, *[F.coalesce(F.sum(f"_s_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures],
                       *[F.sum(f"_s_{m}").over(Window.partitionBy(*groups)).alias(f"{m}_total") for m in measures])


def merged_counts(df: DataFrame, groups: Sequence[str], value: str, measures: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Every row with totals of each measure over its group: at smaller values (``m_before``), at its own value (``m_here``), at all (``m_total``).

    Reference rows and rows to be ranked go through together; a row's measures say what it adds (0: it is only ranked).
    Measures and groups must not be NULL.  Rows with a NULL value keep NULL counts and must have measures of 0.
    """
    added = [f"{m}_{k}" for m in measures for k in ("before", "here", "total")]
    placed = spread(df.withColumn("_salt", row_hash(df)), [*groups, value, "_salt"], "ranks", ranges)
    part = Window.partitionBy(*groups, RANGE)
    upto, peers = part.orderBy(value), Window.partitionBy(*groups, RANGE, value)
    inner = placed.select("*", *[F.sum(m).over(upto).alias(f"_u_{m}") for m in measures],
                          *[F.sum(m).over(peers).alias(f"_h_{m}") for m in measures])
    # the least and the largest value of each (group, range) can go on in the neighbouring ranges
    ends = placed.where(F.col(value).isNotNull()).groupBy(*groups, RANGE).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    edges = (placed.where(F.col(value).isNotNull()).join(ends, [*groups, RANGE])
             .where((F.col(value) == F.col("_low")) | (F.col(value) == F.col("_high")))
             .groupBy(*groups, value, RANGE).agg(*[F.sum(m).alias(f"_s_{m}") for m in measures]))
    same = Window.partitionBy(*groups, value)
    past = same.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    split = edges.select(*groups, value, RANGE, F.count(F.lit(1)).over(same).alias("_ranges"),
                         *[F.coalesce(F.sum(f"_s_{m}").over(past), F.lit(0)).alias(f"_p_{m}") for m in measures],
                         *[F.sum(f"_s_{m}").over(same).alias(f"_a_{m}") for m in measures]).where(F.col("_ranges") > 1)
    out = inner.join(earlier_totals(placed, groups, measures), [*groups, RANGE]).join(split, [*groups, RANGE, value], "left")
    known = F.col(value).isNotNull()
    counts = []
    for m in measures:
        before = F.col(f"_o_{m}") + F.col(f"_u_{m}") - F.col(f"_h_{m}") - F.coalesce(f"_p_{m}", F.lit(0))
        counts += [F.when(known, before).alias(f"{m}_before"), F.when(known, F.coalesce(f"_a_{m}", f"_h_{m}")).alias(f"{m}_here"),
                   F.when(known, F.col(f"{m}_total")).alias(f"{m}_total")]
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in added], *counts)


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[str], out: str = "row_no", ranges: int | None = None) -> DataFrame:
    """Row number (from 1) inside each group by ``order``, however large the group; equal rows are numbered in any order."""
    placed = spread(df.withColumn("_one", F.lit(1)).withColumn("_salt", row_hash(df)), [*groups, *order, "_salt"], "numbers", ranges)
    inside = F.row_number().over(Window.partitionBy(*groups, RANGE).orderBy(*order, "_salt"))
    return (placed.withColumn("_inside", inside).join(earlier_totals(placed, groups, ["_one"]), [*groups, RANGE])
            .select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_inside") + F.col("_o__one")).alias(out)))
