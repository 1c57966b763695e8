"""Order-dependent measures of groups of any size.

A group (one entity, one metric, one model) may hold a third of all rows, so nothing here
sorts a whole group in one task.  Rows are first reduced to distinct cells with counts
(map-side combine merges copies), cells are split into value bins and bins that are too full into
parts of their own range, running totals are taken inside each part, and the totals of the parts
carry them over.  Quantiles, ROC-AUC and average precision all come from those running totals and are
exact.  Ranks and percentiles of rows come from range partitions (``ranges``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telerisk.functions.columns import is_finite
from telerisk.operators.ranges import merged_counts, numbered

BINS_PER_DOUBLING = 128
_SHIFT = 1100 * BINS_PER_DOUBLING


def value_bin(value: Column) -> Column:
    """Monotone bin of a double: 128 bins per doubling, mirrored below zero."""
    step = F.floor(F.log2(F.abs(value)) * BINS_PER_DOUBLING) + F.lit(_SHIFT)
    # never NULL: a nullable bin would gain a filter on one join side and split the shared exchange
    return F.coalesce(F.when(value > 0, step).when(value < 0, -step), F.lit(0)).cast("long")


#: distinct values of one bin, about; a fuller bin is split
BIN_CELLS = 20_000


def binned(cells: DataFrame, groups: Sequence[str], value: str, target: int | None = None) -> DataFrame:
    """``cells`` with ``_bin`` and ``_part``, ordered as the values are.

    A bin that holds more than ``target`` values is cut into equal parts of the range its own values span, so a
    metric with a narrow spread, or with outliers far away, still falls into many parts.  The table of such bins has
    at most one row per ``target`` cells.
    """
    target = target or BIN_CELLS
    coarse = cells.withColumn("_bin", value_bin(F.col(value)))
    full = (coarse.groupBy(*groups, "_bin").agg(F.count(F.lit(1)).alias("_size"), F.min(value).alias("_low"), F.max(value).alias("_high"))
            .where(F.col("_size") > target))
    place = (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))
    part = F.coalesce(F.floor(place * F.ceil(F.col("_size") / F.lit(target))), F.lit(0)).cast("long")
    return coarse.join(full, [*groups, "_bin"], "left").select(*cells.columns, "_bin", part.alias("_part"))


def running_totals(cells: DataFrame, groups: Sequence[str], value: str, measures: Sequence[str]) -> DataFrame:
    """Per cell: total of each measure before it (``m_before``) and in its group (``m_total``).

    ``cells`` holds one row per (groups, value); group keys must not be NULL.  Running totals are taken inside
    bins of values, and the totals of the bins carry over.
    """
    parts = binned(cells, groups, value)
    keys = [*groups, "_bin", "_part"]
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*groups).orderBy("_bin", "_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    bins = (parts.groupBy(*keys).agg(*[F.sum(m).alias(f"_b_{m}") for m in measures])
            .select(*keys,
                    *[F.coalesce(F.sum(f"_b_{m}").over(earlier), F.lit(0)).alias(f"_o_{m}") for m in measures],
                    *[F.sum(f"_b_{m}").over(whole).alias(f"{m}_total") for m in measures]))
    inner = parts.select("*", *[(F.sum(m).over(inside) - F.col(m)).alias(f"_i_{m}") for m in measures])
    return inner.join(bins, keys).select(
        *cells.columns,
        *[(F.col(f"_i_{m}") + F.col(f"_o_{m}")).alias(f"{m}_before") for m in measures],
        *[f"{m}_total" for m in measures],
    )


def order_pairs(ranked: DataFrame, groups: Sequence[str], value: str,
                wanted: Mapping[str, tuple[Column | None, float]], carry: Mapping[str, Column] | None = None
                ) -> DataFrame:
    """Both order statistics around each wanted quantile (``_lo_*``, ``_hi_*``) and the weight ``_f_*``.

    Monotone transforms (log, clip) may be applied to the pair before interpolating, so one
    pass serves quantiles of transformed values too.
    """
    aggregates = []
    for name, (condition, p) in wanted.items():
        h = (F.col("n_total") - 1) * F.lit(float(p))
        k = F.floor(h)
        up = F.least(k + 1, F.col("n_total") - 1)
        here = (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
        after = (F.col("n_before") <= up) & (up < F.col("n_before") + F.col("n"))
        if condition is not None:
            here, after = condition & here, condition & after
        aggregates += [
            F.max(F.when(here, F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when(after, F.col(value))).alias(f"_hi_{name}"),
            F.max(F.when(here, h - k)).alias(f"_f_{name}"),
        ]
    aggregates += [c.alias(n) for n, c in (carry or {}).items()]
    return ranked.groupBy(*groups).agg(*aggregates)


def interpolate(name: str, transform=lambda c: c) -> Column:
    low, high = transform(F.col(f"_lo_{name}")), transform(F.col(f"_hi_{name}"))
    return low + (high - low) * F.col(f"_f_{name}")


def quantile_of_cells(ranked: DataFrame, groups: Sequence[str], value: str,
                      wanted: Mapping[str, tuple[Column | None, float]], carry: Mapping[str, Column] | None = None
                      ) -> DataFrame:
    """Linearly interpolated quantiles from cells with ``n``, ``n_before``, ``n_total``.

    ``wanted`` maps an output name to (row condition or None, probability).
    """
    pairs = order_pairs(ranked, groups, value, wanted, carry)
    return pairs.select(*groups, *[interpolate(n).alias(n) for n in wanted], *list(carry or {}))


def quantile_cells(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long (keys, metric, value, n): distinct finite values of several columns, pre-counted.

    Rows are counted by the column's number, which is cheaper to hash than its name; the cells then take the name.
    """
    pairs = F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("_no", "value")
    cells = df.select(*keys, pairs).where(is_finite("value")).groupBy(*keys, "_no", "value").agg(F.count(F.lit(1)).alias("n"))
    return cells.select(*keys, F.array(*[F.lit(c) for c in columns])[F.col("_no")].alias("metric"), "value", "n")


HOT_CELLS = 100_000


def quantiles_per_key(cells: DataFrame, keys: Sequence[str], specs: Mapping[str, tuple[str, float]],
                      hot_cells: int = HOT_CELLS) -> DataFrame:
    """Exact quantiles per key from pre-counted (keys, metric, value, n) cells.

    Keys with at most ``hot_cells`` cells go through one hash aggregate whose buffers that
    limit bounds.  Larger keys, of which there can be only cells/``hot_cells``, are ranked by
    running totals, which never hold a key in one task.
    """
    hot = (cells.groupBy(*keys).agg(F.count_if(F.col("n") > 0).alias("_size"))
           .where(F.col("_size") > hot_cells).select(*keys))
    plain = [F.percentile(F.when(F.col("metric") == c, F.col("value")), p, F.col("n")).alias(name)
             for name, (c, p) in specs.items()]
    small = cells.join(hot, list(keys), "left_anti").groupBy(*keys).agg(*plain)
    ranked = running_totals(cells.join(hot, list(keys), "left_semi"), [*keys, "metric"], "value", ["n"])
    wanted = {name: (F.col("metric") == c, p) for name, (c, p) in specs.items()}
    return small.unionByName(quantile_of_cells(ranked, list(keys), "value", wanted))


def grouped_quantiles(df: DataFrame, keys: Sequence[str], specs: Mapping[str, tuple[str, float]],
                      hot_cells: int = HOT_CELLS) -> DataFrame:
    """Exact quantiles per key: ``specs`` maps output name to (column, probability).

    Keys with no finite value at all are absent; keys must not be NULL.
    """
    columns = list(dict.fromkeys(c for c, _ in specs.values()))
    return quantiles_per_key(quantile_cells(df, keys, columns), keys, specs, hot_cells)


Stage = Callable[[DataFrame, str], DataFrame]


def staged(df: DataFrame, stage: Stage | None, purpose: str) -> DataFrame:
    """Write-once hook: at scale, a table read by several branches is written and read back."""
    return df if stage is None else stage(df, purpose)


def summarise(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], aggregates: Mapping[str, Column],
              specs: Mapping[str, tuple[str, float]], stage: Stage | None = None, reread: bool = False) -> DataFrame:
    """Ordinary aggregates and exact quantiles of the same groups.

    With ``stage``, rows are counted by key first.  The rows of ordinary keys are dealt by key once, as they are, and
    everything is aggregated where they arrive; keys with more than ``HOT_CELLS`` values are brought down to cells
    instead (``summarise_cells``), so that no key is held in one task.  The rows are written for that by ``stage``, unless
    ``reread`` says that they are as cheap to read again.  Without ``stage`` the plan is lazy and all keys go
    through cells.  Quantiles of NULL keys are NULL.
    """
    if stage is None:
        return summarise_cells(df, keys, inputs, aggregates, specs)
    columns = list(dict.fromkeys(c for c, _ in specs.values()))
    rows = df.select(*keys, *dict.fromkeys((*inputs, *columns)))
    rows = rows if reread else stage(rows, "rows")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    hot = stage(sizes.where(F.col("_size") * len(columns) > HOT_CELLS).select(*keys), "hot-keys")
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])

    def quantile(column: str, p: float) -> Column:
        value = F.col(column).cast("double")
        return F.percentile(F.when(is_finite(value) & known, value), p)

    def whole(part: DataFrame) -> DataFrame:
        return part.repartition(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[a.alias(name) for name, a in aggregates.items()],
                                                          *[quantile(c, p).alias(name) for name, (c, p) in specs.items()])

    if hot.isEmpty():
        return whole(rows)
    hot = F.broadcast(hot)  # each has many rows, so there are few
    return whole(rows.join(hot, list(keys), "left_anti")).unionByName(
        summarise_cells(rows.join(hot, list(keys), "left_semi"), keys, inputs, aggregates, specs, stage))


def summarise_cells(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], aggregates: Mapping[str, Column],
                    specs: Mapping[str, tuple[str, float]], stage: Stage | None = None) -> DataFrame:
    """``summarise`` for groups of any size.

    Every row contributes one entry with the aggregate ``inputs`` and one entry per quantile
    column, grouped by (keys, metric, value) with map-side combine.  Both results come from that cell table, which
    ``stage`` writes once.  Keys must not be NULL.
    """
    columns = list(dict.fromkeys(c for c, _ in specs.values()))
    kinds = {i: df.schema[i].dataType for i in inputs}
    whole = F.struct(F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"),
                     *[F.col(i).alias(f"in_{i}") for i in inputs])
    parts = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"),
                      *[F.lit(None).cast(k).alias(f"in_{i}") for i, k in kinds.items()]) for c in columns]
    rows = (df.select(*keys, F.explode(F.array(whole, *parts)).alias("_e"))
            .select(*keys, "_e.metric", "_e.value", *[F.col(f"_e.in_{i}").alias(i) for i in inputs])
            .where(F.col("metric").isNull() | is_finite("value")))
    cells = staged(rows.groupBy(*keys, "metric", "value").agg(
        F.count(F.lit(1)).alias("n"), *[a.alias(name) for name, a in aggregates.items()]), stage, "cells")
    sums = cells.where(F.col("metric").isNull()).select(*keys, "n", *aggregates)
    found = cells.where(F.col("metric").isNotNull()).select(*keys, "metric", "value", "n")
    return sums.join(quantiles_per_key(found, keys, specs), list(keys), "left")


def metric_quantiles(long: DataFrame, groups: Sequence[str], value: str, probabilities: Mapping[str, float]) -> DataFrame:
    """Exact quantiles of a long (groups, value) table, one row per group, with the count ``n_values``."""
    cells = (long.where(is_finite(value)).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n")))
    ranked = running_totals(cells, groups, value, ["n"])
    return quantile_of_cells(ranked, groups, value, {n: (None, p) for n, p in probabilities.items()},
                             {"n_values": F.max("n_total")})


def percentile_against(long: DataFrame, groups: Sequence[str], value: str, is_reference: str,
                       out: str = "percentile", mid_rank: bool = False, where: Column | None = None) -> DataFrame:
    """Share of reference rows at or below each value (or the mid-rank share).

    Adds ``out`` to every row of ``long``; rows outside ``where`` get 0 and take no part in
    the reference.  A group without reference rows also gets 0.  Reference and scored rows are
    merged by ranges of the value; nothing is joined on it.
    """
    selected = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    marked = long.withColumn("_key", F.when(selected & is_finite(value), F.col(value).cast("double")))
    counted = F.col("_key").isNotNull() & F.coalesce(F.col(is_reference).cast("boolean"), F.lit(False))
    ranked = merged_counts(marked.withColumn("_n", F.when(counted, 1).otherwise(0)), groups, "_key", ["_n"])
    inclusive = F.col("_n_before") + F.col("_n_here")
    share = (F.col("_n_before") + inclusive) / (2.0 * F.col("_n_total")) if mid_rank else inclusive / F.col("_n_total").cast("double")
    return ranked.select(*long.columns, F.when(F.col("_n_total") > 0, share).otherwise(0.0).alias(out))


def rank_by_value(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Adds ``rank_asc``, ``rank_desc`` (minimum ranks), ``mid_rank`` and ``rank_pct`` per group; NULL where the value is not finite."""
    keyed = df.withColumn("_key", F.when(is_finite(value), F.col(value))).withColumn("_n", F.when(F.col("_key").isNotNull(), 1).otherwise(0))
    before, here, total = (F.col(f"_n_{k}") for k in ("before", "here", "total"))
    middle = before + (here + 1) / F.lit(2.0)
    return merged_counts(keyed, groups, "_key", ["_n"]).select(
        *df.columns, (before + 1).alias("rank_asc"), (total - before - here + 1).alias("rank_desc"), middle.alias("mid_rank"), (middle / total).alias("rank_pct"))


def number_by_hash(df: DataFrame, groups: Sequence[str], hex_text: str, out: str = "row_no") -> DataFrame:
    """Row number in the order of a text, however large the group: rows are dealt to ranges whose sizes carry over."""
    return numbered(df, groups, [hex_text], out)


def top_fraction(df: DataFrame, value: str, fraction: float, key: str, largest: bool = True) -> DataFrame:
    """The floor(N*fraction) rows with the largest (smallest) values; ties ordered by md5(key).

    Only the distinct values are ranked.  Their edge is one row, by which the rows are filtered; rows tied at it are numbered.
    """
    signed = (-F.col(value) if largest else F.col(value)) + F.lit(0.0)
    rows = df.withColumn("_v", signed).withColumn("_all", F.lit(0)).where(F.col("_v").isNotNull())
    cells = merged_counts(rows.groupBy("_all", "_v").agg(F.count(F.lit(1)).alias("_n")), ["_all"], "_v", ["_n"])
    room = F.floor(F.col("_n_total") * F.lit(float(fraction))) - F.col("_n_before")
    full = F.col("_n_here") <= F.col("_room")
    edge = cells.withColumn("_room", room).where(F.col("_room") > 0).groupBy("_all").agg(
        F.max(F.when(full, F.col("_v"))).alias("_last"), F.max(F.when(~full, F.col("_v"))).alias("_tie"),
        F.max(F.when(~full, F.col("_room"))).alias("_room"))
    placed = rows.join(F.broadcast(edge), "_all")  # one row
    ties = placed.where(F.col("_v") == F.col("_tie")).withColumn("_hex", F.md5(F.col(key).cast("string")))
    tied = number_by_hash(ties, ["_v"], "_hex", "_no").where(F.col("_no") <= F.col("_room"))
    return placed.where(F.col("_v") <= F.col("_last")).select(*df.columns).unionByName(tied.select(*df.columns))


def lag_across_slices(df: DataFrame, keys: Sequence[str], order: str, slice_of: Column,
                      columns: Sequence[str], out: str = "_prev") -> DataFrame:
    """Previous row of each key as a struct, without sorting a whole key in one task.

    Rows are windowed per (key, slice); the first row of a slice takes the last row of the
    nearest earlier slice from a table with one row per (key, slice).  ``order`` must be
    unique per key, ``slice_of`` must not decrease along it, and none of them may be NULL.
    """
    payload = F.struct(order, *columns)
    # the same NOT NULL filters on both branches let them share one upstream exchange
    for c in (*keys, order):
        df = df.where(F.col(c).isNotNull())
    sliced = df.withColumn("_slice", F.coalesce(slice_of, F.lit(0)))
    inside = Window.partitionBy(*keys, "_slice").orderBy(order)
    along = Window.partitionBy(*keys).orderBy("_slice")
    # the last row of each slice, by the window that the lag below takes
    lasts = sliced.withColumn("_next", F.lead(order).over(inside)).where(F.col("_next").isNull())
    edges = lasts.select(*keys, "_slice", payload.alias("_last")).select(*keys, "_slice", F.lag("_last").over(along).alias("_carry"))
    here = sliced.withColumn(out, F.lag(payload).over(inside))
    return (here.join(edges, [*keys, "_slice"], "left")
            .withColumn(out, F.coalesce(F.col(out), F.col("_carry"))).drop("_slice", "_carry"))
