"""Robust scalers: fitted parameters are one row per feature, quantiles are exact."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telerisk.functions.columns import clip, is_finite, signed_log
from telerisk.operators.ordered import (interpolate, metric_quantiles, order_pairs, quantile_cells, running_totals)
from telerisk.session import materialise

# fixed values: suffixes and names of count-like columns
COUNT_SUFFIXES = ("_count", "_episodes", "_rows", "_samples", "_windows")
COUNT_NAMES = ("trip_starts", "trajectory_rows", "moving_rows", "long_gap_rows")


#: the metric of the scaler's cells that counts rows
ROWS = "_rows_of_train"


def is_count_feature(name: str) -> bool:
    return name.endswith(COUNT_SUFFIXES) or name in COUNT_NAMES


def feature_frame(spark: SparkSession, features: Sequence[str], booleans: Sequence[str] = ()) -> DataFrame:
    """One row per feature, with its count-like and boolean flags."""
    rows = [F.struct(F.lit(f).alias("feature"), F.lit(is_count_feature(f) and f not in booleans).alias("count_like"),
                     F.lit(f in booleans).alias("boolean")) for f in features]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("_x")).select("_x.*")


def long_features(df: DataFrame, keys: Sequence[str], features: Sequence[str], packed: bool = False) -> DataFrame:
    """Unpivot wide numeric or boolean features; non-finite values become NULL.

    ``packed`` keeps one row, with the values as an array in the order of ``features``: nothing has to be shuffled to
    bring the cells of a row together again.
    """
    finite = lambda v: F.when(is_finite(v), v)
    if packed:
        return df.select(*keys, F.transform(F.array(*[F.col(f).cast("double") for f in features]), finite).alias("value"))
    items = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]
    long = df.select(*keys, F.explode(F.array(*items)).alias("_x")).select(*keys, "_x.*")
    return long.withColumn("value", finite(F.col("value")))


def _beside(packed: DataFrame, params: DataFrame, features: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Every packed row with the parameters of all features, ``_params``, in their order: one small row is broadcast."""
    row = F.struct(*names)
    listed = params.agg(F.array(*[F.max(F.when(F.col("feature") == f, row)) for f in features]).alias("_params"))
    return packed.crossJoin(F.broadcast(listed))  # one row


def _scale_iqr(value: Column, params: Callable[[str], Column], limit: float | None) -> Column:
    positive = F.when(value > 0, value).when(value.isNotNull(), 0.0)
    v = F.when(params("log1p"), F.log1p(positive)).otherwise(value)
    scaled = F.coalesce((clip(v, params("low"), params("high")) - params("median")) / params("scale"), F.lit(0.0))
    return scaled if limit is None else clip(scaled, -limit, limit)


def _scale_std(value: Column, params: Callable[[str], Column], transform) -> tuple[Column, Column]:
    v = clip(transform(value), params("low"), params("high"))
    return F.coalesce((v - params("median")) / params("scale"), F.lit(0.0)), v.isNull().cast("int")


def fit_iqr_scaler(train: DataFrame, features: Sequence[str], booleans: Sequence[str] = (),
                   unit_floor: bool = False) -> DataFrame:
    """log1p for counts, clip to 1%..99%, median and interquartile range.

    A range below 1e-6 becomes 1 (or, with ``unit_floor``, every range is at least 1).  Log
    and clip are monotone, so all five quantiles come from one pass over the order statistics.  The
    cells are written once, so ``train`` is read once.
    """
    cells = materialise(quantile_cells(train, [], features), "scaler-cells")
    ranked = running_totals(cells, ["metric"], "value", ["n"])
    points = {"p01": 0.01, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p99": 0.99}
    pairs = order_pairs(ranked, ["metric"], "value", {n: (None, p) for n, p in points.items()},
                        {"n_values": F.max("n_total"), "smallest": F.min("value")})
    logged = F.col("count_like") & (F.col("smallest") >= 0)
    move = lambda c: F.when(logged, F.log1p(c)).otherwise(c)
    low, high = interpolate("p01", move), interpolate("p99", move)
    bounded = lambda c: clip(move(c), F.col("low"), F.col("high"))
    stats = (feature_frame(train.sparkSession, features, booleans)
             .join(pairs.withColumnRenamed("metric", "feature"), "feature", "left")
             .withColumn("low", low).withColumn("high", high)
             .withColumn("median", interpolate("p50", bounded))
             .withColumn("iqr", interpolate("p75", bounded) - interpolate("p25", bounded)))
    spread = (F.greatest(F.col("iqr"), F.lit(1.0)) if unit_floor
              else F.when(F.col("iqr") >= 1e-6, F.col("iqr")).otherwise(1.0))
    seen = F.col("n_values").isNotNull()
    fixed = lambda flag, value, other: F.when(F.col("boolean"), F.lit(flag)).when(seen, value).otherwise(F.lit(other))
    return stats.select("feature", F.coalesce(logged & ~F.col("boolean"), F.lit(False)).alias("log1p"), "boolean",
                        fixed(0.0, F.col("low"), 0.0).alias("low"), fixed(1.0, F.col("high"), 0.0).alias("high"),
                        fixed(0.0, F.col("median"), 0.0).alias("median"), fixed(1.0, spread, 1.0).alias("scale"),
                        F.coalesce("n_values", F.lit(0)).alias("observed"))


def apply_iqr_scaler(long: DataFrame, params: DataFrame, limit: float | None = None,
                     features: Sequence[str] | None = None) -> DataFrame:
    """Scaled values and the observed mask; missing cells are 0.  ``params`` has one row per feature.

    With ``features``, ``long`` holds packed rows (``long_features``) and both results are arrays in that order.
    """
    keep = [c for c in long.columns if c != "value"]
    if features is not None:
        rows = _beside(long, params, features, ["log1p", "low", "high", "median", "scale"])
        scaled = F.zip_with("value", "_params", lambda v, p: _scale_iqr(v, lambda n: p[n], limit))
        return rows.select(*keep, scaled.alias("scaled"), F.transform("value", lambda v: v.isNotNull().cast("int")).alias("observed"))
    return (long.join(params, "feature")
            .select(*keep, _scale_iqr(F.col("value"), F.col, limit).alias("scaled"), F.col("value").isNotNull().cast("int").alias("observed")))


def fit_std_scaler(train: DataFrame, features: Sequence[str], transform=signed_log) -> DataFrame:
    """Signed log, clip to 1%..99%, median, population deviation of the median-filled values."""
    moved = train.select(*[transform(f).alias(f) for f in features])
    # the number of rows travels with the cells, so that ``train`` is read once
    counted = quantile_cells(moved.withColumn(ROWS, F.lit(0.0)), [], [*features, ROWS])
    written = materialise(counted, "scaler-cells")
    cells = written.where(F.col("metric") != ROWS)
    ranked = running_totals(cells, ["metric"], "value", ["n"])
    pairs = order_pairs(ranked, ["metric"], "value",
                        {"p01": (None, 0.01), "p50": (None, 0.5), "p99": (None, 0.99)})
    bounds = (pairs.withColumn("low", interpolate("p01")).withColumn("high", interpolate("p99"))
              .withColumn("median", interpolate("p50", lambda c: clip(c, F.col("low"), F.col("high"))))
              .select("metric", "low", "high", "median"))
    size = (written.where(F.col("metric") == ROWS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_rows"))
            .select("_rows", F.explode(F.array(*[F.lit(f) for f in features])).alias("metric")))
    away = clip(F.col("value"), F.col("low"), F.col("high")) - F.col("median")
    fitted = bounds.join(size, "metric")
    moments = (cells.join(F.broadcast(fitted), "metric").groupBy("metric", "low", "high", "median", "_rows")
               .agg(F.sum(F.col("n") * away).alias("_s"), F.sum(F.col("n") * away * away).alias("_ss"),
                    F.sum("n").alias("observed")))
    mean = F.col("_s") / F.col("_rows")
    deviation = F.sqrt(F.greatest(F.col("_ss") / F.col("_rows") - mean * mean, F.lit(0.0)))
    fitted = moments.withColumn("_sd", deviation)
    names = feature_frame(train.sparkSession, features).select("feature")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return (names.join(fitted.withColumnRenamed("metric", "feature"), "feature", "left")
            .select("feature", zero("low"), zero("high"), zero("median"),
                    F.when(F.col("_sd") > 1e-6, F.col("_sd")).otherwise(1.0).alias("scale"),
                    F.coalesce("observed", F.lit(0)).alias("observed")))


def apply_std_scaler(long: DataFrame, params: DataFrame, transform=signed_log, features: Sequence[str] | None = None) -> DataFrame:
    """Median-filled standardised values and a missing indicator; with ``features`` packed, as in ``apply_iqr_scaler``."""
    names = ["low", "high", "median", "scale"]
    keep = [c for c in long.columns if c != "value"]
    if features is not None:
        rows = _beside(long, params, features, names)
        part = lambda i: F.zip_with("value", "_params", lambda v, p: _scale_std(v, lambda n: p[n], transform)[i])
        return rows.select(*keep, part(0).alias("scaled"), part(1).alias("missing"))
    scaled, missing = _scale_std(F.col("value"), F.col, transform)
    return long.join(params.select("feature", *names), "feature").select(*keep, scaled.alias("scaled"), missing.alias("missing"))


def fit_code_scale(long: DataFrame, present: Column | None, metrics: Sequence[str], floor: float = 0.05,
                   logged: bool = True) -> DataFrame:
    """99% scale of every (code, metric), at least ``floor``; over active rows only if ``present``."""
    rows = long if present is None else long.where(present)
    items = [F.struct(F.lit(m).alias("metric"), (F.log1p(F.col(m)) if logged else F.col(m)).cast("double").alias("value"))
             for m in metrics]
    values = rows.select("event_code", F.explode(F.array(*items)).alias("_x")).select("event_code", "_x.*")
    p99 = metric_quantiles(values, ["event_code", "metric"], "value", {"p99": 0.99})
    return p99.select("event_code", "metric", F.greatest(F.col("p99"), F.lit(floor)).alias("scale"),
                      F.col("n_values").alias("observed"))


@dataclass(frozen=True)
class RobustScaler:
    """Fitted transform that round-trips through a small Parquet table."""

    params: DataFrame
    kind: str = "std"

    @classmethod
    def fit(cls, train: DataFrame, features: Sequence[str], kind: str = "std", **options) -> "RobustScaler":
        fit = fit_std_scaler if kind == "std" else fit_iqr_scaler
        return cls(fit(train, features, **options), kind)

    def transform(self, long: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
        apply = apply_std_scaler if self.kind == "std" else apply_iqr_scaler
        return apply(long, self.params, features=features)

    def describe(self) -> DataFrame:
        return self.params.withColumn("kind", F.lit(self.kind))

    def save(self, path: str) -> None:
        self.describe().write.mode("errorifexists").parquet(path)

    @classmethod
    def from_description(cls, table: DataFrame, features: Sequence[str] | None = None) -> "RobustScaler":
        kinds = [r[0] for r in table.select("kind").distinct().limit(2).collect()]
        if len(kinds) != 1:
            raise ValueError("a saved scaler holds exactly one kind")
        if features is not None:
            saved = {r[0] for r in table.select("feature").limit(len(features) + 1).collect()}
            if saved != set(features):
                raise ValueError("the saved scaler was fitted on other features")
        return cls(table.drop("kind"), kinds[0])
