"""Trajectory operators: best fix per instant, step features, entity-day summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telerisk.functions.columns import circular_degrees, epoch_second, haversine_km
from telerisk.operators.ordered import Stage, lag_across_slices, summarise


@dataclass(frozen=True)
class StepRules:
    """Limits of the step features (seconds, km/h)."""

    moving_speed: float = 3.0
    short_gap: int = 10
    fallback_gap: int = 30
    position_gap: int = 60
    trip_gap: int = 600
    long_gap: int = 60
    max_implied_speed: float = 160.0
    speed_tolerance: float = 20.0
    runtime_slack: int = 2
    slice_seconds: int = 3600


def best_fix(df: DataFrame) -> DataFrame:
    """One fix per (entity, instant): most complete first, then file, then the remaining values.

    A window over the few copies of an instant: an aggregate over structs would sort all fixes twice.
    """
    rest = [c for c in df.columns if c not in ("gpsno", "ts", "source_file")]
    complete = (F.col("speed").isNotNull().cast("int")
                + (F.col("lat").isNotNull() & F.col("lng").isNotNull()).cast("int"))
    copies = Window.partitionBy("gpsno", "ts").orderBy(complete.desc(), "source_file", *rest)
    return (df.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") == 1)
            .select("gpsno", "ts", "source_file", *rest))


def with_steps(fixes: DataFrame, rules: StepRules = StepRules()) -> DataFrame:
    """Adds gap, implied speed, validity flags, distance/time, trip start and rate features."""
    second = epoch_second("ts")
    lagged = lag_across_slices(fixes, ["gpsno"], "ts", F.floor(second / rules.slice_seconds),
                               ["speed", "course", "lat", "lng"])
    prev = lambda name: F.col(f"_prev.{name}")
    speed, gap, cm, run = F.col("speed"), F.col("gap_s"), F.col("distance_cm"), F.col("run_time_s")
    implied = F.col("implied_speed")
    short = gap.between(1, rules.short_gap)
    steps = (lagged
             .withColumn("gap_s", second - epoch_second(prev("ts")))
             .withColumn("implied_speed", F.when((cm >= 0) & (run > 0), 3.6 * cm / (100.0 * run)))
             .withColumn("valid_zero", (cm == 0) & (run == 0))
             .withColumn("valid_increment",
                         (cm > 0) & (run > 0) & (gap > 0) & (run <= gap + rules.runtime_slack)
                         & (implied <= rules.max_implied_speed)
                         & (speed.isNull()
                            | (F.abs(implied - speed) <= F.greatest(F.lit(rules.speed_tolerance), 0.5 * implied))))
             .withColumn("valid_fallback",
                         speed.isNotNull() & (speed > rules.moving_speed) & gap.between(1, rules.fallback_gap)))
    zero, inc, back = F.col("valid_zero"), F.col("valid_increment"), F.col("valid_fallback")
    return steps.select(
        *fixes.columns, "gap_s", "implied_speed", "valid_zero", "valid_increment", "valid_fallback",
        F.when(zero, 0.0).when(inc, cm / 100000.0).when(back, speed * gap / 3600.0).alias("distance_km"),
        F.when(inc, run / 3600.0).when(back, gap / 3600.0).alias("drive_hours"),
        F.when((speed > rules.moving_speed)
               & (prev("speed").isNull() | (prev("speed") <= rules.moving_speed) | (gap > rules.trip_gap)), 1)
        .otherwise(0).alias("trip_start"),
        F.when(short, F.abs(speed - prev("speed")) / gap).alias("speed_change_per_s"),
        F.when(short, circular_degrees(F.col("course"), prev("course")) / gap).alias("turn_deg_per_s"),
        F.when(gap.between(1, rules.position_gap),
               haversine_km(prev("lat"), prev("lng"), F.col("lat"), F.col("lng"))).alias("gps_step_km"),
    )


def trajectory_daily(steps: DataFrame, rules: StepRules = StepRules(), stage: Stage | None = None) -> DataFrame:
    """The fifteen entity-day trajectory measures, in one pass over the steps."""
    km, night = F.col("distance_km"), F.col("is_night")
    hour = F.hour("ts")
    keyed = steps.withColumn("day", F.to_date("ts")).withColumn("is_night", (hour < 6) | (hour >= 22))
    inputs = ["speed", "distance_km", "drive_hours", "gps_step_km", "trip_start", "distance_cm", "run_time_s", "gap_s", "is_night"]
    aggregates = {
        "moving_rows": F.count_if(F.col("speed") > rules.moving_speed),
        "distance_valid_rows": F.count("distance_km"),
        "distance_without_runtime_rows": F.count_if((F.col("distance_cm") > 0) & (F.col("run_time_s") == 0)),
        "distance_km": F.sum(km), "drive_hours": F.sum("drive_hours"), "gps_distance_check_km": F.sum("gps_step_km"),
        "trip_starts": F.sum("trip_start"), "night_distance_km": F.sum(F.when(night, km).otherwise(0.0)),
        "long_gap_rows": F.count_if(F.col("gap_s") > rules.long_gap)}
    quantiles = {"speed_p50": ("speed", 0.5), "speed_p90": ("speed", 0.9),
                 "speed_change_p90": ("speed_change_per_s", 0.9), "turn_rate_p90": ("turn_deg_per_s", 0.9)}
    out = summarise(keyed, ["gpsno", "day"], inputs, aggregates, quantiles, stage)
    return out.select("gpsno", "day", F.col("n").alias("trajectory_rows"), *aggregates,
                      (F.col("n") - F.col("distance_valid_rows")).alias("distance_invalid_rows"), *quantiles)
