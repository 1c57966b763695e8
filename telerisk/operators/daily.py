"""Dense entity-day calendar with as-of coverage, and its derived day features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telerisk import codes
from telerisk.functions.columns import counted_sql, is_finite
from telerisk.session import large

TRAJECTORY_FIELDS = (
    "trajectory_rows", "moving_rows", "distance_valid_rows", "distance_invalid_rows",
    "distance_without_runtime_rows", "distance_km", "drive_hours", "gps_distance_check_km", "trip_starts",
    "night_distance_km", "speed_p50", "speed_p90", "speed_change_p90", "turn_rate_p90", "long_gap_rows")
IMU_FIELDS = (
    "imu_valid_windows", "imu_valid_samples", "imu_ems_missing_samples", "imu_gps_missing_samples",
    "imu_accel_p95_median", "imu_accel_peak_p99", "imu_accel_variability_p90", "imu_gyro_p95_p90",
    "imu_gyro_peak", "imu_speed_p50")


def entity_coverage(clean_events: DataFrame | None = None, trajectory: DataFrame | None = None,
                    imu: DataFrame | None = None) -> list[DataFrame]:
    """First/last day and totals per source, each one row per entity."""
    out = []
    if clean_events is not None:
        out.append(clean_events.groupBy("gpsno").agg(
            F.min(F.to_date("event_ts")).alias("event_first_day"),
            F.max(F.to_date("event_ts")).alias("event_last_day"), F.count(F.lit(1)).alias("event_rows")))
    if trajectory is not None:
        out.append(trajectory.groupBy("gpsno").agg(
            F.min("day").alias("trajectory_first_day"), F.max("day").alias("trajectory_last_day"),
            F.sum("trajectory_rows").alias("trajectory_rows"), F.count(F.lit(1)).alias("trajectory_days")))
    if imu is not None:
        out.append(imu.groupBy("gpsno").agg(
            F.min("day").alias("imu_first_day"), F.max("day").alias("imu_last_day"),
            F.sum("imu_valid_samples").alias("imu_valid_samples"), F.count(F.lit(1)).alias("imu_days")))
    return out


def coverage(profile: DataFrame, clean_events: DataFrame, trajectory: DataFrame, imu: DataFrame) -> DataFrame:
    """Profile with the coverage of every source; entities without a source keep NULL days."""
    ev, tr, im = entity_coverage(clean_events, trajectory, imu)
    return (profile.select("gpsno", "energy_type").join(large(ev), "gpsno", "left").join(large(tr), "gpsno", "left")
            .join(large(im), "gpsno", "left")
            .select("gpsno", "energy_type",
                    F.col("event_first_day").isNotNull().alias("has_event_feed"),
                    F.col("trajectory_first_day").isNotNull().alias("has_trajectory"),
                    F.col("imu_first_day").isNotNull().alias("has_imu"),
                    "event_first_day", "event_last_day", "event_rows",
                    "trajectory_first_day", "trajectory_last_day", "trajectory_rows", "trajectory_days",
                    "imu_first_day", "imu_last_day", "imu_valid_samples", "imu_days"))


def calendar(entities: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Entity x day rows: a fixed sequence exploded per entity, no join and no shuffle."""
    days = F.sequence(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"), F.expr("interval 1 day"))
    return entities.select("*", F.explode(days).alias("day"))


def seen_by(first: str) -> Column:
    """Has the source been seen on or before the calendar day?  Never back-filled."""
    return F.coalesce(F.col(first) <= F.col("day"), F.lit(False))


def assemble(cover: DataFrame, events: DataFrame, trajectory: DataFrame, imu: DataFrame,
             first_day: str, last_day: str, wanted: Sequence[int] = codes.EVENT_CODES) -> DataFrame:
    """Dense entity-day table that keeps "not observed" (NULL) apart from "nothing happened" (0).

    Only the measures present in ``trajectory`` and ``imu`` are carried.
    """
    grid = calendar(cover.select("gpsno", "energy_type", "event_first_day", "trajectory_first_day", "imu_first_day"),
                    first_day, last_day)
    grid = grid.select("gpsno", "day", "energy_type", seen_by("event_first_day").alias("has_event_feed"),
                       seen_by("trajectory_first_day").alias("has_trajectory"), seen_by("imu_first_day").alias("has_imu"))
    wide = (grid.join(large(events.withColumn("_e", F.lit(True))), ["gpsno", "day"], "left")
            .join(large(trajectory.withColumn("_t", F.lit(True))), ["gpsno", "day"], "left")
            .join(large(imu.withColumn("_i", F.lit(True))), ["gpsno", "day"], "left"))
    feed = F.col("has_event_feed")
    counts = ["event_total_count", "event_total_episodes", "event_other_count"]
    counts += [f"event_{c}_{kind}" for c in wanted for kind in ("count", "episodes")]
    total = F.coalesce("event_total_count", F.lit(0))
    p90 = ["event_speed_p90"] if "event_speed_p90" in events.columns else []
    return wide.select(
        "gpsno", "day", "energy_type", "has_event_feed", "has_trajectory", "has_imu",
        F.col("_e").isNotNull().alias("event_recorded_today"),
        F.col("_t").isNotNull().alias("trajectory_recorded_today"),
        F.col("_i").isNotNull().alias("imu_recorded_today"),
        (F.col("_t").isNotNull() & (F.coalesce("moving_rows", F.lit(-1)) == 0)).alias("observed_stationary_day"),
        *[F.expr(f"if(has_event_feed, coalesce({c}, 0), null) AS {c}") for c in counts], *p90,
        *[c for c in TRAJECTORY_FIELDS if c in trajectory.columns],
        *[c for c in IMU_FIELDS if c in imu.columns],
        F.when((F.col("distance_km") > 0) & feed, 100.0 * total / F.col("distance_km")).alias("events_per_100km"),
        F.when((F.col("drive_hours") > 0) & feed, total / F.col("drive_hours")).alias("events_per_drive_hour"))


def with_day_index(daily: DataFrame, first_day: str) -> DataFrame:
    return daily.withColumn("day_index", F.datediff("day", F.lit(first_day).cast("date")) + 1)


def day_table(daily: DataFrame, first_day: str, wanted: Sequence[int] = codes.EVENT_CODES) -> DataFrame:
    """Day index, zero-filled counts and the smoothed exposure rate 100*count/(km+100) per code."""
    km_ok = "abs(distance_km) < double('Infinity') AND distance_km >= 0"
    events = []
    for c in wanted:
        n = counted_sql(f"event_{c}_count")
        events += [f"{n} AS event_{c}_count", f"{counted_sql(f'event_{c}_episodes')} AS event_{c}_episodes",
                   f"if({km_ok}, 100 * {n} / (distance_km + 100), 0D) AS event_{c}_rate100_smooth"]
    numeric = [c for c in codes.DAY_NUMERIC if c in daily.columns]
    return with_day_index(daily, first_day).selectExpr("gpsno", "day", "day_index", *events, *numeric, *codes.DAY_QUALITY)


def unpivot_codes(daily: DataFrame, wanted: Sequence[int] = codes.EVENT_CODES, keep: Sequence[str] = (),
                  only_active: bool = False) -> DataFrame:
    """Long (gpsno, day_index, event_code, n, episodes): one scan, no shuffle."""
    items = ", ".join(f"named_struct('event_code', {c}, 'n', {counted_sql(f'event_{c}_count')}, "
                      f"'episodes', {counted_sql(f'event_{c}_episodes')})" for c in wanted)
    long = daily.selectExpr("gpsno", "day_index", *keep, f"inline(array({items}))")
    return long.where((F.col("n") > 0) | (F.col("episodes") > 0)) if only_active else long


def event_node_features(table: DataFrame, wanted: Sequence[int] = codes.EVENT_CODES, packed: bool = False,
                        keep: Sequence[str] = ()) -> DataFrame:
    """Eight features of every (entity, day, code): logs of counts and rates, occurrence, exposure.

    ``packed``: one row per entity-day with its codes as the array ``nodes`` of (event_code, features).  ``keep``: further
    columns of the table that come along.
    """
    km, hours, night = F.col("distance_km"), F.col("drive_hours"), F.col("night_distance_km")
    km_ok, hour_ok = is_finite(km) & (km >= 0), is_finite(hours) & (hours >= 0)
    items = ", ".join(f"named_struct('event_code', {c}, 'n', event_{c}_count, 'episodes', event_{c}_episodes, "
                      f"'rate', event_{c}_rate100_smooth)" for c in wanted)
    share = F.when(km_ok & (km > 0), F.greatest(F.least(F.greatest(night, F.lit(0.0)) / km, F.lit(1.0)), F.lit(0.0)))
    day = table.select("gpsno", "day_index", *keep,
                       F.coalesce(km_ok, F.lit(False)).cast("int").alias("km_observed"),
                       F.coalesce(hour_ok, F.lit(False)).cast("int").alias("hours_observed"),
                       F.when(hour_ok, hours).otherwise(0.0).alias("_hours"),
                       F.coalesce(share, F.lit(0.0)).alias("night_share"), F.expr(f"array({items})").alias("_nodes"))

    def features(x: Column) -> list[Column]:
        return [x["event_code"].alias("event_code"), F.log1p(x["n"]).alias("log_count"),
                F.log1p(x["episodes"]).alias("log_episodes"), F.log1p(x["rate"]).alias("log_rate_100km"),
                F.log1p(x["n"] / (F.col("_hours") + 1.0)).alias("log_rate_hour"),
                (x["n"] > 0).cast("int").alias("occurred"), *[F.col(c).alias(c) for c in ("km_observed", "hours_observed", "night_share")]]

    if packed:
        return day.select("gpsno", "day_index", *keep, F.transform("_nodes", lambda x: F.struct(*features(x))).alias("nodes"))
    return day.withColumn("_x", F.explode("_nodes")).select("gpsno", "day_index", *keep, *features(F.col("_x")))
