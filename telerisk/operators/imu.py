"""Motion-sensor operators: short windows and their entity-day rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telerisk.functions.columns import epoch_second, magnitude
from telerisk.operators.ordered import Stage, summarise

WINDOW_KEYS = ("gpsno", "imei", "day", "window_id")


def motion_samples(canonical: DataFrame, window_s: int = 10) -> DataFrame:
    """Norms, preferred speed and the tumbling window of every sample (no device id is '')."""
    return canonical.select(
        "gpsno", F.coalesce("imei", F.lit("")).alias("imei"), "ts", F.to_date("ts").alias("day"),
        F.floor(epoch_second("ts") / window_s).alias("window_id"),
        F.coalesce("ems_speed", "gps_speed").alias("speed"), "ems_speed", "gps_speed",
        magnitude("ax", "ay", "az").alias("accel_norm"), magnitude("gx", "gy", "gz").alias("gyro_norm"))


def imu_windows(samples: DataFrame, minimum: int = 3, stage: Stage | None = None) -> DataFrame:
    """Window summary of the samples, which are read twice with ``stage``; windows with too few samples are dropped."""
    aggregates = {
        "valid_accel_samples": F.count("accel_norm"), "valid_gyro_samples": F.count("gyro_norm"),
        "ems_missing_samples": F.count_if(F.col("ts").isNotNull() & F.col("ems_speed").isNull()),
        "gps_missing_samples": F.count_if(F.col("ts").isNotNull() & F.col("gps_speed").isNull()),
        "window_span": F.max("ts") - F.min("ts"), "accel_norm_max": F.max("accel_norm"),
        "accel_norm_std": F.stddev_samp("accel_norm"), "gyro_norm_max": F.max("gyro_norm")}
    quantiles = {"accel_norm_p95": ("accel_norm", 0.95), "gyro_norm_p95": ("gyro_norm", 0.95), "speed_p50": ("speed", 0.5)}
    out = summarise(samples, list(WINDOW_KEYS), ["ts", "accel_norm", "gyro_norm", "ems_speed", "gps_speed"],
                    aggregates, quantiles, stage, reread=True)
    return out.withColumnRenamed("n", "sample_count").where(
        (F.col("sample_count") >= minimum) & (F.col("valid_accel_samples") >= minimum) & (F.col("valid_gyro_samples") >= minimum))


def imu_daily(windows: DataFrame, stage: Stage | None = None) -> DataFrame:
    """Quantiles of window quantiles per entity-day (exact, not mergeable); with ``stage`` the windows are read twice."""
    aggregates = {
        "imu_valid_samples": F.sum("sample_count"), "imu_ems_missing_samples": F.sum("ems_missing_samples"),
        "imu_gps_missing_samples": F.sum("gps_missing_samples"), "imu_gyro_peak": F.max("gyro_norm_max")}
    quantiles = {
        "imu_accel_p95_median": ("accel_norm_p95", 0.5), "imu_accel_peak_p99": ("accel_norm_max", 0.99),
        "imu_accel_variability_p90": ("accel_norm_std", 0.9), "imu_gyro_p95_p90": ("gyro_norm_p95", 0.9),
        "imu_speed_p50": ("speed_p50", 0.5)}
    out = summarise(windows, ["gpsno", "day"], ["sample_count", "ems_missing_samples", "gps_missing_samples", "gyro_norm_max"],
                    aggregates, quantiles, stage, reread=True)
    return out.withColumnRenamed("n", "imu_valid_windows")
