"""Canonical tables: typed copies of the raw sources in which bad values become NULL.

A row is never dropped for a bad measure: an accident with a broken speed stays an accident.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telerisk.functions.columns import below_or_null, in_range_or_null, out_of_range

LAT, LNG, SPEED, COURSE = (-90.0, 90.0), (-180.0, 180.0), (0.0, 180.0), (0.0, 359.0)


def _id(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit(""))


def _whole(c: str, kind: str) -> Column:
    """Integer text, or decimal text rounded half away from zero."""
    return F.round(F.col(c).try_cast("double")).try_cast(kind)


def canonical_events(raw: DataFrame) -> DataFrame:
    lat, lng, speed = (F.col(c).try_cast("double") for c in ("lat", "lng", "speed"))
    return raw.select(
        _id("gpsno").alias("gpsno"), F.col("start_time").try_cast("timestamp_ntz").alias("event_ts"),
        _whole("event_type", "int").alias("event_type"), "event_name",
        in_range_or_null(lat, *LAT).alias("lat"), in_range_or_null(lng, *LNG).alias("lng"),
        in_range_or_null(speed, *SPEED).alias("speed"), out_of_range(lat, *LAT).alias("bad_lat"),
        out_of_range(lng, *LNG).alias("bad_lng"), out_of_range(speed, *SPEED).alias("bad_speed"), "source_file")


def canonical_trajectory(raw: DataFrame) -> DataFrame:
    number = lambda c: F.col(c).try_cast("double")
    return raw.select(
        _id("gpsno").alias("gpsno"), F.col("trigger_time").try_cast("timestamp_ntz").alias("ts"),
        _whole("distance", "bigint").alias("distance_cm"), _whole("run_time", "bigint").alias("run_time_s"),
        in_range_or_null(number("speed"), *SPEED).alias("speed"), in_range_or_null(number("course"), *COURSE).alias("course"),
        in_range_or_null(number("lat"), *LAT).alias("lat"), in_range_or_null(number("lng"), *LNG).alias("lng"), "source_file")


def canonical_imu(raw: DataFrame) -> DataFrame:
    number = lambda c: F.col(c).try_cast("double")
    axes = [below_or_null(number(f"{kind}_{a}_raw"), limit).alias(f"{kind[0]}{a}")
            for kind, limit in (("accel", 100.0), ("gyro", 10000.0)) for a in "xyz"]
    return raw.select(
        _id("gpsno").alias("gpsno"), F.trim("imei").alias("imei"),
        F.col("data_time").try_cast("timestamp_ntz").alias("ts"), _whole("data_date", "int").alias("data_date"),
        in_range_or_null(number("ems_speed"), *SPEED).alias("ems_speed"),
        in_range_or_null(number("gps_speed"), *SPEED).alias("gps_speed"), *axes, "source_file")
