"""Telematics views over the driver tables (Spark side).

Entities are customers, their event log is ``events``; codes, fixes and sensor samples are
derived from event columns by plain arithmetic, so an oracle can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from telerisk import codes
from telerisk.operators import daily as D
from telerisk.operators import episodes as E
from telerisk.plans.preprocess import Period
from telerisk.session import materialise

PERIOD = Period("2024-01-01", "2024-01-30", ("2024-01-10", "2024-01-14", "2024-01-20", "2024-01-30"), "2024-01-30",
                horizon=10, lookback=20)
LAST_DAY = 30
HORIZON = 10
ANCHORS = (14, 20, 24)
SCORE_ANCHORS = tuple(range(14, LAST_DAY + 1))
GAP_S = 86400
UNLISTED = 99999
DEVELOPMENT_MOD = 13

#: the numeric and boolean columns of the entity-day table, as ``files.numeric_features`` finds them
MODEL_FEATURES = (
    "has_event_feed", "has_trajectory", "has_imu", "event_recorded_today", "trajectory_recorded_today", "imu_recorded_today",
    "observed_stationary_day", "event_total_count", "event_total_episodes", "event_other_count",
    *[f"event_{c}_{k}" for c in codes.EVENT_CODES for k in ("count", "episodes")],
    "trajectory_rows", "moving_rows", "distance_valid_rows", "distance_invalid_rows", "distance_km", "drive_hours",
    "trip_starts", "night_distance_km", "speed_p50", "speed_p90", "speed_change_p90", "turn_rate_p90", "long_gap_rows",
    "imu_valid_windows", "imu_valid_samples", "imu_accel_peak_p99", "imu_accel_variability_p90", "imu_gyro_peak",
    "events_per_100km", "events_per_drive_hour")
FLAGS = MODEL_FEATURES[:7]
NUMBERS = MODEL_FEATURES[7:]

_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; the schema is read from the footer once per path."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def profile(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("gpsno"),
                                               F.col("c_mktsegment").alias("energy_type"))


def _code() -> Column:
    members = F.array(*[F.lit(c) for c in (*codes.EVENT_CODES, UNLISTED)])
    return F.element_at(members, (F.col("event_id") % len(codes.EVENT_CODES + (UNLISTED,)) + 1).cast("int"))


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical events with some exact copies."""
    e = table(spark, sf, "events")
    e = e.unionByName(e.where(F.col("event_id") % 10 == 0))
    return e.select(F.col("user_id").cast("string").alias("gpsno"), F.col("ts").alias("event_ts"), _code().alias("event_type"),
                    F.col("event_type").alias("event_name"), (30 + (F.col("event_id") % 1000) / 1024.0).alias("lat"),
                    (114 + (F.col("event_id") % 512) / 512.0).alias("lng"),
                    F.when(F.col("value").between(0, 180), F.col("value")).alias("speed"))


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """The log as text with bad values, as a raw file would hold it."""
    i = F.col("event_id")
    text = lambda c: c.cast("string")
    return table(spark, sf, "events").select(
        F.when(i % 29 == 0, "").when(i % 13 == 0, F.concat(F.lit(" "), text(F.col("user_id")), F.lit(" ")))
        .otherwise(text(F.col("user_id"))).alias("gpsno"),
        F.when(i % 17 == 0, "95.5").when(i % 19 == 0, "abc").otherwise(F.concat(text(30 + i % 40), F.lit(".5"))).alias("lat"),
        F.when(i % 31 == 0, "-181").otherwise(F.concat(text(100 + i % 40), F.lit(".25"))).alias("lng"),
        F.when(i % 37 == 0, "").otherwise(text(_code())).alias("event_type"), F.col("event_type").alias("event_name"),
        F.when(i % 41 == 0, F.lit(None).cast("string")).when(i % 43 == 0, "NaN").otherwise(text(F.col("value"))).alias("speed"),
        F.when(i % 23 == 0, "bad-time").otherwise(text(F.col("ts"))).alias("start_time"),
        F.concat(F.lit("part-"), text(i % 2)).alias("source_file"))


def clean_events(spark: SparkSession, sf: str) -> DataFrame:
    return E.clean_events(event_log(spark, sf), PERIOD.first_day, PERIOD.last_day)


def marked(spark: SparkSession, sf: str) -> DataFrame:
    return E.mark_episodes(clean_events(spark, sf), gap_s=GAP_S)


def event_daily(spark: SparkSession, sf: str, speed_p90: bool = False) -> DataFrame:
    return E.event_daily(marked(spark, sf), speed_p90=speed_p90)


def shifted_day(hours: Column) -> Column:
    """Day of an event some hours on, so that the sources cover different days of an entity."""
    return F.to_date(F.expr("ts") + F.make_dt_interval(F.lit(0), hours.cast("int")))


def motion_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Entity-day exposure summed straight from the log (exact binary fractions)."""
    i = F.col("event_id")
    step = (i % 97) * 0.5
    return (table(spark, sf, "events")
            .groupBy(F.col("user_id").cast("string").alias("gpsno"), shifted_day(i % 3 * 16).alias("day")).agg(
                F.count(F.lit(1)).alias("trajectory_rows"), F.count_if(i % 5 != 0).alias("moving_rows"),
                F.count_if(i % 7 != 0).alias("distance_valid_rows"), F.count_if(i % 7 == 0).alias("distance_invalid_rows"),
                F.sum(step).alias("distance_km"), F.sum((i % 13) * 0.25).alias("drive_hours"),
                F.count_if(i % 9 == 0).alias("trip_starts"),
                F.sum(F.when(i % 4 == 0, step).otherwise(0.0)).alias("night_distance_km"),
                F.min(i % 90).cast("double").alias("speed_p50"), F.max(i % 120).cast("double").alias("speed_p90"),
                (F.max(i % 11) * 0.25).alias("speed_change_p90"), (F.max(i % 17) * 0.5).alias("turn_rate_p90"),
                F.count_if(i % 6 == 0).alias("long_gap_rows")))


def sensor_daily(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    return (table(spark, sf, "events")
            .groupBy(F.col("user_id").cast("string").alias("gpsno"), shifted_day(i % 4 * -12).alias("day")).agg(
                F.count(F.lit(1)).alias("imu_valid_windows"), (F.count(F.lit(1)) * 4).alias("imu_valid_samples"),
                (F.max(i % 31) * 0.125).alias("imu_accel_peak_p99"),
                (F.max(i % 23) * 0.0625).alias("imu_accel_variability_p90"), (F.max(i % 53) * 0.5).alias("imu_gyro_peak")))


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return D.coverage(profile(spark, sf), clean_events(spark, sf), motion_daily(spark, sf), sensor_daily(spark, sf))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Dense entity-day table with day_index."""
    out = D.assemble(coverage(spark, sf), event_daily(spark, sf), motion_daily(spark, sf), sensor_daily(spark, sf),
                     PERIOD.first_day, PERIOD.last_day)
    return D.with_day_index(out, PERIOD.first_day)


def daily_table(spark: SparkSession, sf: str) -> DataFrame:
    """The entity-day table written once, for queries that read it in several branches."""
    return materialise(daily(spark, sf), "daily")


def split_table(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(split_entities(spark, sf), "entities")


def day_table(spark: SparkSession, sf: str) -> DataFrame:
    return D.day_table(daily(spark, sf), PERIOD.first_day)


def targets(spark: SparkSession, sf: str) -> DataFrame:
    return E.target_events(clean_events(spark, sf))


def trajectory(spark: SparkSession, sf: str) -> DataFrame:
    """Five fixes after each event, with copies that lost speed and position."""
    k = F.explode(F.array(*[F.struct(F.lit(n).alias("k"), F.lit(o).alias("off"), F.lit(r).alias("run"))
                            for n, (o, r) in enumerate(((0, 0), (5, 5), (12, 7), (40, 28), (700, 120)))]))
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", k.alias("_k")).select("event_id", "user_id", "ts", "_k.*")
    i, n, run = F.col("event_id"), F.col("k"), F.col("run")
    speed = (i * 7 + n * 13) % 100
    cm = F.when(i % 6 == 0, 0).when(i % 11 == 0, speed * run * 280).otherwise(speed * run * 28)
    fixes = e.select(
        F.col("user_id").cast("string").alias("gpsno"), F.expr("ts + make_dt_interval(0, 0, 0, off)").alias("ts"),
        F.when((i % 7 == 0) & (n == 3), 500).otherwise(cm).cast("long").alias("distance_cm"),
        F.when(i % 6 == 0, 0).when((i % 7 == 0) & (n == 3), 0).otherwise(run).cast("long").alias("run_time_s"),
        F.when(i % 10 != n, speed * 0.5 + F.when(n == 2, 0.25).otherwise(0.0)).alias("speed"),
        ((i * 37 + n * 101) % 360).cast("double").alias("course"),
        (30 + (i % 512 + n) / 4096.0).alias("lat"), (114 + (i % 256 + n) / 4096.0).alias("lng"),
        F.concat(F.lit("part-"), (i % 2).cast("string")).alias("source_file"), (i % 8 == 0).alias("_copied"))
    copies = fixes.where("_copied").withColumn("speed", F.lit(None).cast("double")).withColumn("lat", F.lit(None).cast("double"))
    return fixes.unionByName(copies).drop("_copied")


def imu(spark: SparkSession, sf: str) -> DataFrame:
    """Six samples, two seconds apart, after each event."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    i, k = F.col("event_id"), F.col("k")
    lost = (i + k) % 13 == 0
    accel = lambda a, b: F.when(~lost, ((i * a + k * b) % 200 - 100) / 64.0)
    gyro = lambda a, b: F.when(~lost, ((i * a + k * b) % 400 - 200) / 8.0)
    return e.select(
        F.col("user_id").cast("string").alias("gpsno"), F.concat(F.lit("dev-"), (F.col("user_id") % 3).cast("string")).alias("imei"),
        F.expr("ts + make_dt_interval(0, 0, 0, 2 * k)").alias("ts"), F.lit(20240101).alias("data_date"),
        F.when(i % 3 != 0, ((i + k) % 120).cast("double")).alias("ems_speed"),
        F.when(i % 5 != 0, ((i + 2 * k) % 120).cast("double")).alias("gps_speed"),
        accel(17, 5).alias("ax"), accel(23, 7).alias("ay"), accel(31, 11).alias("az"),
        gyro(29, 13).alias("gx"), gyro(37, 17).alias("gy"), gyro(41, 19).alias("gz"),
        F.concat(F.lit("part-"), (i % 3).cast("string")).alias("source_file"))


PREDICTION_ANCHORS = (10, 14, 20)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Labels and two deterministic probabilities (with ties) per (entity, anchor)."""
    e = table(spark, sf, "events").withColumn("d", F.datediff(F.to_date("ts"), F.lit(PERIOD.first_day).cast("date")) + 1)
    hit = (F.col("event_type") == "error") & (F.col("value") > 60)
    items = [F.struct(F.lit(a).alias("anchor_day"),
                      F.max(F.when(hit & F.col("d").between(a + 1, a + 5), 1).otherwise(0)).alias("label"),
                      F.min(F.when(hit & F.col("d").between(a + 1, a + 5), F.col("d") - a)).alias("first_event_day"),
                      F.count_if(F.col("d") <= a).alias("n")) for a in PREDICTION_ANCHORS]
    per = e.groupBy("user_id").agg(F.array(*items).alias("_a")).select("user_id", F.explode("_a").alias("_x")).select("user_id", "_x.*")
    u = F.col("user_id")
    return per.select(u.cast("string").alias("gpsno"), "anchor_day", F.lit(5).alias("horizon_days"), "first_event_day", "label",
                      (u % 5).cast("int").alias("fold"),
                      (((F.col("n") * 37 + u * 13) % 101 + F.col("label") * 20) / 128.0).alias("probability"),
                      (((F.col("n") * 53 + u * 29) % 97 + F.col("label") * 10) / 128.0).alias("prior_probability"))


def split_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities with their event feed; development = twelve of thirteen entities with a feed."""
    key = F.col("gpsno").cast("long")
    return coverage(spark, sf).select("gpsno", "has_event_feed",
                                      (F.col("has_event_feed") & (key % DEVELOPMENT_MOD != 0)).alias("is_development"))


def importance(spark: SparkSession, sf: str) -> DataFrame:
    """A per-code importance derived from the log."""
    clean = clean_events(spark, sf).where(F.col("event_type") != UNLISTED)
    return (clean.groupBy(F.col("event_type").alias("event_code"))
            .agg(F.log1p(F.count(F.lit(1))).alias("mean_abs_probability_delta")))


def card_probability(spark: SparkSession, sf: str, anchors=SCORE_ANCHORS) -> DataFrame:
    """A deterministic model probability of each (entity, anchor)."""
    key = F.col("gpsno").cast("long")
    a = F.explode(F.array(*[F.lit(x) for x in anchors])).alias("anchor_day")
    return profile(spark, sf).select("gpsno", a).withColumn("probability", ((key * 17 + F.col("anchor_day") * 5) % 101) / 128.0)
