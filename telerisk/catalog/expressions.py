"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from telerisk import codes
from telerisk.catalog import sqlviews as Q
from telerisk.catalog import views as V
from telerisk.catalog.registry import query
from telerisk.catalog.sources_sinks import imu_text
from telerisk.functions import columns as X
from telerisk.operators import daily as D
from telerisk.operators import episodes as E
from telerisk.operators import landmarks as K
from telerisk.operators import model, scoring, tensors, trajectory
from telerisk.operators.scaling import is_count_feature
from telerisk.sources import canon, files

CANON_COLUMNS = ("gpsno", "event_ts", "event_type", "event_name", "lat", "lng", "speed", "bad_lat", "bad_lng", "bad_speed")


@query("p1_canonical_events", Q.shape(f"SELECT {', '.join(CANON_COLUMNS)} FROM canon", ["lat", "lng", "speed"], ["event_type"],
                                      f"{Q.RAW}, {Q.CANON}", ["event_ts"]))
def p1(spark, sf):
    return canon.canonical_events(V.raw_events(spark, sf)).select(*CANON_COLUMNS)


@query("p2_canonical_trajectory", Q.shape("""
    SELECT gpsno, ts, CAST(round(distance_cm / 10.0) AS BIGINT) AS distance_cm, run_time_s,
           CASE WHEN speed * 4 BETWEEN 0 AND 180 THEN speed * 4 END AS speed,
           CASE WHEN course + 10 BETWEEN 0 AND 359 THEN course + 10 END AS course,
           CASE WHEN lat * 3 BETWEEN -90 AND 90 THEN lat * 3 END AS lat, lng, source_file
    FROM trajectory""", ["speed", "course", "lat", "lng"], ctes=Q.TRAJECTORY, t=["ts"]))
def p2(spark, sf):
    t = lambda c: c.cast("string")
    raw = V.trajectory(spark, sf).select(
        "gpsno", t(F.col("distance_cm") / 10.0).alias("distance"), t(F.col("run_time_s")).alias("run_time"),
        t(F.col("ts")).alias("trigger_time"), t(F.col("speed") * 4).alias("speed"), t(F.col("course") + 10).alias("course"),
        t(F.col("lat") * 3).alias("lat"), t(F.col("lng")).alias("lng"), "source_file")
    return canon.canonical_trajectory(raw)


_AXES = ("ax", "ay", "az", "gx", "gy", "gz")


@query("p3_canonical_imu", Q.shape(f"""
    SELECT gpsno, imei, ts, 20240101 AS data_date, ems_speed, CASE WHEN gps_speed * 2 BETWEEN 0 AND 180 THEN gps_speed * 2 END AS gps_speed,
           CASE WHEN ABS(ax * 100) < 100 THEN ax * 100 END AS ax, ay, az,
           CASE WHEN ABS(gx * 500) < 10000 THEN gx * 500 END AS gx, gy, gz FROM imu""",
    ["ems_speed", "gps_speed", *_AXES], ["data_date"], Q.IMU, ["ts"]))
def p3(spark, sf):
    raw = imu_text(spark, sf)
    scaled = lambda c, k: (F.col(c).cast("double") * k).cast("string")
    raw = raw.select("gpsno", F.concat(F.lit(" "), "imei").alias("imei"), "data_time", "data_date", "ems_speed",
                     scaled("gps_speed", 2.0).alias("gps_speed"), scaled("accel_x_raw", 100.0).alias("accel_x_raw"),
                     "accel_y_raw", "accel_z_raw", scaled("gyro_x_raw", 500.0).alias("gyro_x_raw"), "gyro_y_raw", "gyro_z_raw",
                     F.lit("f").alias("source_file"))
    return canon.canonical_imu(raw).drop("source_file")


@query("p4_rule_window", Q.shape("""
    SELECT gpsno, event_ts, event_type FROM canon WHERE gpsno <> '' AND event_ts >= TIMESTAMP '2024-01-05'
      AND event_ts < TIMESTAMP '2024-01-26'""", b=["event_type"], ctes=f"{Q.RAW}, {Q.CANON}", t=["event_ts"]))
def p4(spark, sf):
    return E.in_rule_window(canon.canonical_events(V.raw_events(spark, sf)), "event_ts", "2024-01-05", "2024-01-25").select(
        "gpsno", "event_ts", "event_type")


@query("p5_target_events", Q.shape("SELECT * FROM targets", b=["event_type"], ctes=f"{Q.CLEAN}, {Q.TARGETS}", t=["event_ts"]))
def p5(spark, sf):
    return V.targets(spark, sf)


def steps(spark, sf):
    fixes = trajectory.best_fix(E.in_rule_window(V.trajectory(spark, sf), "ts", V.PERIOD.first_day, V.PERIOD.last_day))
    return trajectory.with_steps(fixes)


def step_query(name, *columns, doubles=()):
    sql = Q.shape(f"SELECT gpsno, ts, {', '.join(columns)} FROM steps", doubles, ctes=f"{Q.TRAJECTORY}, {Q.STEPS}", t=["ts"])
    query(name, sql)(lambda spark, sf: steps(spark, sf).select("gpsno", "ts", *columns))


step_query("p6_implied_speed", "distance_cm", "run_time_s", "implied_speed", doubles=["implied_speed"])
step_query("p7_increment_validity", "gap_s", "valid_zero", "valid_increment", "valid_fallback")
step_query("p8_distance_choice", "distance_km", "drive_hours", doubles=["distance_km", "drive_hours"])
query("p9_trip_start", Q.shape("SELECT gpsno, ts, gap_s, trip_start FROM steps", b=["trip_start"],
                               ctes=f"{Q.TRAJECTORY}, {Q.STEPS}", t=["ts"]))(
    lambda spark, sf: steps(spark, sf).select("gpsno", "ts", "gap_s", "trip_start"))
step_query("p10_speed_change", "speed_change_per_s", doubles=["speed_change_per_s"])
step_query("p11_turn_rate", "turn_deg_per_s", doubles=["turn_deg_per_s"])
step_query("p12_haversine_step", "gps_step_km", doubles=["gps_step_km"])


@query("p13_night_share", Q.shape("""
    SELECT gpsno, CAST(ts AS DATE) AS day, SUM(distance_km) AS km,
           SUM(CASE WHEN EXTRACT(HOUR FROM ts) < 6 OR EXTRACT(HOUR FROM ts) >= 22 THEN distance_km ELSE 0 END) AS night_km
    FROM steps GROUP BY gpsno, CAST(ts AS DATE)""", ["km", "night_km"], ctes=f"{Q.TRAJECTORY}, {Q.STEPS}", t=["day"]))
def p13(spark, sf):
    hour = F.hour("ts")
    return (steps(spark, sf).groupBy("gpsno", F.to_date("ts").alias("day"))
            .agg(F.sum("distance_km").alias("km"),
                 F.sum(F.when((hour < 6) | (hour >= 22), F.col("distance_km")).otherwise(0.0)).alias("night_km")))


@query("p14_magnitude", Q.shape("""
    SELECT gpsno, ts, SQRT(ax * ax + ay * ay + az * az) AS accel_norm, SQRT(gx * gx + gy * gy + gz * gz) AS gyro_norm FROM imu""",
    ["accel_norm", "gyro_norm"], ctes=Q.IMU, t=["ts"]))
def p14(spark, sf):
    return V.imu(spark, sf).select("gpsno", "ts", X.magnitude("ax", "ay", "az").alias("accel_norm"),
                                   X.magnitude("gx", "gy", "gz").alias("gyro_norm"))


@query("p15_guarded_rates", Q.shape("SELECT gpsno, day, events_per_100km, events_per_drive_hour FROM daily",
                                    ["events_per_100km", "events_per_drive_hour"], ctes=Q.DAILY_CTES, t=["day"]))
def p15(spark, sf):
    return V.daily(spark, sf).select("gpsno", "day", "events_per_100km", "events_per_drive_hour")


_RATES = [f"event_{c}_rate100_smooth" for c in codes.EVENT_CODES]


@query("p16_smoothed_rate", Q.shape(f"SELECT gpsno, day_index, {', '.join(_RATES)} FROM day_table", _RATES, ["day_index"],
                                    f"{Q.DAILY_CTES}, {Q.DAY_TABLE}"))
def p16(spark, sf):
    return V.day_table(spark, sf).select("gpsno", "day_index", *_RATES)


NODE_SQL = "nodes AS (" + " UNION ALL ".join(f"""
    SELECT gpsno, day_index, {c} AS event_code, LN(1 + event_{c}_count) AS log_count, LN(1 + event_{c}_episodes) AS log_episodes,
           LN(1 + event_{c}_rate100_smooth) AS log_rate_100km,
           LN(1 + event_{c}_count / (COALESCE(drive_hours, 0) + 1.0::DOUBLE)) AS log_rate_hour,
           CASE WHEN event_{c}_count > 0 THEN 1 ELSE 0 END AS occurred,
           CASE WHEN distance_km >= 0 THEN 1 ELSE 0 END AS km_observed, CASE WHEN drive_hours >= 0 THEN 1 ELSE 0 END AS hours_observed,
           CASE WHEN distance_km > 0 THEN LEAST(GREATEST(night_distance_km, 0) / distance_km, 1) ELSE 0.0 END AS night_share
    FROM day_table""" for c in codes.EVENT_CODES) + ")"
NODE_DOUBLES = ["log_count", "log_episodes", "log_rate_100km", "log_rate_hour", "night_share"]
NODE_INTS = ["event_code", "day_index", "occurred", "km_observed", "hours_observed"]


@query("p17_event_node_features", Q.shape("SELECT * FROM nodes", NODE_DOUBLES, NODE_INTS, f"{Q.DAILY_CTES}, {Q.DAY_TABLE}, {NODE_SQL}"))
def p17(spark, sf):
    return D.event_node_features(V.day_table(spark, sf))


@query("p18_signed_log", Q.shape("""
    SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN LN(1 + c_acctbal) WHEN c_acctbal < 0 THEN -LN(1 - c_acctbal) ELSE 0.0 END AS signed_log
    FROM customer""", ["signed_log"]))
def p18(spark, sf):
    return V.table(spark, sf, "customer").select("c_custkey", X.signed_log("c_acctbal").alias("signed_log"))


EVIDENCE_SQL = f"""evidence AS (
  SELECT d.gpsno, a.anchor_day, MAX(CAST(e.has_event_feed AS INTEGER)) = 1 AS has_event_feed,
         AVG(CAST(d.trajectory_recorded_today AS INTEGER)) AS trajectory_coverage, AVG(CAST(d.imu_recorded_today AS INTEGER)) AS imu_coverage
  FROM daily d JOIN {Q.anchor_values(V.SCORE_ANCHORS)} ON d.day_index <= a.anchor_day JOIN entities e ON e.gpsno = d.gpsno
  GROUP BY d.gpsno, a.anchor_day)"""
EVIDENCE_CTES = f"{Q.DAILY_CTES}, {Q.ENTITIES}, {EVIDENCE_SQL}"


def evidence(spark, sf):
    return (K.exposure_totals(V.daily(spark, sf), V.SCORE_ANCHORS)
            .join(V.split_entities(spark, sf).select("gpsno", "has_event_feed"), "gpsno")
            .select("gpsno", "anchor_day", "has_event_feed", "trajectory_coverage", "imu_coverage"))


@query("p19_evidence_route", Q.shape("""
    SELECT gpsno, anchor_day, CASE WHEN has_event_feed THEN 'full' WHEN trajectory_coverage > 0 OR imu_coverage > 0
           THEN 'context_only_no_matched_event' ELSE 'prior_no_observed_behavior' END AS route FROM evidence""",
    b=["anchor_day"], ctes=EVIDENCE_CTES))
def p19(spark, sf):
    return evidence(spark, sf).select("gpsno", "anchor_day", scoring.route(F.col("has_event_feed")).alias("route"))


@query("p20_confidence", Q.shape("""
    SELECT gpsno, anchor_day, a AS confidence_a, b AS confidence_b,
           CASE WHEN a >= 0.8 THEN '高' WHEN a >= 0.5 THEN '中' ELSE '低' END AS level_a,
           CASE WHEN b >= 0.8 THEN '高' WHEN b >= 0.5 THEN '中' ELSE '低' END AS level_b
    FROM (SELECT *, 0.6::DOUBLE * CAST(has_event_feed AS INTEGER) + 0.3::DOUBLE * trajectory_coverage + 0.1::DOUBLE * imu_coverage AS a,
                 0.5::DOUBLE * CAST(has_event_feed AS INTEGER) + 0.3::DOUBLE * trajectory_coverage + 0.2::DOUBLE * imu_coverage AS b
          FROM evidence) e""", ["confidence_a", "confidence_b"], ["anchor_day"], EVIDENCE_CTES))
def p20(spark, sf):
    feed = F.col("has_event_feed")
    a, b = scoring.evidence(feed, codes.SCORE_A_EVIDENCE), scoring.evidence(feed, codes.SCORE_B_EVIDENCE)
    return evidence(spark, sf).select("gpsno", "anchor_day", a.alias("confidence_a"), b.alias("confidence_b"),
                                      scoring.confidence_level(a).alias("level_a"), scoring.confidence_level(b).alias("level_b"))


def _bands(bands, pick, low):
    whens = " ".join(f"WHEN score >= {b[1]} THEN '{b[pick]}'" for b in bands if b[1] is not None)
    return f"CASE WHEN level = '低' THEN '{low}' {whens} ELSE '{bands[-1][pick]}' END"


@query("p21_grade_bands", f"""SELECT o_orderkey, {_bands(codes.SCORE_A_GRADES, 0, 'U')} AS grade_a,
    {_bands(codes.SCORE_B_GRADES, 0, 'U')} AS grade_b, {_bands(codes.SCORE_A_GRADES, 2, codes.SCORE_A_UNRATED[1])} AS risk_level,
    {_bands(codes.SCORE_B_GRADES, 3, codes.SCORE_B_UNRATED[2])} AS action
    FROM (SELECT o_orderkey, (o_orderkey % 101) AS score, CASE WHEN o_orderkey % 7 = 0 THEN '低' ELSE '高' END AS level FROM orders) o""")
def p21(spark, sf):
    o = V.table(spark, sf, "orders")
    score = F.col("o_orderkey") % 101
    level = F.when(F.col("o_orderkey") % 7 == 0, codes.CONFIDENCE_LOW).otherwise(codes.CONFIDENCE_HIGH)
    a = scoring.grade_columns(score, level, codes.SCORE_A_GRADES, codes.SCORE_A_UNRATED)
    b = scoring.grade_columns(score, level, codes.SCORE_B_GRADES, codes.SCORE_B_UNRATED)
    return o.select("o_orderkey", a[0].alias("grade_a"), b[0].alias("grade_b"), a[1].alias("risk_level"), b[2].alias("action"))


@query("p22_binary_decision", Q.shape("SELECT gpsno, anchor_day, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS prediction FROM predictions",
                                      b=["anchor_day", "prediction"], ctes=Q.PREDICTIONS))
def p22(spark, sf):
    return V.predictions(spark, sf).select("gpsno", "anchor_day", (F.col("probability") >= 0.5).cast("int").alias("prediction"))


@query("p26_column_families", "WITH " + Q.DAILY_CTES + """ SELECT family, COUNT(*) AS columns, CAST(SUM(n) AS BIGINT) AS observed_cells FROM (
    """ + " UNION ALL ".join(f"SELECT '{k}' AS family, COUNT({f}) AS n FROM daily" for k, fs in files.feature_families(
        V.MODEL_FEATURES).items() for f in fs) + ") u GROUP BY family")
def p26(spark, sf):
    daily = V.daily(spark, sf).drop("day_index")
    families = files.feature_families(files.numeric_features(daily))
    row = daily.agg(*[X.sum_of([F.count(c) for c in cs]).cast("long").alias(k) for k, cs in families.items()])
    items = [F.struct(F.lit(k).alias("family"), F.lit(len(cs)).alias("columns"), F.col(k).alias("observed_cells")) for k, cs in families.items()]
    return row.select(F.explode(F.array(*items)).alias("_x")).select("_x.*")


@query("p28_count_like_columns", f"WITH {Q.DAILY_CTES} " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST(SUM({f}) AS BIGINT) AS total FROM daily" for f in
    V.MODEL_FEATURES
    if f.endswith(("_count", "_episodes", "_rows", "_samples", "_windows")) or f == "trip_starts"))
def p28(spark, sf):
    daily = V.daily(spark, sf).drop("day_index")
    names = [f for f in files.numeric_features(daily) if is_count_feature(f)]
    row = daily.agg(*[F.sum(c).cast("long").alias(c) for c in names])
    items = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("total")) for c in names]
    return row.select(F.explode(F.array(*items)).alias("_x")).select("_x.*")


@query("p29_horizon_probability", Q.shape("""
    SELECT l_orderkey, l_linenumber, 1 - POW(1 - q, d) AS probability
    FROM (SELECT l_orderkey, l_linenumber, (l_discount + 0.01) / 4 AS q, CAST(l_quantity AS INTEGER) AS d FROM lineitem) l""",
    ["probability"], ["l_linenumber"]))
def p29(spark, sf):
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        X.horizon_probability((F.col("l_discount") + 0.01) / 4, F.col("l_quantity").cast("int")).alias("probability"))


@query("p30_as_of_date", Q.shape(f"SELECT gpsno, day_index, CAST({Q.FIRST} + CAST(day_index - 1 AS INTEGER) AS DATE) AS as_of_date FROM daily",
                                 b=["day_index"], ctes=Q.DAILY_CTES, t=["as_of_date"]))
def p30(spark, sf):
    return V.daily(spark, sf).select("gpsno", "day_index",
                                     F.date_add(F.lit(V.PERIOD.first_day).cast("date"), F.col("day_index") - 1).alias("as_of_date"))


@query("p31_segment_hazards", Q.shape("""
    SELECT l_orderkey, segment, LEAST(GREATEST(1 - EXP(SUM(LN(1 - hazard)) OVER (PARTITION BY l_orderkey ORDER BY segment)), 0.000001), 0.999999) AS probability
    FROM (SELECT l_orderkey, l_linenumber AS segment, SQRT(AVG(l_tax) + 0.0003) / 10 AS hazard FROM lineitem GROUP BY l_orderkey, l_linenumber) h""",
    ["probability"], ["segment"]))
def p31(spark, sf):
    h = (V.table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("segment"))
         .agg((F.sqrt(F.avg("l_tax") + 0.0003) / 10).alias("hazard")))
    return model.cumulative_segments(h, ["l_orderkey"]).drop("hazard")


FLAGS = ("has_event_feed", "has_trajectory", "has_imu", "event_recorded_today", "trajectory_recorded_today", "imu_recorded_today",
         "observed_stationary_day")


@query("p32_presence_flags", Q.shape(f"SELECT gpsno, day, {', '.join(FLAGS)}, event_total_count, event_11803_count FROM daily",
                                     ctes=Q.DAILY_CTES, t=["day"]))
def p32(spark, sf):
    return V.daily(spark, sf).select("gpsno", "day", *FLAGS, "event_total_count", "event_11803_count")


CATEGORIES = ("AUTOMOBILE", "BUILDING", "FURNITURE")


@query("p33_one_hot_category", "SELECT CAST(c_custkey AS VARCHAR) AS gpsno, " + ", ".join(
    f"CAST(CASE WHEN c_mktsegment = '{c}' THEN 1 ELSE 0 END AS BIGINT) AS category_{i}" for i, c in enumerate(CATEGORIES))
    + f", CAST(CASE WHEN c_mktsegment IN {CATEGORIES} THEN 0 ELSE 1 END AS BIGINT) AS category_other FROM customer")
def p33(spark, sf):
    return V.profile(spark, sf).select("gpsno", *tensors.one_hot(F.col("energy_type"), CATEGORIES))
