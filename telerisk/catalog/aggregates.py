"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from telerisk import codes
from telerisk.catalog import sqlviews as Q
from telerisk.catalog import views as V
from telerisk.catalog.expressions import EVIDENCE_SQL, NODE_SQL
from telerisk.catalog.joins import (BAG_CTES, FULL_SENSOR, OUTCOME_CTES, bags, full_imu_windows, full_trajectory_daily,
                                    outcomes, pair)
from telerisk.catalog.registry import query
from telerisk.catalog.sources_sinks import EVENT_COUNTERS
from telerisk.catalog.sqlmetrics import auc_sql, binary_sql
from telerisk.operators import daily as D
from telerisk.operators import imu as I
from telerisk.operators import labels as L
from telerisk.operators import landmarks as K
from telerisk.operators import metrics as M
from telerisk.operators import model, quality, scaling, scoring
from telerisk.session import materialise
from telerisk.sources import canon

CODE_COLUMNS = [f"event_{c}_{k}" for c in codes.EVENT_CODES for k in ("count", "episodes")]


@query("a1_code_counts", Q.shape(f"SELECT gpsno, day, {', '.join(CODE_COLUMNS)} FROM event_daily", ctes=Q.EVENT_CTES, t=["day"]))
def a1(spark, sf):
    return V.event_daily(spark, sf).select("gpsno", "day", *CODE_COLUMNS)


@query("a2_event_day_totals", Q.shape("SELECT gpsno, day, event_total_count, event_total_episodes, event_other_count, event_speed_p90 FROM event_daily",
                                      ["event_speed_p90"], ctes=Q.EVENT_CTES, t=["day"]))
def a2(spark, sf):
    return V.event_daily(spark, sf, speed_p90=True).select("gpsno", "day", "event_total_count", "event_total_episodes",
                                                           "event_other_count", "event_speed_p90")


@query("a3_trajectory_day", Q.shape("SELECT * FROM trajectory_daily", ["distance_km", "drive_hours", "gps_distance_check_km", "night_distance_km",
                                    "speed_p50", "speed_p90", "speed_change_p90", "turn_rate_p90"], ctes=Q.TRAJECTORY_CTES, t=["day"]))
def a3(spark, sf):
    return full_trajectory_daily(spark, sf)


WINDOW_DOUBLES = ["accel_norm_p95", "accel_norm_max", "accel_norm_std", "gyro_norm_p95", "gyro_norm_max", "speed_p50"]


@query("a4_motion_windows", Q.shape("SELECT * FROM imu_windows", WINDOW_DOUBLES, ctes=Q.IMU_CTES, t=["day"]))
def a4(spark, sf):
    w = full_imu_windows(spark, sf)
    span = F.expr("cast(extract(DAY FROM window_span) * 86400 + extract(HOUR FROM window_span) * 3600 "
                  "+ extract(MINUTE FROM window_span) * 60 + extract(SECOND FROM window_span) as bigint)")
    return w.withColumn("window_span_s", span).drop("window_span")


@query("a5_motion_day", Q.shape("SELECT * FROM imu_daily", [f for f in FULL_SENSOR if f not in (
    "imu_valid_windows", "imu_valid_samples", "imu_ems_missing_samples", "imu_gps_missing_samples")], ctes=Q.IMU_CTES, t=["day"]))
def a5(spark, sf):
    return I.imu_daily(materialise(full_imu_windows(spark, sf), "windows"), materialise)


@query("a6_distinct_events", Q.shape("SELECT * FROM clean", ["lat", "lng", "speed"], ["event_type"], Q.CLEAN, ["event_ts"]))
def a6(spark, sf):
    return V.clean_events(spark, sf)


@query("a7_distinct_counts", """SELECT COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT (user_id, CAST(ts AS DATE))) AS user_days,
    COUNT(*) - COUNT(DISTINCT event_id) AS duplicates FROM events""")
def a7(spark, sf):
    e = V.table(spark, sf, "events")
    per_day = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))  # distinct pairs as rows
    per_user = per_day.groupBy("user_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("days"))
    ids = e.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("duplicates"), F.lit(0).alias("_k"))
    return (per_user.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("users"), F.sum("days").alias("user_days"), F.lit(0).alias("_k"))
            .join(ids, "_k").drop("_k"))


@query("a8_quality_counters", f"WITH {Q.RAW}, {Q.CANON} {EVENT_COUNTERS}")
def a8(spark, sf):
    return quality.event_counters(canon.canonical_events(V.raw_events(spark, sf)), "2024-01-25")


@query("a8_trajectory_counters", f"""WITH {Q.TRAJECTORY} SELECT COUNT(*) AS raw_rows, COUNT(DISTINCT gpsno) AS raw_vehicles,
    COUNT(CASE WHEN ts IS NULL OR gpsno = '' THEN 1 END) AS invalid_key_or_time_rows,
    COUNT(CASE WHEN CAST(ts AS DATE) > DATE '2024-01-25' THEN 1 END) AS after_rule_end_rows,
    COUNT(CASE WHEN distance_cm > 0 AND run_time_s = 0 THEN 1 END) AS distance_without_runtime_rows,
    COUNT(CASE WHEN speed IS NULL THEN 1 END) AS invalid_speed_rows FROM trajectory""")
def a8_trajectory(spark, sf):
    return quality.trajectory_counters(V.trajectory(spark, sf), "2024-01-25")


@query("a8_motion_counters", f"""WITH {Q.IMU} SELECT COUNT(*) AS raw_rows, COUNT(DISTINCT gpsno) AS raw_vehicles,
    COUNT(CASE WHEN ts IS NULL OR gpsno = '' THEN 1 END) AS invalid_key_or_time_rows,
    COUNT(CASE WHEN CAST(ts AS DATE) > DATE '2024-01-25' THEN 1 END) AS after_rule_end_rows,
    COUNT(CASE WHEN ems_speed IS NULL THEN 1 END) AS ems_speed_missing_rows, COUNT(CASE WHEN gps_speed IS NULL THEN 1 END) AS gps_speed_missing_rows,
    COUNT(CASE WHEN ax IS NULL OR ay IS NULL OR az IS NULL THEN 1 END) AS accel_invalid_rows,
    COUNT(CASE WHEN gx IS NULL OR gy IS NULL OR gz IS NULL THEN 1 END) AS gyro_invalid_rows FROM imu""")
def a8_motion(spark, sf):
    return quality.imu_counters(V.imu(spark, sf), "2024-01-25")


@query("a9_spread_entities", f"""WITH {Q.TRAJECTORY} SELECT COUNT(*) AS cross_part_vehicles FROM (
    SELECT gpsno FROM trajectory GROUP BY gpsno HAVING COUNT(DISTINCT source_file) > 1) t""")
def a9(spark, sf):
    return quality.spread_over_files(V.trajectory(spark, sf))


@query("a10_source_coverage", Q.shape("""SELECT gpsno, MIN(CAST(event_ts AS DATE)) AS event_first_day, MAX(CAST(event_ts AS DATE)) AS event_last_day,
    COUNT(*) AS event_rows FROM clean GROUP BY gpsno""", ctes=Q.CLEAN, t=["event_first_day", "event_last_day"]))
def a10(spark, sf):
    return D.entity_coverage(V.clean_events(spark, sf))[0]


@query("a11_frequency_tables", Q.shape("""SELECT 'category' AS kind, energy_type AS value, COUNT(*) AS n FROM profile GROUP BY energy_type
    UNION ALL SELECT 'label_status', label_status, COUNT(*) FROM bags GROUP BY label_status""", ctes=BAG_CTES))
def a11(spark, sf):
    count = lambda df, kind, c: df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    return count(V.profile(spark, sf), "category", "energy_type").unionByName(count(bags(spark, sf), "label_status", "label_status"))


@query("a12_rows_per_entity", "SELECT MIN(n) AS rows_min, MAX(n) AS rows_max FROM (SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id) t")
def a12(spark, sf):
    return (V.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
            .agg(F.min("n").alias("rows_min"), F.max("n").alias("rows_max")))


def _landmark_sql() -> dict[str, str]:
    def s(c, w="TRUE"):
        return f"SUM(CASE WHEN {w} THEN COALESCE(CAST({c} AS DOUBLE), 0.0) ELSE 0.0 END)"
    def rate(a, b, k=1):
        return f"CASE WHEN {b} > 0 THEN {k} * {a} / {b} END"
    near, old = "back < 7", "back BETWEEN 7 AND 13"
    km = s("distance_km")
    out = {
        "exposure_km_per_day": f"{km} / anchor_day", "exposure_hours_per_day": f"{s('drive_hours')} / anchor_day",
        "exposure_driving_fraction": "AVG(CASE WHEN distance_km > 0 THEN 1.0::DOUBLE ELSE 0.0 END)",
        "exposure_trajectory_fraction": "AVG(CAST(trajectory_recorded_today AS INTEGER))",
        "exposure_imu_fraction": "AVG(CAST(imu_recorded_today AS INTEGER))",
        "exposure_night_share": rate(s("night_distance_km"), km),
        "exposure_km_recent7": f"{s('distance_km', near)} / 7", "exposure_hours_recent7": f"{s('drive_hours', near)} / 7",
        "exposure_km_delta7": f"({s('distance_km', near)} - {s('distance_km', old)}) / 7",
        "exposure_hours_delta7": f"({s('drive_hours', near)} - {s('drive_hours', old)}) / 7",
        "quality_invalid_distance_share": rate(s("distance_invalid_rows"), f"({s('distance_valid_rows')} + {s('distance_invalid_rows')})"),
        "quality_long_gap_per_day": f"{s('long_gap_rows')} / anchor_day",
        "imu_accel_peak_mean": "AVG(imu_accel_peak_p99)", "imu_gyro_peak_mean": "AVG(imu_gyro_peak)",
        "imu_accel_recent7": f"AVG(imu_accel_peak_p99) FILTER (WHERE {near})",
        "imu_accel_delta7": f"AVG(imu_accel_peak_p99) FILTER (WHERE {near}) - AVG(imu_accel_peak_p99) FILTER (WHERE {old})",
        "imu_valid_windows_per_day": f"{s('imu_valid_windows')} / anchor_day"}
    for f in codes.LANDMARK_EVENT_FIELDS:
        out[f"{f}_per_day"] = f"{s(f)} / anchor_day"
        out[f"{f}_per_100km"] = rate(s(f), km, 100)
        out[f"{f}_recent7_per_day"] = f"{s(f, near)} / 7"
        out[f"{f}_delta7_per_day"] = f"({s(f, near)} - {s(f, old)}) / 7"
    for c in codes.TARGET_CODES:
        out[f"event_{c}_recency_days"] = f"CAST(MIN(CASE WHEN event_{c}_count > 0 THEN back END) AS DOUBLE)"
    return out


def history_sql(anchors=V.ANCHORS) -> str:
    return (f"history AS (SELECT d.*, a.anchor_day, a.anchor_day - d.day_index AS back FROM daily d "
            f"JOIN {Q.anchor_values(anchors)} ON d.day_index <= a.anchor_day)")


LANDMARK_SQL = _landmark_sql()
_FIELDS, _NAMES = ", ".join(f"{e} AS {n}" for n, e in LANDMARK_SQL.items()), list(LANDMARK_SQL)
LANDMARK_NUMBERS = _NAMES
LANDMARK_CTES = f"{Q.DAILY_CTES}, {history_sql()}, landmarks AS (SELECT gpsno, anchor_day, {_FIELDS} FROM history GROUP BY gpsno, anchor_day)"


@query("a13_landmark_summary", Q.shape("SELECT * FROM landmarks", _NAMES, ["anchor_day"], LANDMARK_CTES))
def a13(spark, sf):
    return K.landmark_summary(V.daily(spark, sf), V.ANCHORS)


def _window_sql() -> tuple[str, list[str], list[str]]:
    doubles, ints, out = [], [], {}
    def add(name, text, kind):
        out[name] = text
        kind.append(name)
    add("event_feed_at_anchor", "MAX(CASE WHEN back = 0 AND has_event_feed THEN 1 ELSE 0 END)", ints)
    add("trajectory_at_anchor", "MAX(CASE WHEN back = 0 AND has_trajectory THEN 1 ELSE 0 END)", ints)
    rate = lambda a, b, k=1: f"CASE WHEN {b} > 0 THEN {k}.0::DOUBLE * {a} / {b} END"
    for w in (7, 14, 20):
        f = f"FILTER (WHERE back < {w})"
        km, hours = f"SUM(distance_km) {f}", f"SUM(drive_hours) {f}"
        moved = f"SUM(CAST(trajectory_recorded_today AS INTEGER)) {f}"
        feeds = f"SUM(CAST(has_event_feed AS INTEGER)) {f}"
        add(f"trajectory_recorded_days_{w}", moved, ints)
        add(f"distance_km_{w}", km, doubles)
        add(f"drive_hours_{w}", hours, doubles)
        add(f"km_per_calendar_day_{w}", f"{km} / {w}", doubles)
        add(f"hours_per_calendar_day_{w}", f"{hours} / {w}", doubles)
        add(f"km_per_recorded_day_{w}", rate(km, moved), doubles)
        add(f"event_feed_days_{w}", feeds, ints)
        for c in codes.WINDOW_EVENT_FIELDS:
            n = f"CAST(SUM({c}) FILTER (WHERE back < {w} AND has_event_feed) AS DOUBLE)"
            add(f"{c}_{w}", n, doubles)
            add(f"{c}_per_100km_{w}", rate(n, km, 100), doubles)
            add(f"{c}_per_hour_{w}", rate(n, hours), doubles)
        add(f"near_miss_days_{w}", f"CASE WHEN {feeds} > 0 THEN COUNT(*) FILTER (WHERE back < {w} AND has_event_feed AND event_11804_count > 0) END", ints)
        add(f"near_miss_recency_{w}", f"MIN(back) FILTER (WHERE back < {w} AND has_event_feed AND event_11804_count > 0)", ints)
    for c, n in (("distance_km", "distance_change_7d"), ("drive_hours", "hours_change_7d")):
        add(n, f"SUM({c}) FILTER (WHERE back < 7) - SUM({c}) FILTER (WHERE back BETWEEN 7 AND 13)", doubles)
    return ", ".join(f"{e} AS {n}" for n, e in out.items()), doubles, ints


_WF, _WD, _WI = _window_sql()


@query("a14_window_features", Q.shape(f"SELECT gpsno, anchor_day, {_WF} FROM history GROUP BY gpsno, anchor_day", _WD, ["anchor_day", *_WI],
                                      f"{Q.DAILY_CTES}, {history_sql((20, 24, 30))}"))
def a14(spark, sf):
    return K.window_features(V.daily(spark, sf), (20, 24, 30))


@query("a15_any_all", Q.shape("""SELECT gpsno, BOOL_OR(trajectory_recorded_today) AS any_trajectory, BOOL_AND(has_event_feed) AS always_feed,
    BOOL_OR(imu_recorded_today) AS any_imu FROM daily GROUP BY gpsno""", ctes=Q.DAILY_CTES))
def a15(spark, sf):
    return V.daily(spark, sf).groupBy("gpsno").agg(F.bool_or("trajectory_recorded_today").alias("any_trajectory"),
                                                   F.bool_and("has_event_feed").alias("always_feed"), F.bool_or("imu_recorded_today").alias("any_imu"))


GRADED = """graded AS (SELECT *, 100 - 100 * probability AS safety_score,
  CASE WHEN probability < 0.15 THEN 'A' WHEN probability < 0.25 THEN 'B' WHEN probability < 0.35 THEN 'C' WHEN probability < 0.5 THEN 'D' ELSE 'E' END AS grade
  FROM predictions)"""


def graded(spark, sf):
    p = F.col("probability")
    return (V.predictions(spark, sf).withColumn("safety_score", 100 - 100 * p)
            .withColumn("grade", F.when(p < 0.15, "A").when(p < 0.25, "B").when(p < 0.35, "C").when(p < 0.5, "D").otherwise("E")))


@query("a16_fleet_summary", Q.shape("""SELECT grade, COUNT(*) AS vehicles, AVG(safety_score) AS mean_score, AVG(probability) AS mean_risk,
    COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS share FROM graded GROUP BY grade""", ["mean_score", "mean_risk", "share"],
    ctes=f"{Q.PREDICTIONS}, {GRADED}"))
def a16(spark, sf):
    return M.share_by(graded(spark, sf), ["grade"], mean_score="safety_score", mean_risk="probability")


@query("a17_rate_by_grade", Q.shape("""SELECT grade, COUNT(*) AS vehicles, SUM(label) AS future_events, AVG(safety_score) AS mean_safety_score,
    AVG(label) AS future_event_rate FROM graded GROUP BY grade""", ["mean_safety_score", "future_event_rate"], ["future_events"],
    f"{Q.PREDICTIONS}, {GRADED}"))
def a17(spark, sf):
    return graded(spark, sf).groupBy("grade").agg(
        F.count(F.lit(1)).alias("vehicles"), F.sum("label").alias("future_events"),
        F.avg("safety_score").alias("mean_safety_score"), F.avg("label").alias("future_event_rate"))


def _role_sql() -> tuple[str, list[str]]:
    out = {}
    rate = lambda a, b: f"CASE WHEN {b} > 0 THEN 100 * {a} / {b} END"
    add = lambda kind, cs: "(" + " + ".join(Q.n0(f"event_{c}_{kind}") for c in cs) + ")"
    km, hours = "SUM(COALESCE(distance_km, 0.0))", "SUM(COALESCE(drive_hours, 0.0))"
    for role, cs in codes.ROLES.items():
        n, e, p = add("count", cs), add("episodes", cs), f"role_{role}"
        near, old = (f"COALESCE(SUM({n}) FILTER (WHERE {w}), 0.0)" for w in ("back < 7", "back BETWEEN 7 AND 13"))
        out[f"{p}_count_per_day"] = f"SUM({n}) / anchor_day"
        out[f"{p}_count_per_100km"] = rate(f"SUM({n})", km)
        out[f"{p}_count_per_100hours"] = rate(f"SUM({n})", hours)
        out[f"{p}_episodes_per_day"] = f"SUM({e}) / anchor_day"
        out[f"{p}_episodes_per_100km"] = rate(f"SUM({e})", km)
        out[f"{p}_recent7_per_day"] = f"{near} / 7"
        out[f"{p}_previous7_per_day"] = f"{old} / 7"
        out[f"{p}_delta7_per_day"] = f"({near} - {old}) / 7"
        out[f"{p}_active_type_fraction"] = "(" + " + ".join(
            f"CASE WHEN SUM(event_{c}_count) > 0 THEN 1.0::DOUBLE ELSE 0.0 END" for c in cs) + f") / {len(cs)}"
        out[f"{p}_recency_proximity"] = f"COALESCE(1.0::DOUBLE / (1 + MIN(back) FILTER (WHERE {e} > 0)), 0.0)"
    return ", ".join(f"{x} AS {n}" for n, x in out.items()), list(out)


_RF, _RN = _role_sql()


@query("a18_role_measures", Q.shape(f"SELECT gpsno, anchor_day, {_RF} FROM history GROUP BY gpsno, anchor_day", _RN, ["anchor_day"],
                                    f"{Q.DAILY_CTES}, {history_sql()}"))
def a18(spark, sf):
    return K.role_landmarks(V.daily(spark, sf), V.ANCHORS)


def _active(cs, kind="episodes"):
    return "(" + " + ".join(Q.n0(f"event_{c}_{kind}") for c in cs) + ") > 0"


CHAIN_DAYS = "chain_days AS (" + " UNION ALL ".join(
    f"SELECT gpsno, day_index, '{n}' AS chain, {_active(s)} AS src, {_active(d)} AS dst FROM daily" for n, (s, d) in codes.CHAINS.items()) + ")"
CHAINS = f"""chains AS (
  SELECT s.gpsno, a.anchor_day, s.chain, COUNT(*) FILTER (WHERE s.src AND s.dst) / a.anchor_day::DOUBLE AS cooccur_per_day,
         COUNT(*) FILTER (WHERE s.src AND s.dst) / GREATEST(COUNT(*) FILTER (WHERE s.src), 1)::DOUBLE AS cooccur_given_source,
         COUNT(*) FILTER (WHERE s.src AND EXISTS (SELECT 1 FROM chain_days t WHERE t.gpsno = s.gpsno AND t.chain = s.chain AND t.dst
           AND t.day_index > s.day_index AND t.day_index <= LEAST(s.day_index + 3, a.anchor_day)))
           / GREATEST(COUNT(*) FILTER (WHERE s.src), 1)::DOUBLE AS within3_given_source,
         COUNT(*) FILTER (WHERE s.src AND EXISTS (SELECT 1 FROM chain_days t WHERE t.gpsno = s.gpsno AND t.chain = s.chain AND t.dst
           AND t.day_index > s.day_index AND t.day_index <= LEAST(s.day_index + 7, a.anchor_day)))
           / GREATEST(COUNT(*) FILTER (WHERE s.src), 1)::DOUBLE AS within7_given_source
  FROM chain_days s JOIN {Q.anchor_values(V.ANCHORS)} ON s.day_index <= a.anchor_day GROUP BY s.gpsno, a.anchor_day, s.chain)"""
CHAIN_CTES = f"{Q.DAILY_CTES}, {CHAIN_DAYS}, {CHAINS}"
COOCCUR, FOLLOW = ["cooccur_per_day", "cooccur_given_source"], ["within3_given_source", "within7_given_source"]


@query("a19_cooccurrence", Q.shape(f"SELECT gpsno, anchor_day, chain, {', '.join(COOCCUR)} FROM chains", COOCCUR, ["anchor_day"], CHAIN_CTES))
def a19(spark, sf):
    return K.chain_landmarks(V.daily(spark, sf), V.ANCHORS).select("gpsno", "anchor_day", "chain", *COOCCUR)


@query("a20_directed_followup", Q.shape(f"SELECT gpsno, anchor_day, chain, {', '.join(FOLLOW)} FROM chains", FOLLOW, ["anchor_day"], CHAIN_CTES))
def a20(spark, sf):
    return K.chain_landmarks(V.daily(spark, sf), V.ANCHORS).select("gpsno", "anchor_day", "chain", *FOLLOW)


_TYPES = [f"role_{r}_active_type_fraction" for r in codes.ROLES]


@query("a21_active_types", Q.shape(f"SELECT gpsno, anchor_day, {', '.join(_TYPES)} FROM (SELECT gpsno, anchor_day, {_RF} FROM history GROUP BY gpsno, anchor_day) r",
                                   _TYPES, ["anchor_day"], f"{Q.DAILY_CTES}, {history_sql()}"))
def a21(spark, sf):
    return K.role_landmarks(V.daily(spark, sf), V.ANCHORS).select("gpsno", "anchor_day", *_TYPES)


_cells = lambda columns, source: f"(SELECT {' + '.join(f'COUNT({c})' for c in columns)} FROM {source})"
_chain_columns = 2 * len(codes.CHAINS)
_steps = (("base", len(_NAMES), _cells(_NAMES, "landmarks")), ("roles", len(_RN), _cells(_RN, "roles")),
          ("cooccurrence", _chain_columns, _cells(COOCCUR, "chains")), ("directed_chains", _chain_columns, _cells(FOLLOW, "chains")))


@query("p27_nested_feature_sets", f"WITH {Q.DAILY_CTES}, {history_sql()}, landmarks AS (SELECT gpsno, anchor_day, {_FIELDS} FROM history GROUP BY gpsno, anchor_day), "
       f"roles AS (SELECT gpsno, anchor_day, {_RF} FROM history GROUP BY gpsno, anchor_day), {CHAIN_DAYS}, {CHAINS}, "
       "steps AS (" + " UNION ALL ".join(f"SELECT {i} AS no, '{n}' AS feature_set, {k} AS columns, {c} AS cells" for i, (n, k, c) in enumerate(_steps)) + ") "
       "SELECT feature_set, CAST(SUM(columns) OVER up AS BIGINT) AS columns, CAST(SUM(cells) OVER up AS BIGINT) AS observed_cells FROM steps WINDOW up AS (ORDER BY no)")
def p27(spark, sf):
    df, sets = K.causal_landmarks(V.daily_table(spark, sf), V.ANCHORS)
    row = df.agg(*[F.count(c).alias(c) for c in dict.fromkeys(c for cs in sets.values() for c in cs)])
    add = lambda cs: F.aggregate(F.array(*cs), F.lit(0).cast("long"), lambda a, b: a + b)
    items = [F.struct(F.lit(k).alias("feature_set"), F.lit(len(cs)).alias("columns"), add(cs).alias("observed_cells")) for k, cs in sets.items()]
    return row.select(F.explode(F.array(*items)).alias("_x")).select("_x.*")


# --- scalers --------------------------------------------------------------------------

SCALED = V.MODEL_FEATURES
TRAIN_DAYS = 20
TRAIN = f"day_index <= {TRAIN_DAYS} AND CAST(gpsno AS BIGINT) % 5 <> 0"


def _long_sql(features, where, extra=""):
    return " UNION ALL ".join(f"SELECT {extra}'{f}' AS feature, {str(scaling.is_count_feature(f)).upper()} AS count_like, "
                              f"{str(f in V.FLAGS).upper()} AS boolean, CAST({'CAST(' + f + ' AS INTEGER)' if f in V.FLAGS else f} AS DOUBLE) AS value "
                              f"FROM daily WHERE {where}" for f in features)


FIT = f"""train AS ({_long_sql(SCALED, TRAIN)}),
logged AS (SELECT t.feature, boolean, count_like AND m.low0 >= 0 AND NOT boolean AS log1p,
                  CASE WHEN count_like AND m.low0 >= 0 THEN LN(1 + value) ELSE value END AS v
           FROM train t JOIN (SELECT feature, MIN(value) AS low0 FROM train GROUP BY feature) m USING (feature) WHERE value IS NOT NULL),
bounds AS (SELECT feature, QUANTILE_CONT(v, 0.01) AS low, QUANTILE_CONT(v, 0.99) AS high FROM logged GROUP BY feature),
params AS (SELECT l.feature, l.log1p, l.boolean, CASE WHEN l.boolean THEN 0.0 ELSE b.low END AS low, CASE WHEN l.boolean THEN 1.0 ELSE b.high END AS high,
                  CASE WHEN l.boolean THEN 0.0 ELSE QUANTILE_CONT(LEAST(GREATEST(v, low), high), 0.5) END AS median,
                  CASE WHEN l.boolean THEN 1.0 ELSE QUANTILE_CONT(LEAST(GREATEST(v, low), high), 0.75)
                    - QUANTILE_CONT(LEAST(GREATEST(v, low), high), 0.25) END AS iqr, COUNT(*) AS observed
           FROM logged l JOIN bounds b USING (feature) GROUP BY l.feature, l.log1p, l.boolean, b.low, b.high),
fitted AS (SELECT feature, log1p, boolean, low, high, median, CASE WHEN iqr < 0.000001 THEN 1.0 ELSE iqr END AS scale, observed FROM params)"""
PARAM_DOUBLES = ["low", "high", "median", "scale"]


def training(daily):
    return daily.where((F.col("day_index") <= TRAIN_DAYS) & (F.col("gpsno").cast("long") % 5 != 0))


def train_days(spark, sf):
    return training(V.daily(spark, sf))


BOOLEANS = V.FLAGS


@query("a22_iqr_scaler_fit", Q.shape("SELECT * FROM fitted", PARAM_DOUBLES, ctes=f"{Q.DAILY_CTES}, {FIT}"))
def a22(spark, sf):
    return scaling.fit_iqr_scaler(train_days(spark, sf), SCALED, BOOLEANS)


@query("a22_iqr_scaler_fit_unit_floor", Q.shape("SELECT feature, log1p, boolean, low, high, median, GREATEST(iqr, 1.0) AS scale, observed FROM params",
                                                PARAM_DOUBLES, ctes=f"{Q.DAILY_CTES}, {FIT}"))
def a22_unit(spark, sf):
    return scaling.fit_iqr_scaler(train_days(spark, sf), SCALED, BOOLEANS, unit_floor=True)


STD_FEATURES = V.NUMBERS
_slog = "SIGN(value) * LN(1 + ABS(value))"
FIT_STD = f"""std_train AS (SELECT feature, {_slog} AS v FROM ({_long_sql(STD_FEATURES, TRAIN)}) x),
std_bounds AS (SELECT feature, QUANTILE_CONT(v, 0.01) AS low, QUANTILE_CONT(v, 0.99) AS high FROM std_train GROUP BY feature),
std_median AS (SELECT feature, low, high, QUANTILE_CONT(LEAST(GREATEST(v, low), high), 0.5) AS median FROM std_train JOIN std_bounds USING (feature)
               WHERE v IS NOT NULL GROUP BY feature, low, high),
std_fitted AS (SELECT feature, low, high, median, CASE WHEN sd > 0.000001 THEN sd ELSE 1.0 END AS scale, observed FROM (
  SELECT feature, low, high, median, STDDEV_POP(CASE WHEN v IS NULL THEN median ELSE LEAST(GREATEST(v, low), high) END) AS sd, COUNT(v) AS observed
  FROM std_train JOIN std_median USING (feature) GROUP BY feature, low, high, median) s)"""


@query("a23_std_scaler_fit", Q.shape("SELECT * FROM std_fitted", PARAM_DOUBLES, ctes=f"{Q.DAILY_CTES}, {FIT_STD}"))
def a23(spark, sf):
    return scaling.fit_std_scaler(train_days(spark, sf), STD_FEATURES)


NODE_METRICS = ("log_count", "log_episodes", "log_rate_100km", "log_rate_hour")


@query("a24_code_scale", Q.shape("SELECT event_code, metric, GREATEST(QUANTILE_CONT(v, 0.99), 0.05) AS scale, COUNT(*) AS observed FROM ("
                                 + " UNION ALL ".join(f"SELECT event_code, '{m}' AS metric, {m} AS v FROM nodes WHERE occurred = 1" for m in NODE_METRICS)
                                 + ") n GROUP BY event_code, metric", ["scale"], ["event_code"], f"{Q.DAILY_CTES}, {Q.DAY_TABLE}, {NODE_SQL}"))
def a24(spark, sf):
    nodes = D.event_node_features(V.day_table(spark, sf))
    return scaling.fit_code_scale(nodes, F.col("occurred") == 1, NODE_METRICS, logged=False)


def wide_sql(long: str, features, mark: str) -> str:
    """One row per entity-day: a column for each feature, and the marks of all features as one text."""
    return (f"SELECT gpsno, day_index, {', '.join(f"MAX(CASE WHEN feature = '{f}' THEN scaled END) AS {f}" for f in features)}, "
            f"STRING_AGG(CAST({mark} AS VARCHAR), '' ORDER BY feature) AS {mark} FROM ({long}) l GROUP BY gpsno, day_index")


DAY_KEYS = ["gpsno", "day_index"]


def wide(packed, features, mark: str):
    """A column for each feature of the scaled arrays, and the marks in the order of the features' names.

    Only entity-days that come more than once are brought together: the largest value of each feature, all marks.
    """
    order = sorted(range(len(features)), key=lambda i: features[i])
    if quality.duplicate_keys(packed.select(*DAY_KEYS), DAY_KEYS).isEmpty():
        marks = F.concat(*[F.col(mark)[i].cast("string") for i in order])
        return packed.select(*DAY_KEYS, *[F.col("scaled")[i].alias(f) for i, f in enumerate(features)], marks.alias(mark))
    ones = [F.sum(F.col(mark)[i]).cast("int").alias(f"_{i}") for i in order]
    days = packed.groupBy(*DAY_KEYS).agg(F.count(F.lit(1)).cast("int").alias("_n"), *[F.max(F.col("scaled")[i]).alias(f) for i, f in enumerate(features)], *ones)
    marks = F.concat(*[x for i in order for x in (F.repeat(F.lit("0"), F.col("_n") - F.col(f"_{i}")), F.repeat(F.lit("1"), F.col(f"_{i}")))])
    return days.select(*DAY_KEYS, *features, marks.alias(mark))


@query("a25_scaler_apply", Q.shape(wide_sql(f"""
    SELECT gpsno, day_index, feature, COALESCE(LEAST(GREATEST((LEAST(GREATEST(CASE WHEN log1p THEN LN(1 + GREATEST(value, 0)) ELSE value END, low), high) - median) / scale, -10), 10)
             * CASE WHEN value IS NULL THEN NULL ELSE 1 END, 0.0) AS scaled, CASE WHEN value IS NULL THEN 0 ELSE 1 END AS observed
    FROM ({_long_sql(SCALED, 'TRUE', 'gpsno, day_index, ')}) x JOIN fitted USING (feature)""", SCALED, "observed"), SCALED, ["day_index"],
    f"{Q.DAILY_CTES}, {FIT}"))
def a25(spark, sf):
    daily = V.daily_table(spark, sf)
    params = scaling.fit_iqr_scaler(training(daily), SCALED, BOOLEANS)
    cells = scaling.long_features(daily, DAY_KEYS, SCALED, packed=True)
    return wide(scaling.apply_iqr_scaler(cells, params, limit=10.0, features=SCALED), SCALED, "observed")


@query("a25_std_scaler_apply", Q.shape(wide_sql(f"""
    SELECT gpsno, day_index, feature, CASE WHEN value IS NULL THEN 0.0 ELSE (LEAST(GREATEST({_slog}, low), high) - median) / scale END AS scaled,
           CASE WHEN value IS NULL THEN 1 ELSE 0 END AS missing
    FROM ({_long_sql(STD_FEATURES, 'TRUE', 'gpsno, day_index, ')}) x JOIN std_fitted USING (feature)""", STD_FEATURES, "missing"), STD_FEATURES, ["day_index"],
    f"{Q.DAILY_CTES}, {FIT_STD}"))
def a25_std(spark, sf):
    daily = V.daily_table(spark, sf)
    scaler = scaling.RobustScaler.fit(training(daily), STD_FEATURES)
    cells = scaling.long_features(daily, DAY_KEYS, STD_FEATURES, packed=True)
    return wide(scaler.transform(cells, STD_FEATURES), STD_FEATURES, "missing")


@query("a26_base_hazard", Q.shape("""SELECT anchor_day, COUNT(first_event_day) AS events, SUM(COALESCE(first_event_day, horizon_days)) AS person_days,
    LEAST(GREATEST(COUNT(first_event_day) / CAST(SUM(COALESCE(first_event_day, horizon_days)) AS DOUBLE), 0.0001), 0.1) AS base_hazard
    FROM outcomes GROUP BY anchor_day""", ["base_hazard"], ["anchor_day", "person_days"], OUTCOME_CTES))
def a26(spark, sf):
    return L.base_hazard(outcomes(spark, sf), "anchor_day")


def future_groups_sql(groups, horizon):
    parts = ", ".join(f"""CASE WHEN MAX(CASE WHEN {_active(cs)} THEN 1 ELSE 0 END) OVER (PARTITION BY gpsno ORDER BY day_index
        ROWS BETWEEN 1 FOLLOWING AND {horizon} FOLLOWING) = 1 THEN 1 ELSE 0 END AS future_{g}""" for g, cs in groups.items())
    return f"future AS (SELECT gpsno, day_index, {parts} FROM daily)"


FUTURE = future_groups_sql(codes.AUX_GROUPS, 7)
LAST_FULL = V.LAST_DAY - 7 - 7


@query("a27_positive_weights", Q.shape("SELECT target, COUNT(*) AS cells, SUM(y) AS positives, LEAST(GREATEST((COUNT(*) - SUM(y)) / CAST(GREATEST(SUM(y), 1) AS DOUBLE), 1.0), 20.0) AS positive_weight FROM ("
                                       + " UNION ALL ".join(f"SELECT 'future_{g}' AS target, future_{g} AS y FROM future WHERE day_index <= {LAST_FULL}" for g in codes.AUX_GROUPS)
                                       + ") f GROUP BY target", ["positive_weight"], ["positives"], f"{Q.DAILY_CTES}, {FUTURE}"))
def a27(spark, sf):
    t = L.future_group_occurrence(V.daily(spark, sf), codes.AUX_GROUPS, 7)
    return L.positive_weights(t, [f"future_{g}" for g in codes.AUX_GROUPS], LAST_FULL)


@query("a28_code_support", Q.shape("""SELECT event_code, COUNT(DISTINCT gpsno) AS support, 1 + 20.0::DOUBLE / (1 + COUNT(DISTINCT gpsno)) AS rarity
    FROM long_codes WHERE n > 0 GROUP BY event_code""", ["rarity"], ["event_code"], f"{Q.DAILY_CTES}, {Q.LONG_CODES}"))
def a28(spark, sf):
    return L.code_support(K.active_code_days(V.daily(spark, sf)))


EXPOSURE = f"""exposure AS (
  SELECT gpsno, anchor_day, SUM(GREATEST(COALESCE(distance_km, 0), 0)) AS km, SUM(GREATEST(COALESCE(drive_hours, 0), 0)) AS hours,
         AVG(CAST(trajectory_recorded_today AS INTEGER)) AS trajectory_coverage, AVG(CAST(imu_recorded_today AS INTEGER)) AS imu_coverage,
         (SUM(COALESCE(LN(1 + ABS(imu_accel_peak_p99)), 0)) + SUM(COALESCE(LN(1 + ABS(imu_accel_variability_p90)), 0)) + SUM(COALESCE(LN(1 + ABS(imu_gyro_peak)), 0)))
           / GREATEST(COUNT(imu_accel_peak_p99) + COUNT(imu_accel_variability_p90) + COUNT(imu_gyro_peak), 1) AS control_imu
  FROM history GROUP BY gpsno, anchor_day)"""
CODE_TOTALS = f"""code_totals AS (
  SELECT l.gpsno, l.event_code, a.anchor_day, SUM(n) AS total, COUNT(*) FILTER (WHERE n > 0) AS active_days,
         SUM(CASE WHEN a.anchor_day - day_index < 14 THEN n ELSE 0 END) AS recent14, MAX(CASE WHEN n > 0 THEN day_index END) AS last_day
  FROM long_codes l JOIN {Q.anchor_values(V.SCORE_ANCHORS)} ON l.day_index <= a.anchor_day GROUP BY l.gpsno, l.event_code, a.anchor_day)"""
BURDEN = """burden AS (
  SELECT *, LN(1 + 1000 * total / (km + 100)) + 0.40::DOUBLE * LN(1 + 100 * total / (hours + 1)) + 0.80::DOUBLE * active_days / anchor_day
         + 0.25::DOUBLE * LN(1 + LEAST(GREATEST(recent - past, 0) / (past + 0.10::DOUBLE), 5)) AS burden
  FROM (SELECT c.*, e.km, e.hours, recent14 / LEAST(14, c.anchor_day) AS recent,
               CASE WHEN c.anchor_day > 14 THEN (total - recent14) / (c.anchor_day - 14) ELSE 0.0 END AS past
        FROM code_totals c JOIN exposure e USING (gpsno, anchor_day) WHERE total > 0) b)"""
SCORE_CTES = f"{Q.DAILY_CTES}, {history_sql(V.SCORE_ANCHORS)}, {Q.LONG_CODES}, {EXPOSURE}, {CODE_TOTALS}, {BURDEN}"


@query("a29_event_burden", Q.shape("SELECT gpsno, anchor_day, event_code, burden FROM burden", ["burden"], ["anchor_day", "event_code"], SCORE_CTES))
def a29(spark, sf):
    daily = V.daily_table(spark, sf)
    exposure = K.exposure_totals(daily, V.SCORE_ANCHORS)
    return scoring.event_burden(K.code_totals(K.active_code_days(daily), V.SCORE_ANCHORS), exposure)


def group_values(groups, name):
    return f"{name}_table AS (SELECT * FROM (VALUES " + ", ".join(f"('{g}', {c})" for g, cs in groups.items() for c in cs) + f") v({name}, event_code))"


def weights_sql(groups, name, out):
    return f"""{group_values(groups, name)}, {out} AS (
  SELECT {name}, event_code, importance, 0.5::DOUBLE / cnt + 0.5::DOUBLE * CASE WHEN whole > 0 THEN importance / whole ELSE 1.0::DOUBLE / cnt END AS weight
  FROM (SELECT t.{name}, t.event_code, COALESCE(i.delta, 0.0) AS importance, COUNT(*) OVER (PARTITION BY t.{name}) AS cnt,
               SUM(COALESCE(i.delta, 0.0)) OVER (PARTITION BY t.{name}) AS whole
        FROM {name}_table t LEFT JOIN importance i USING (event_code)) w)"""


@query("a30_shrunk_weights", Q.shape("SELECT * FROM state_weights", ["importance", "weight"], ["event_code"],
                                     f"{Q.CLEAN}, {Q.IMPORTANCE}, {weights_sql(codes.STATES, 'state', 'state_weights')}"))
def a30(spark, sf):
    return scoring.shrink_weights(V.importance(spark, sf), codes.STATES)


A_STATES = ("upstream", "control", "proximal", "history", "quality")
SIGNALS = f"""{Q.IMPORTANCE}, {weights_sql(codes.STATES, 'state', 'state_weights')}, signals AS (
  SELECT e.gpsno, e.anchor_day, {', '.join(f"COALESCE({s}_event, 0.0) AS {s}_event" for s in A_STATES)}, e.control_imu, e.trajectory_coverage, e.imu_coverage
  FROM exposure e LEFT JOIN (
    SELECT gpsno, anchor_day, {', '.join(f"SUM(CASE WHEN state = '{s}' THEN burden * weight ELSE 0 END) AS {s}_event" for s in A_STATES)}
    FROM burden JOIN state_weights USING (event_code) GROUP BY gpsno, anchor_day) b USING (gpsno, anchor_day))"""
SIGNAL_DOUBLES = [f"{s}_event" for s in A_STATES] + ["control_imu", "trajectory_coverage", "imu_coverage"]


@query("a31_state_signals", Q.shape("SELECT * FROM signals", SIGNAL_DOUBLES, ["anchor_day"], f"{SCORE_CTES}, {SIGNALS}"))
def a31(spark, sf):
    daily = V.daily_table(spark, sf)
    exposure = K.exposure_totals(daily, V.SCORE_ANCHORS)
    burden = scoring.event_burden(K.code_totals(K.active_code_days(daily), V.SCORE_ANCHORS), exposure)
    return scoring.state_signals(burden, scoring.shrink_weights(V.importance(spark, sf), codes.STATES), exposure)


# --- evaluation -----------------------------------------------------------------------

RATES = ["brier", "accuracy", "recall", "specificity", "f1"]


@query("a32_binary_metrics", Q.shape(binary_sql("predictions", ["anchor_day"]), RATES, ["anchor_day"], Q.PREDICTIONS))
def a32(spark, sf):
    return M.binary_metrics(V.predictions(spark, sf), ["anchor_day"])


@query("a33_ranking_metrics", Q.shape(auc_sql("predictions", ["anchor_day"]), ["roc_auc", "pr_auc"], ["anchor_day"], Q.PREDICTIONS))
def a33(spark, sf):
    return M.ranking_metrics(V.predictions(spark, sf), ["anchor_day"])


from telerisk.functions.columns import POISSON_BLOCK, poisson_steps  # noqa: E402

SAMPLES = 1000
SIZES = [1 << j for j in range(POISSON_BLOCK.bit_length())]


def _draw(size):
    """Steps at or below the hash, counted in a list."""
    first, steps = poisson_steps(size)
    return f"{first} + len([t FOR t IN ['" + "', '".join(steps) + "'] IF t <= head])"


def _boot(cell, out):
    """Weight of each distinct cell and replicate: draws for blocks of 1,024 entities and for the binary digits of the rest."""
    c = ", ".join(cell)
    return f"""{out}_cells AS (SELECT {c}, COUNT(*) AS n, MIN(gpsno) AS id FROM predictions WHERE anchor_day = 20 GROUP BY {c}),
{out}_parts AS (SELECT c.*, size, 0 AS i FROM {out}_cells c, (SELECT UNNEST({SIZES[:-1]}) AS size) s WHERE (n // size) % 2 = 1
  UNION ALL SELECT *, {POISSON_BLOCK}, UNNEST(RANGE(1, n // {POISSON_BLOCK} + 1)) FROM {out}_cells),
{out}_heads AS (SELECT p.*, replicate, substr(md5('2026:' || CAST(replicate AS VARCHAR) || ':' || id || CASE WHEN size > 1 THEN ':' || CAST(size AS VARCHAR) ELSE '' END
  || CASE WHEN i > 0 THEN ':' || CAST(i AS VARCHAR) ELSE '' END), 1, 8) AS head FROM {out}_parts p, (SELECT UNNEST(RANGE({SAMPLES})) AS replicate) b),
{out} AS (SELECT {c}, replicate, SUM(CASE {' '.join(f'WHEN size = {k} THEN {_draw(k)}' for k in SIZES)} END) AS w FROM {out}_heads GROUP BY {c}, replicate)"""


def _weighted_auc(score, out, boot):
    return f"""{out} AS (SELECT replicate, CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0 THEN SUM(pos * (below + neg / 2.0::DOUBLE)) / (SUM(pos)::DOUBLE * SUM(neg)) END AS auc FROM (
  SELECT replicate, pos, neg, COALESCE(SUM(neg) OVER (PARTITION BY replicate ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT replicate, {score} AS s, SUM(w * label) AS pos, SUM(w * (1 - label)) AS neg FROM {boot} GROUP BY replicate, {score}) c) d GROUP BY replicate)"""


ONE_BOOT = f"""boot AS (SELECT probability, label, replicate, {_draw(1)} AS w FROM (SELECT *, substr(md5(concat_ws(':', '2026', replicate, gpsno)), 1, 8) AS head
  FROM (SELECT * FROM predictions WHERE anchor_day = 20) p, (SELECT UNNEST(RANGE({SAMPLES})) AS replicate) b) h), {_weighted_auc('probability', 'auc_new', 'boot')}"""
BOOT = (f"{_boot(['probability', 'prior_probability', 'label'], 'pairs')}, {_weighted_auc('probability', 'auc_new', 'pairs')}, "
        f"{_weighted_auc('prior_probability', 'auc_prior', 'pairs')}")


@query("a34_auc_interval", Q.shape("SELECT QUANTILE_CONT(auc, 0.025) AS auc_lower, QUANTILE_CONT(auc, 0.975) AS auc_upper, COUNT(auc) AS valid_bootstraps FROM auc_new",
                                   ["auc_lower", "auc_upper"], ctes=f"{Q.PREDICTIONS}, {ONE_BOOT}"))
def a34(spark, sf):
    return M.auc_interval(V.predictions(spark, sf).where("anchor_day = 20"), seed=2026, samples=SAMPLES)


@query("a34_paired_interval", Q.shape("""SELECT QUANTILE_CONT(n.auc - p.auc, 0.025) AS delta_lower, QUANTILE_CONT(n.auc - p.auc, 0.975) AS delta_upper,
    COUNT(n.auc - p.auc) AS valid_bootstraps FROM auc_new n JOIN auc_prior p USING (replicate)""", ["delta_lower", "delta_upper"],
    ctes=f"{Q.PREDICTIONS}, {BOOT}"))
def a34_paired(spark, sf):
    return M.paired_interval(pair(spark, sf), seed=2026, samples=SAMPLES)


@query("a35_metrics_by_group", Q.shape(f"""SELECT b.*, r.roc_auc, r.pr_auc FROM ({binary_sql('predictions', ['anchor_day', 'fold'])}) b
    JOIN ({auc_sql('predictions', ['anchor_day', 'fold'])}) r USING (anchor_day, fold)""", [*RATES, "roc_auc", "pr_auc"], ["anchor_day", "fold"], Q.PREDICTIONS))
def a35(spark, sf):
    return M.score_binary(V.predictions(spark, sf), ["anchor_day", "fold"])


@query("a37_ensemble_mean", Q.shape("""SELECT gpsno, anchor_day, 2 AS members, (probability + prior_probability) / 2 AS probability,
    ABS(probability - prior_probability) / SQRT(2.0::DOUBLE) AS probability_std FROM predictions""", ["probability", "probability_std"],
    ["anchor_day", "members"], Q.PREDICTIONS))
def a37(spark, sf):
    p = V.predictions(spark, sf)
    return M.ensemble_long([p, p.withColumn("probability", F.col("prior_probability"))], ["gpsno", "anchor_day"], "probability")


@query("a38_correlations", Q.shape("""SELECT anchor_day, CORR(probability, prior_probability) AS pearson, CORR(ra, rb) AS spearman FROM (
    SELECT *, RANK() OVER (PARTITION BY anchor_day ORDER BY probability) + (COUNT(*) OVER (PARTITION BY anchor_day, probability) - 1) / 2.0::DOUBLE AS ra,
           RANK() OVER (PARTITION BY anchor_day ORDER BY prior_probability) + (COUNT(*) OVER (PARTITION BY anchor_day, prior_probability) - 1) / 2.0::DOUBLE AS rb
    FROM predictions) r GROUP BY anchor_day""", ["pearson", "spearman"], ["anchor_day"], Q.PREDICTIONS))
def a38(spark, sf):
    return M.correlations(V.predictions(spark, sf), "probability", "prior_probability", ["anchor_day"])


@query("a39_first_and_median", Q.shape("""SELECT l_returnflag, MIN_BY(l_orderkey, l_orderkey * 10 + l_linenumber) AS first_order,
    QUANTILE_CONT(l_extendedprice, 0.5) AS median_price FROM lineitem GROUP BY l_returnflag""", ["median_price"]))
def a39(spark, sf):
    from telerisk.operators.ordered import metric_quantiles
    li = V.table(spark, sf, "lineitem")
    first = li.groupBy("l_returnflag").agg(F.min_by("l_orderkey", F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_order"))
    median = metric_quantiles(li, ["l_returnflag"], "l_extendedprice", {"median_price": 0.5}).drop("n_values")
    return first.join(median, "l_returnflag")


FOLD_DELTA = f"""fold_auc AS (SELECT n.fold, n.roc_auc AS new_auc, p.roc_auc AS prior_auc FROM ({auc_sql('at20', ['fold'])}) n
  JOIN ({auc_sql('at20', ['fold'], 'prior_probability')}) p USING (fold))"""


@query("a40_acceptance_gate", Q.shape(f"""
    SELECT delta_auc, nonnegative_folds, brier_change, delta_auc > 0 AND nonnegative_folds >= 3 AND brier_change <= 0.005
             AND NOT (delta_auc < 0.01 AND delta_lower <= 0 AND delta_upper >= 0) AS passes
    FROM (SELECT (SELECT roc_auc FROM ({auc_sql('at20')}) x) - (SELECT roc_auc FROM ({auc_sql('at20', score='prior_probability')}) y) AS delta_auc,
                 (SELECT COUNT(*) FROM fold_auc WHERE new_auc >= prior_auc) AS nonnegative_folds,
                 (SELECT AVG((probability - label) * (probability - label)) - AVG((prior_probability - label) * (prior_probability - label)) FROM at20) AS brier_change,
                 (SELECT QUANTILE_CONT(n.auc - p.auc, 0.025) FROM auc_new n JOIN auc_prior p USING (replicate)) AS delta_lower,
                 (SELECT QUANTILE_CONT(n.auc - p.auc, 0.975) FROM auc_new n JOIN auc_prior p USING (replicate)) AS delta_upper) g""",
    ["delta_auc", "brier_change"], ctes=f"{Q.PREDICTIONS}, at20 AS (SELECT * FROM predictions WHERE anchor_day = 20), {BOOT}, {FOLD_DELTA}"))
def a40(spark, sf):
    p = V.predictions(spark, sf).where("anchor_day = 20")
    both = pair(spark, sf)
    folds = M.paired_auc(both.join(p.select("gpsno", "fold"), "gpsno"), ["fold"])
    one = lambda df: df.withColumn("_k", F.lit(0))
    sq = lambda c: F.avg((F.col(c) - F.col("label")) * (F.col(c) - F.col("label")))
    row = (one(M.paired_auc(both)).join(one(folds.agg(F.count_if(F.col("delta_auc") >= 0).alias("nonnegative_folds"))), "_k")
           .join(one(p.agg((sq("probability") - sq("prior_probability")).alias("brier_change"))), "_k")
           .join(one(M.paired_interval(both, 2026, SAMPLES)), "_k"))
    c = F.col
    return row.select("delta_auc", "nonnegative_folds", "brier_change", M.effect_gate(
        c("delta_auc"), c("nonnegative_folds"), c("brier_change"), c("delta_lower"), c("delta_upper")).alias("passes"))


@query("a40_alignment_gate", Q.shape("""
    WITH at20 AS (SELECT *, 100 - 100 * prior_probability AS safety_score FROM predictions WHERE anchor_day = 20),
    n AS (SELECT CAST(FLOOR(COUNT(*) * 0.2::DOUBLE) AS BIGINT) AS k FROM at20),
    top AS (SELECT gpsno FROM (SELECT gpsno, ROW_NUMBER() OVER (ORDER BY probability DESC, md5(gpsno)) AS r FROM at20) t WHERE r <= (SELECT k FROM n)),
    low AS (SELECT gpsno FROM (SELECT gpsno, ROW_NUMBER() OVER (ORDER BY safety_score, md5(gpsno)) AS r FROM at20) t WHERE r <= (SELECT k FROM n)),
    s AS (SELECT CORR(ra, rb) AS spearman FROM (SELECT RANK() OVER (ORDER BY probability) + (COUNT(*) OVER (PARTITION BY probability) - 1) / 2.0::DOUBLE AS ra,
            RANK() OVER (ORDER BY prior_probability) + (COUNT(*) OVER (PARTITION BY prior_probability) - 1) / 2.0::DOUBLE AS rb FROM at20) r),
    g AS (SELECT AVG(probability) FILTER (WHERE prior_probability >= 0.5) - AVG(probability) FILTER (WHERE prior_probability < 0.15) AS e_minus_a FROM at20)
    SELECT spearman, overlap, e_minus_a, spearman >= 0.55 AND overlap >= 0.5 AND e_minus_a >= 0.4 AS passes
    FROM (SELECT (SELECT spearman FROM s) AS spearman, (SELECT COUNT(*) FROM top JOIN low USING (gpsno)) / CAST((SELECT k FROM n) AS DOUBLE) AS overlap,
                 (SELECT e_minus_a FROM g) AS e_minus_a) z""", ["spearman", "overlap", "e_minus_a"]).replace("SELECT *", f"WITH {Q.PREDICTIONS} SELECT *", 1))
def a40_alignment(spark, sf):
    p = (V.predictions(spark, sf).where("anchor_day = 20").withColumn("safety_score", 100 - 100 * F.col("prior_probability"))
         .withColumn("risk", 100 - F.col("safety_score")))
    one = lambda df: df.withColumn("_k", F.lit(0))
    gap = p.agg((F.avg(F.when(F.col("prior_probability") >= 0.5, F.col("probability")))
                 - F.avg(F.when(F.col("prior_probability") < 0.15, F.col("probability")))).alias("e_minus_a"))
    row = (one(M.correlations(p, "probability", "prior_probability").select("spearman"))
           .join(one(M.overlap_share(p, "probability", "safety_score", 0.2).select("overlap")), "_k").join(one(gap), "_k"))
    g = codes.ALIGNMENT_GATE
    ok = (F.col("spearman") >= g["spearman"]) & (F.col("overlap") >= g["top20_overlap"]) & (F.col("e_minus_a") >= g["e_minus_a"])
    return row.select("spearman", "overlap", "e_minus_a", ok.alias("passes"))


@query("a41_survival_loss", Q.shape("""SELECT COUNT(*) AS entities, AVG(loss) AS survival_loss FROM (SELECT gpsno, AVG(
    -(CASE WHEN first_event_day IS NULL THEN horizon_days ELSE first_event_day - 1 END) * LN(1 - q) - CASE WHEN first_event_day IS NULL THEN 0 ELSE LN(q) END) AS loss
    FROM (SELECT *, 0.01::DOUBLE + probability / 8 AS q FROM predictions) p GROUP BY gpsno) e""", ["survival_loss"], ctes=Q.PREDICTIONS))
def a41(spark, sf):
    return L.survival_loss(V.predictions(spark, sf).withColumn("daily_hazard", 0.01 + F.col("probability") / 8))


@query("a42_prior_rate", Q.shape("SELECT AVG(label) AS prior FROM predictions WHERE anchor_day = 20", ["prior"], ctes=Q.PREDICTIONS))
def a42(spark, sf):
    return L.prior_rate(V.predictions(spark, sf), 20)
