"""Joins (J1-J18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from telerisk import codes
from telerisk.catalog import sqlviews as Q
from telerisk.catalog import views as V
from telerisk.catalog.registry import query
from telerisk.catalog.sources_sinks import bags
from telerisk.operators import daily as D
from telerisk.operators import imu as I
from telerisk.operators import labels as L
from telerisk.operators import landmarks as K
from telerisk.operators import metrics as M
from telerisk.operators import model, quality, scoring, tensors
from telerisk.operators import trajectory as T
from telerisk.session import materialise

P = V.PERIOD
COVER_DATES = [f"{s}_{e}_day" for s in ("event", "trajectory", "imu") for e in ("first", "last")]


@query("j1_coverage", Q.shape("SELECT * FROM coverage", ctes=Q.COVER_CTES, t=COVER_DATES))
def j1(spark, sf):
    return V.coverage(spark, sf)


@query("j2_calendar", Q.shape(f"""SELECT gpsno, energy_type, CAST(d.d AS DATE) AS day
    FROM profile, GENERATE_SERIES({Q.FIRST}, {Q.LAST}, INTERVAL 1 DAY) AS d(d)""", ctes=Q.PROFILE, t=["day"]))
def j2(spark, sf):
    return D.calendar(V.profile(spark, sf), P.first_day, P.last_day)


FULL_MOTION = D.TRAJECTORY_FIELDS
FULL_SENSOR = D.IMU_FIELDS
FULL_COVER = Q.coverage_body("trajectory_daily", "imu_daily")
FULL_CTES = ", ".join((Q.PROFILE, Q.EVENT_CTES, Q.TRAJECTORY_CTES, Q.IMU_CTES, FULL_COVER,
                       f"full_daily AS ({Q.daily_body('trajectory_daily', 'imu_daily', FULL_MOTION, FULL_SENSOR, p90=True)})"))
FULL_DOUBLES = ["event_speed_p90", "distance_km", "drive_hours", "gps_distance_check_km", "night_distance_km", "speed_p50", "speed_p90",
                "speed_change_p90", "turn_rate_p90", "imu_accel_p95_median", "imu_accel_peak_p99", "imu_accel_variability_p90",
                "imu_gyro_p95_p90", "imu_gyro_peak", "imu_speed_p50", "events_per_100km", "events_per_drive_hour"]


def full_trajectory_daily(spark, sf):
    from telerisk.operators.episodes import in_rule_window
    return T.trajectory_daily(T.with_steps(T.best_fix(in_rule_window(V.trajectory(spark, sf), "ts", P.first_day, P.last_day))),
                              stage=materialise)


def full_imu_windows(spark, sf):
    from telerisk.operators.episodes import in_rule_window
    return I.imu_windows(I.motion_samples(in_rule_window(V.imu(spark, sf), "ts", P.first_day, P.last_day)), stage=materialise)


@query("j3_dense_entity_days", Q.shape("SELECT * EXCLUDE (day_index) FROM full_daily", FULL_DOUBLES, ctes=FULL_CTES, t=["day"]))
def j3(spark, sf):
    """The whole preprocessing plan: events, fixes and sensor samples to the 89-column table."""
    from telerisk.plans.preprocess import build
    return build(V.profile(spark, sf), V.event_log(spark, sf), V.trajectory(spark, sf), V.imu(spark, sf), P, V.GAP_S).daily


ANCHOR_DATES = "(VALUES " + ", ".join(f"(DATE '{a}')" for a in P.anchors) + ") AS a(anchor_date)"
LABELS = f"""labels AS (
  SELECT p.gpsno, a.anchor_date, COUNT(h.event_ts) AS accident_events, MIN(h.event_ts) AS first_accident_ts
  FROM profile p JOIN {ANCHOR_DATES} ON TRUE
  LEFT JOIN targets h ON h.gpsno = p.gpsno AND DATE_DIFF('day', a.anchor_date, CAST(h.event_ts AS DATE)) BETWEEN 1 AND {P.horizon}
  GROUP BY p.gpsno, a.anchor_date)"""
FINAL = f"DATE '{P.final_anchor}'"
BAGS = f"""bags AS (
  SELECT gpsno, anchor_date, input_start, anchor_date AS input_end, anchor_date + {P.horizon} AS future_end,
         CASE label_status WHEN 'observed_positive' THEN 1 WHEN 'provisional_negative' THEN 0 END AS label, label_status,
         IF(label_status = 'target_unknown', NULL, accident_events) AS accident_events,
         IF(label_status = 'target_unknown', NULL, first_accident_ts) AS first_accident_ts, has_event_feed, has_trajectory, has_imu
  FROM (SELECT c.*, l.anchor_date, l.accident_events, l.first_accident_ts, GREATEST(l.anchor_date - {P.lookback - 1}, {Q.FIRST}) AS input_start,
               IF(l.anchor_date = {FINAL}, 'target_unknown', IF(NOT c.has_event_feed, 'unlabeled_no_event_feed',
                  IF(l.accident_events = 0, 'provisional_negative', 'observed_positive'))) AS label_status
        FROM coverage c JOIN labels l ON l.gpsno = c.gpsno) s)"""
LABEL_CTES = f"{Q.COVER_CTES}, {Q.TARGETS}, {LABELS}"
BAG_CTES = f"{LABEL_CTES}, {BAGS}"
BAG_DATES = ["anchor_date", "input_start", "input_end", "future_end", "first_accident_ts"]


@query("j4_anchor_event_counts", Q.shape("SELECT * FROM labels", ctes=LABEL_CTES, t=["anchor_date", "first_accident_ts"]))
def j4(spark, sf):
    counts = L.count_after_anchor(V.targets(spark, sf), P.anchors, P.horizon)
    return (L.anchor_grid(V.profile(spark, sf), P.anchors).join(counts, ["gpsno", "anchor_date"], "left")
            .withColumn("accident_events", F.coalesce("accident_events", F.lit(0))))


@query("j5_label_index", Q.shape("SELECT * FROM bags", b=["label"], ctes=BAG_CTES, t=BAG_DATES))
def j5(spark, sf):
    return bags(spark, sf)


@query("j6_landmark_history", Q.shape(f"""
    SELECT d.gpsno, a.anchor_day, COUNT(*) AS history_days, SUM(COALESCE(distance_km, 0)) AS km,
           SUM(COALESCE(event_total_count, 0)) AS events
    FROM daily d JOIN {Q.anchor_values(V.ANCHORS)} ON d.day_index <= a.anchor_day GROUP BY d.gpsno, a.anchor_day""",
    ["km"], ["anchor_day", "events"], Q.DAILY_CTES))
def j6(spark, sf):
    w = K.history()
    return (V.daily(spark, sf).select("gpsno", F.col("day_index").alias("anchor_day"), F.count(F.lit(1)).over(w).alias("history_days"),
                                      K.total("distance_km").alias("km"), K.total("event_total_count").cast("long").alias("events"))
            .where(F.col("anchor_day").isin(*V.ANCHORS)))


OUTCOMES = f"""outcomes AS (
  SELECT d.gpsno, a.anchor_day, LEAST({V.HORIZON}, {V.LAST_DAY} - a.anchor_day) AS horizon_days,
         MIN(CASE WHEN COALESCE(event_11803_count, 0) + COALESCE(event_11804_count, 0) > 0 THEN d.day_index - a.anchor_day END) AS first_event_day,
         SUM(GREATEST(COALESCE(distance_km, 0), 0)) / LEAST({V.HORIZON}, {V.LAST_DAY} - a.anchor_day) AS future_km_per_day
  FROM daily d JOIN {Q.anchor_values(V.ANCHORS)}
    ON d.day_index > a.anchor_day AND d.day_index <= a.anchor_day + LEAST({V.HORIZON}, {V.LAST_DAY} - a.anchor_day)
  GROUP BY d.gpsno, a.anchor_day)"""
OUTCOME_CTES = f"{Q.DAILY_CTES}, {OUTCOMES}"


def outcomes(spark, sf, daily=None):
    return L.make_outcomes(daily if daily is not None else V.daily(spark, sf), V.ANCHORS, V.LAST_DAY, codes.TARGET_CODES, V.HORIZON)


@query("j7_future_outcomes", Q.shape("SELECT *, CASE WHEN first_event_day IS NULL THEN 0 ELSE 1 END AS label FROM outcomes",
                                     ["future_km_per_day"], ["anchor_day", "horizon_days", "first_event_day", "label"], OUTCOME_CTES))
def j7(spark, sf):
    return outcomes(spark, sf)


@query("j8_validated_merge", Q.shape("""
    SELECT o.o_orderkey, o.o_custkey, c.c_mktsegment FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey"""))
def j8(spark, sf):
    """Many-to-one merge after the one side passed its unique-key rule."""
    customer = V.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    quality.require(quality.unique_key(customer, ["c_custkey"]))
    return (V.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(customer, "c_custkey")
            .select("o_orderkey", F.col("c_custkey").alias("o_custkey"), "c_mktsegment"))


@query("j9_semi_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events)")
def j9(spark, sf):
    ids = V.table(spark, sf, "events").select(F.col("user_id").alias("o_custkey")).dropDuplicates()
    return V.table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(ids, "o_custkey", "left_semi")


@query("j10_anti_join", """SELECT CAST(c_custkey AS VARCHAR) AS gpsno FROM customer
    WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)""")
def j10(spark, sf):
    seen = V.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("gpsno")).dropDuplicates()
    return V.profile(spark, sf).select("gpsno").join(seen, "gpsno", "left_anti")


ROLE_TABLE = "role_table AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{r}', {c}, '{codes.EVENT_NAMES[c]}')" for r, cs in codes.ROLES.items() for c in cs) + ") v(role, event_type, name))"


@query("j11_code_lookup", Q.shape("""SELECT c.gpsno, r.role, r.name, COUNT(*) AS n FROM clean c
    JOIN role_table r USING (event_type) GROUP BY c.gpsno, r.role, r.name""", ctes=f"{Q.CLEAN}, {ROLE_TABLE}"))
def j11(spark, sf):
    dim = (scoring.code_table(spark, codes.ROLES, "role").select("role", F.col("event_code").alias("event_type"))
           .withColumn("name", scoring.code_name(F.col("event_type"))))
    return (V.clean_events(spark, sf).join(F.broadcast(dim), "event_type")  # one row per code
            .groupBy("gpsno", "role", "name").agg(F.count(F.lit(1)).alias("n")))


MEMBER_KEYS = ["gpsno", "anchor_day", "horizon_days", "label", "fold"]


@query("j12_ensemble_join", Q.shape("""
    SELECT gpsno, anchor_day, horizon_days, label, fold, probability AS probability_0, prior_probability AS probability_1,
           (probability + prior_probability) / 2 AS probability_2, (probability + prior_probability + (probability + prior_probability) / 2) / 3 AS probability
    FROM predictions""", ["probability_0", "probability_1", "probability_2", "probability"], ["anchor_day", "horizon_days", "label", "fold"],
    Q.PREDICTIONS))
def j12(spark, sf):
    p = V.predictions(spark, sf)
    second = p.withColumn("probability", F.col("prior_probability"))
    third = p.withColumn("probability", (F.col("probability") + F.col("prior_probability")) / 2)
    return M.ensemble_join([p, second, third], MEMBER_KEYS, "probability")


def pair(spark, sf):
    p = V.predictions(spark, sf).where("anchor_day = 20")
    return M.pair_predictions(p, p.select("gpsno", "label", F.col("prior_probability").alias("probability")))


@query("j13_paired_models", Q.shape("""SELECT gpsno, label, label AS label_prior, probability AS probability_new,
    prior_probability AS probability_prior, TRUE AS labels_agree FROM predictions WHERE anchor_day = 20""",
    ["probability_new", "probability_prior"], ["label", "label_prior"], Q.PREDICTIONS))
def j13(spark, sf):
    return pair(spark, sf)


BAG_FEATURES = V.MODEL_FEATURES
_bag_value = lambda f: f"CAST({f'CAST(d.{f} AS INTEGER)' if f in V.FLAGS else f'd.{f}'} AS DOUBLE)"


@query("j14_bag_tensor", Q.shape(f"""
    SELECT b.gpsno, b.anchor_date, o.o AS day_offset, CASE WHEN b.anchor_date - 19 + CAST(o.o AS INTEGER) >= {Q.FIRST} THEN 1 ELSE 0 END AS day_mask,
           {', '.join(f'{_bag_value(f)} AS {f}' for f in BAG_FEATURES)}, CONCAT({', '.join(f'CAST(CAST(d.{f} IS NOT NULL AS INTEGER) AS VARCHAR)' for f in BAG_FEATURES)}) AS value_mask
    FROM bags b CROSS JOIN (SELECT UNNEST(RANGE(20)) AS o) o
    LEFT JOIN daily d ON d.gpsno = b.gpsno AND d.day = b.anchor_date - 19 + CAST(o.o AS INTEGER)""",
    BAG_FEATURES, ["day_offset", "day_mask"], f"{Q.DAILY_CTES}, {Q.TARGETS}, {LABELS}, {BAGS}", ["anchor_date"]))
def j14(spark, sf):
    """Tensor rows, unfolded again so that every cell and mask is compared."""
    packed = tensors.bag_days(bags(spark, sf), V.daily(spark, sf), BAG_FEATURES, P.first_day, P.lookback)
    cell = F.posexplode(F.arrays_zip("day_mask", "x", "value_mask")).alias("day_offset", "_c")
    return packed.select("gpsno", "anchor_date", cell).select(
        "gpsno", "anchor_date", "day_offset", "_c.day_mask", *[F.col("_c.x")[i].alias(f) for i, f in enumerate(BAG_FEATURES)],
        F.array_join(F.transform("_c.value_mask", lambda m: m.cast("int").cast("string")), "").alias("value_mask"))


@query("j15_table_diff", Q.shape("""
    SELECT COUNT(*) FILTER (WHERE a.gpsno IS NOT NULL AND b.gpsno IS NOT NULL) AS matched,
           COUNT(*) FILTER (WHERE b.gpsno IS NULL) AS only_official, COUNT(*) FILTER (WHERE a.gpsno IS NULL) AS only_reproduced,
           MAX(ABS(a.probability - b.probability)) AS probability_max_error,
           COUNT(*) FILTER (WHERE a.gpsno IS NOT NULL AND b.gpsno IS NOT NULL AND a.label <> b.label) AS label_mismatches
    FROM (SELECT * FROM predictions WHERE fold <> 0) a
    FULL JOIN (SELECT gpsno, anchor_day, prior_probability AS probability, label FROM predictions WHERE fold <> 1) b USING (gpsno, anchor_day)""",
    ["probability_max_error"], ctes=Q.PREDICTIONS))
def j15(spark, sf):
    p = V.predictions(spark, sf)
    other = p.where("fold <> 1").withColumn("probability", F.col("prior_probability"))
    return M.table_diff(p.where("fold <> 0"), other, ["gpsno", "anchor_day"], ["probability"], ["label"])


@query("j17_landmark_grid", Q.shape(f"SELECT p.gpsno, a.anchor_day FROM profile p CROSS JOIN {Q.anchor_values(range(14, 31))}",
                                    b=["anchor_day"], ctes=Q.PROFILE))
def j17(spark, sf):
    return K.landmark_grid(V.profile(spark, sf), list(range(14, 31)))


@query("j18_code_partition", """WITH seen AS (SELECT DISTINCT """ + Q.CODE + """ AS event_code FROM events),
    """ + "state_table AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {c})" for s, cs in codes.STATES.items() for c in cs)
       + """) v(state, event_code))
    SELECT 'code_missing' AS rule, COUNT(*) AS violations FROM seen WHERE event_code <> 99999 AND event_code NOT IN (SELECT event_code FROM state_table)
    UNION ALL SELECT 'code_unknown', COUNT(*) FROM state_table WHERE event_code NOT IN (SELECT event_code FROM seen)
    UNION ALL SELECT 'code_in_two_groups', COUNT(*) FROM (SELECT event_code FROM state_table GROUP BY 1 HAVING COUNT(*) > 1) t
    UNION ALL SELECT 'seen_events', COUNT(*) FROM events""")
def j18(spark, sf):
    """The state table partitions the codes that occur in the log."""
    log = V.event_log(spark, sf).where(F.col("event_type") != V.UNLISTED)
    seen = log.select(F.col("event_type").alias("event_code")).dropDuplicates()
    table = scoring.code_table(spark, codes.STATES, "state")
    rule = lambda df, name: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
    return quality.union_all([
        rule(seen.join(table, "event_code", "left_anti"), "code_missing"), rule(table.join(seen, "event_code", "left_anti"), "code_unknown"),
        quality.unique_key(table, ["event_code"], "code_in_two_groups"), rule(V.table(spark, sf, "events"), "seen_events")])
