"""Window functions (W1-W17), neutralised scores (P23-P25) and whole scorecards (M7, M8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from telerisk import codes
from telerisk.catalog import sqlviews as Q
from telerisk.catalog import views as V
from telerisk.catalog.aggregates import (CODE_TOTALS, EXPOSURE, FUTURE, SCORE_CTES, SIGNALS, _active, history_sql, weights_sql)
from telerisk.catalog.joins import BAG_CTES, bags
from telerisk.catalog.registry import query
from telerisk.operators import daily as D
from telerisk.operators import episodes as E
from telerisk.operators import labels as L
from telerisk.operators import landmarks as K
from telerisk.operators import ordered, scoring, splits
from telerisk.operators import trajectory as T
from telerisk.session import materialise, shared_folder

P = V.PERIOD


@query("w1_episode_starts", Q.shape("SELECT gpsno, event_ts, event_type, lat, episode_start FROM episodes", ["lat"], ["event_type"],
                                    f"{Q.CLEAN}, {Q.EPISODES}", ["event_ts"]))
def w1(spark, sf):
    return V.marked(spark, sf).select("gpsno", "event_ts", "event_type", "lat", "episode_start")


def fixes(spark, sf):
    return T.best_fix(E.in_rule_window(V.trajectory(spark, sf), "ts", P.first_day, P.last_day))


@query("w2_previous_fix", Q.shape("SELECT gpsno, ts, previous_ts, previous_speed, previous_course, previous_lat, previous_lng FROM pairs",
                                  ["previous_speed", "previous_course", "previous_lat", "previous_lng"], ctes=f"{Q.TRAJECTORY}, {Q.STEPS}",
                                  t=["ts", "previous_ts"]))
def w2(spark, sf):
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    lagged = ordered.lag_across_slices(fixes(spark, sf), ["gpsno"], "ts", second, ["speed", "course", "lat", "lng"])
    return lagged.select("gpsno", "ts", *[F.col(f"_prev.{c}").alias(f"previous_{c}") for c in ("ts", "speed", "course", "lat", "lng")])


@query("w3_best_duplicate", Q.shape("SELECT gpsno, ts, source_file, speed, lat, distance_cm FROM best", ["speed", "lat"],
                                    ctes=f"{Q.TRAJECTORY}, {Q.STEPS}", t=["ts"]))
def w3(spark, sf):
    return fixes(spark, sf).select("gpsno", "ts", "source_file", "speed", "lat", "distance_cm")


@query("w4_day_index", Q.shape("SELECT gpsno, day, ROW_NUMBER() OVER (PARTITION BY gpsno ORDER BY day) AS day_index FROM daily",
                               ctes=Q.DAILY_CTES, t=["day"]))
def w4(spark, sf):
    return V.daily(spark, sf).select("gpsno", "day", "day_index")


_metrics = {
    "episodes_per_day": "COALESCE(e_total, 0) / anchor_day", "episodes_per_100km": "100 * COALESCE(e_total, 0) / (km + 100)",
    "recent7_per_day": "COALESCE(e_recent, 0) / 7", "previous7_per_day": "COALESCE(e_previous, 0) / 7",
    "recency_proximity": "COALESCE(EXP(-(anchor_day - last_e) / 14.0::DOUBLE), 0)", "counts_per_day": "COALESCE(n_total, 0) / anchor_day",
    "counts_per_100km": "CASE WHEN km > 0 THEN 100 * COALESCE(n_total, 0) / km ELSE 0.0 END",
    "counts_recent7_per_day": "COALESCE(n_recent, 0) / 7", "counts_previous7_per_day": "COALESCE(n_previous, 0) / 7"}
CODE_LANDMARKS = f"""code_landmarks AS (
  SELECT gpsno, anchor_day, event_code, {', '.join(f'{e} AS {n}' for n, e in _metrics.items())} FROM (
    SELECT l.gpsno, a.anchor_day, l.event_code, SUM(episodes) AS e_total, SUM(n) AS n_total,
           SUM(episodes) FILTER (WHERE a.anchor_day - day_index < 7) AS e_recent, SUM(n) FILTER (WHERE a.anchor_day - day_index < 7) AS n_recent,
           SUM(episodes) FILTER (WHERE a.anchor_day - day_index BETWEEN 7 AND 13) AS e_previous,
           SUM(n) FILTER (WHERE a.anchor_day - day_index BETWEEN 7 AND 13) AS n_previous,
           MAX(CASE WHEN episodes > 0 THEN day_index END) AS last_e
    FROM long_codes l JOIN {Q.anchor_values(V.ANCHORS)} ON l.day_index <= a.anchor_day GROUP BY l.gpsno, a.anchor_day, l.event_code) c
  JOIN exposure USING (gpsno, anchor_day))"""


@query("w5_code_prefix_sums", Q.shape("SELECT * FROM code_landmarks", list(_metrics), ["anchor_day", "event_code"],
                                      f"{Q.DAILY_CTES}, {history_sql()}, {EXPOSURE}, {Q.LONG_CODES}, {CODE_LANDMARKS}"))
def w5(spark, sf):
    return K.code_landmarks(V.daily(spark, sf), V.ANCHORS)


@query("w6_recent_vs_previous", Q.shape("""SELECT gpsno, day_index, recent, previous, recent - previous AS delta FROM (
    SELECT gpsno, day_index, SUM(COALESCE(distance_km, 0)) OVER (PARTITION BY gpsno ORDER BY day_index ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS recent,
           SUM(COALESCE(distance_km, 0)) OVER (PARTITION BY gpsno ORDER BY day_index ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING) AS previous FROM daily) w""",
    ["recent", "previous", "delta"], ["day_index"], Q.DAILY_CTES))
def w6(spark, sf):
    recent, previous = K.total("distance_km", K.last_days(7)), K.total("distance_km", K.last_days(7, skip=7))
    return V.daily(spark, sf).select("gpsno", "day_index", recent.alias("recent"), previous.alias("previous"), (recent - previous).alias("delta"))


@query("w7_future_groups", Q.shape("SELECT * FROM future", b=["day_index", *[f"future_{g}" for g in codes.AUX_GROUPS]],
                                   ctes=f"{Q.DAILY_CTES}, {FUTURE}"))
def w7(spark, sf):
    return L.future_group_occurrence(V.daily(spark, sf), codes.AUX_GROUPS, 7)


HORIZONS = (3, 5, 7, 10)


@query("w7_horizon_labels", Q.shape("SELECT gpsno, anchor_day, horizon_days, CASE WHEN available = 1 THEN seen ELSE 0 END AS label, available FROM ("
    + f"""SELECT d.gpsno, a.anchor_day, h.horizon_days, MAX(CASE WHEN d.day_index > a.anchor_day AND d.day_index <= a.anchor_day + h.horizon_days
            AND {_active(codes.TARGET_CODES, 'count')} THEN 1 ELSE 0 END) AS seen, CASE WHEN a.anchor_day + h.horizon_days <= {V.LAST_DAY} THEN 1 ELSE 0 END AS available
    FROM daily d, {Q.anchor_values(V.ANCHORS)}, (VALUES {', '.join(f'({h})' for h in HORIZONS)}) AS h(horizon_days)
    GROUP BY d.gpsno, a.anchor_day, h.horizon_days) x""", b=["anchor_day", "horizon_days", "label", "available"], ctes=Q.DAILY_CTES))
def w7_horizons(spark, sf):
    return L.horizon_labels(V.daily(spark, sf), V.ANCHORS, HORIZONS, V.LAST_DAY, codes.TARGET_CODES)


def _future_max(cs):
    n = "GREATEST(" + ", ".join(Q.n0(f"event_{c}_count") for c in cs) + ")"
    w = "OVER (PARTITION BY gpsno ORDER BY day_index ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"
    return f"MAX(CASE WHEN {n} > 0 THEN 1 ELSE 0 END) {w}", f"MAX(LN(1 + {n})) {w}"


_CHAIN_STATES = {s: codes.STATES[s] for s in codes.CHAIN_STATES}


@query("w7_future_magnitude", Q.shape("SELECT gpsno, day_index, " + ", ".join(
    f"{_future_max(cs)[0]} AS {s}_occurs, {_future_max(cs)[1]} AS {s}_magnitude" for s, cs in _CHAIN_STATES.items()) + " FROM daily",
    [f"{s}_magnitude" for s in _CHAIN_STATES], ["day_index", *[f"{s}_occurs" for s in _CHAIN_STATES]], Q.DAILY_CTES) + f" WHERE day_index + 3 <= {V.LAST_DAY}")
def w7_magnitude(spark, sf):
    return L.future_state_maxima(V.daily(spark, sf), _CHAIN_STATES, 3, V.LAST_DAY)


@query("w8_recency", Q.shape("""SELECT gpsno, day_index, CAST(day_index - last AS DOUBLE) AS days_since, COALESCE(EXP(-(day_index - last) / 14.0::DOUBLE), 0) AS decay,
    COALESCE(1.0::DOUBLE / (1 + day_index - last), 0) AS proximity FROM (
    SELECT gpsno, day_index, MAX(CASE WHEN event_total_count > 0 THEN day_index END) OVER (PARTITION BY gpsno ORDER BY day_index) AS last FROM daily) w""",
    ["days_since", "decay", "proximity"], ["day_index"], Q.DAILY_CTES))
def w8(spark, sf):
    t = F.col("day_index")
    back = t - F.max(F.when(F.col("event_total_count") > 0, t)).over(K.history())
    return V.daily(spark, sf).select("gpsno", "day_index", back.cast("double").alias("days_since"),
                                     F.coalesce(F.exp(-back / 14.0), F.lit(0.0)).alias("decay"),
                                     F.coalesce(1.0 / (1 + back), F.lit(0.0)).alias("proximity"))


DIMENSION_CODES = [c for cs in codes.DIMENSIONS.values() for c in cs]
STREAKS = f"""active_days AS (SELECT gpsno, day_index, CASE WHEN {_active(DIMENSION_CODES, 'count')} THEN 1 ELSE 0 END AS active FROM daily),
islands AS (SELECT gpsno, day_index, day_index - ROW_NUMBER() OVER (PARTITION BY gpsno ORDER BY day_index) AS island FROM active_days WHERE active = 1),
runs AS (SELECT gpsno, day_index, ROW_NUMBER() OVER (PARTITION BY gpsno, island ORDER BY day_index) AS run FROM islands),
streaks AS (SELECT a.gpsno, a.day_index, a.active, COALESCE(MAX(r.run) OVER (PARTITION BY a.gpsno ORDER BY a.day_index), 0) AS streak
            FROM active_days a LEFT JOIN runs r USING (gpsno, day_index))"""


@query("w9_longest_streak", Q.shape("SELECT * FROM streaks", b=["day_index", "active", "streak"], ctes=f"{Q.DAILY_CTES}, {STREAKS}"))
def w9(spark, sf):
    from telerisk.operators.labels import group_active
    return K.longest_streak(V.daily(spark, sf), group_active(DIMENSION_CODES, "count"))


def midrank(source: str, out: str, keys: tuple, positive: bool, name: str = "pct") -> str:
    """Mid-rank share of the development rows by pair counts over distinct values."""
    k = ", ".join(keys)
    vk = ", ".join(f"v.{x}" for x in keys)
    zero = "AND value > 0" if positive else ""
    guard = "s.value > 0" if positive else "TRUE"
    return f"""{out}_ref AS (SELECT {k}, value AS rv, COUNT(*) AS n FROM {source} WHERE is_development {zero} GROUP BY {k}, value),
{out}_val AS (SELECT DISTINCT {k}, value FROM {source}),
{out}_pct AS (SELECT {vk}, v.value, SUM(CASE WHEN r.rv < v.value THEN 2.0::DOUBLE * r.n WHEN r.rv = v.value THEN r.n ELSE 0 END) / (2.0::DOUBLE * SUM(r.n)) AS share
              FROM {out}_val v LEFT JOIN {out}_ref r USING ({k}) GROUP BY {vk}, v.value),
{out} AS (SELECT s.*, CASE WHEN {guard} THEN COALESCE(p.share, 0.0) ELSE 0.0 END AS {name} FROM {source} s JOIN {out}_pct p USING ({k}, value))"""


EXPOSED = f"exposed AS (SELECT x.gpsno, x.anchor_day, e.is_development, x.control_imu AS value FROM exposure x JOIN entities e USING (gpsno))"
W_CTES = f"{Q.DAILY_CTES}, {Q.ENTITIES}, {history_sql(V.SCORE_ANCHORS)}, {EXPOSURE}, {EXPOSED}"


def exposed(spark, sf):
    return (K.exposure_totals(V.daily(spark, sf), V.SCORE_ANCHORS).join(V.split_entities(spark, sf), "gpsno")
            .select("gpsno", "anchor_day", "is_development", F.col("control_imu").alias("value")))


@query("w11_reference_percentile", Q.shape(f"""
    SELECT x.gpsno, x.anchor_day, x.value, (SELECT COUNT(*) FROM exposed r WHERE r.is_development AND r.anchor_day = 30 AND r.value <= x.value)
           / CAST((SELECT COUNT(*) FROM exposed r WHERE r.is_development AND r.anchor_day = 30) AS DOUBLE) AS percentile FROM exposed x""",
    ["value", "percentile"], ["anchor_day"], W_CTES))
def w11(spark, sf):
    rows = exposed(spark, sf).withColumn("ref", F.col("is_development") & (F.col("anchor_day") == 30)).withColumn("metric", F.lit("imu"))
    return ordered.percentile_against(rows, ["metric"], "value", "ref").drop("ref", "metric", "is_development")


@query("w12_midrank_percentile", Q.shape("SELECT gpsno, anchor_day, value, pct AS percentile FROM mid", ["value", "percentile"], ["anchor_day"],
                                         f"{W_CTES}, {midrank('exposed', 'mid', ('anchor_day',), False)}"))
def w12(spark, sf):
    return ordered.percentile_against(exposed(spark, sf), ["anchor_day"], "value", "is_development", mid_rank=True).drop("is_development")


@query("w12_midrank_zero_no_risk", Q.shape("SELECT gpsno, anchor_day, value, pct AS percentile FROM mid", ["value", "percentile"], ["anchor_day"],
                                           f"{W_CTES}, {midrank('exposed', 'mid', ('anchor_day',), True)}"))
def w12_zero(spark, sf):
    return ordered.percentile_against(exposed(spark, sf), ["anchor_day"], "value", "is_development", mid_rank=True,
                                      where=F.col("value") > 0).drop("is_development")


@query("w13_ranks", Q.shape("""SELECT gpsno, anchor_day, RANK() OVER (PARTITION BY anchor_day ORDER BY probability) AS rank_asc,
    RANK() OVER (PARTITION BY anchor_day ORDER BY probability DESC) AS rank_desc,
    (RANK() OVER (PARTITION BY anchor_day ORDER BY probability) + (COUNT(*) OVER (PARTITION BY anchor_day, probability) - 1) / 2.0::DOUBLE)
      / COUNT(*) OVER (PARTITION BY anchor_day) AS rank_pct FROM predictions""", ["rank_pct"], ["anchor_day", "rank_asc", "rank_desc"], Q.PREDICTIONS))
def w13(spark, sf):
    return ordered.rank_by_value(V.predictions(spark, sf), ["anchor_day"], "probability").select("gpsno", "anchor_day", "rank_asc", "rank_desc", "rank_pct")


@query("w14_feed_seen", Q.shape("SELECT gpsno, day, has_event_feed, has_trajectory, has_imu FROM daily", ctes=Q.DAILY_CTES, t=["day"]))
def w14(spark, sf):
    cover = V.coverage(spark, sf)
    grid = D.calendar(cover, P.first_day, P.last_day)
    return grid.select("gpsno", "day", D.seen_by("event_first_day").alias("has_event_feed"), D.seen_by("trajectory_first_day").alias("has_trajectory"),
                       D.seen_by("imu_first_day").alias("has_imu"))


@query("w15_top_codes", Q.shape("""SELECT * FROM (SELECT gpsno, event_type AS event_code, COUNT(*) AS n,
    ROW_NUMBER() OVER (PARTITION BY gpsno ORDER BY COUNT(*) DESC, event_type DESC) AS position FROM clean GROUP BY gpsno, event_type) t WHERE position <= 3""",
    b=["event_code", "position"], ctes=Q.CLEAN))
def w15(spark, sf):
    counts = V.clean_events(spark, sf).groupBy("gpsno", F.col("event_type").alias("event_code")).agg(F.count(F.lit(1)).alias("n"))
    return scoring.top_codes(counts, "n", ["gpsno"])


@query("w16_top_dimension", Q.shape("""SELECT user_id, CASE WHEN a >= b AND a >= c THEN 'view' WHEN b >= c THEN 'click' ELSE 'error' END AS top_dimension FROM (
    SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'view') AS a, COUNT(*) FILTER (WHERE event_type = 'click') AS b,
           COUNT(*) FILTER (WHERE event_type = 'error') AS c FROM events GROUP BY user_id) t"""))
def w16(spark, sf):
    kinds = ("view", "click", "error")
    counts = V.table(spark, sf, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])
    return counts.select("user_id", scoring.top_column({k: k for k in kinds}, F.col).alias("top_dimension"))


REFERENCE = "reference AS (SELECT gpsno, label FROM bags WHERE anchor_date = DATE '2024-01-20' AND label IS NOT NULL)"
SPLIT = f"""split AS (SELECT gpsno, label, CASE WHEN no <= held THEN 'holdout' ELSE 'development' END AS part,
  CASE WHEN no > held THEN (no - held - 1) % 5 END AS fold FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY md5('2026:' || gpsno)) AS no,
           CAST(FLOOR(COUNT(*) OVER (PARTITION BY label) * 0.2::DOUBLE + 0.5) AS BIGINT) AS held FROM reference) s)"""


def reference(spark, sf):
    return bags(spark, sf).where((F.col("anchor_date") == "2024-01-20") & F.col("label").isNotNull()).select("gpsno", "label")


@query("w17_stratified_split", Q.shape("SELECT * FROM split", b=["label", "fold"], ctes=f"{BAG_CTES}, {REFERENCE}, {SPLIT}"))
def w17(spark, sf):
    return splits.stratified_split(reference(spark, sf), 2026, 5, 0.2)


def _tree_sql() -> str:
    """Digest tree over md5(gpsno): leaves of about LEAF lines, then up to 16 children a node."""
    limits = " ".join(f"WHEN n <= {splits.LEAF * 16**k} THEN {k}" for k in range(6))
    out = f"""digit AS (SELECT CASE {limits} ELSE 6 END AS d FROM (SELECT COUNT(*) AS n FROM reference) r),
t6 AS (SELECT substr(md5(gpsno), 1, d) AS node, sha256(STRING_AGG(line, chr(10) ORDER BY line)) AS digest, COUNT(*) AS n
  FROM (SELECT gpsno, gpsno || ':' || CAST(label AS VARCHAR) AS line FROM reference) x, digit GROUP BY 1)"""
    for k in range(5, -1, -1):
        out += f""",
t{k} AS (SELECT substr(node, 1, {k}) AS node, CASE WHEN MAX(length(node)) > {k} THEN sha256(STRING_AGG(digest, chr(10) ORDER BY node)) ELSE MAX(digest) END AS digest,
  SUM(n) AS n FROM t{k + 1} GROUP BY 1)"""
    return out


@query("w17_label_fingerprint", Q.shape("SELECT digest AS label_fingerprint, n AS entities FROM t0", b=["entities"], ctes=f"{BAG_CTES}, {REFERENCE}, {_tree_sql()}"))
def w17_fingerprint(spark, sf):
    return splits.label_fingerprint(reference(spark, sf))


@query("w17_frozen_split", Q.shape("SELECT * FROM split", b=["label", "fold"], ctes=f"{BAG_CTES}, {REFERENCE}, {SPLIT}"))
def w17_frozen(spark, sf):
    """Made once and read from then on; the second call finds that nothing has changed."""
    folder, labels = shared_folder(spark, "frozen"), materialise(reference(spark, sf), "reference")
    splits.frozen_split(labels, folder, 2026, 5, 0.2)
    return splits.frozen_split(labels, folder, 2026, 5, 0.2)


# --- scorecards -----------------------------------------------------------------------

A_SCORED = f"""{Q.ENTITIES}, routed AS (
  SELECT s.*, e.has_event_feed, e.is_development, CASE WHEN e.has_event_feed THEN 'full' WHEN s.trajectory_coverage > 0 OR s.imu_coverage > 0
           THEN 'context_only_no_matched_event' ELSE 'prior_no_observed_behavior' END AS route,
         CASE WHEN NOT e.has_event_feed AND NOT (s.trajectory_coverage > 0 OR s.imu_coverage > 0) THEN 0.3125::DOUBLE
              ELSE ((CAST(s.gpsno AS BIGINT) * 17 + s.anchor_day * 5) % 101) / 128.0::DOUBLE END AS probability
  FROM signals s JOIN entities e USING (gpsno)),
long_signals AS (""" + " UNION ALL ".join(
    f"SELECT gpsno, anchor_day, '{m}' AS metric, CAST({c} AS DOUBLE) AS value, is_development AND anchor_day = 30 AS is_ref FROM routed"
    for m, c in scoring.A_METRICS.items()) + """),
ref_values AS (SELECT metric, value, COUNT(*) AS n FROM long_signals WHERE is_ref GROUP BY metric, value),
ref_share AS (SELECT v.metric, v.value, COALESCE(SUM(r.n), 0) / CAST((SELECT SUM(n) FROM ref_values t WHERE t.metric = v.metric) AS DOUBLE) AS share
  FROM (SELECT DISTINCT metric, value FROM long_signals) v LEFT JOIN ref_values r ON r.metric = v.metric AND r.value <= v.value GROUP BY v.metric, v.value),
wide_pct AS (SELECT l.gpsno, l.anchor_day, """ + ", ".join(f"MAX(CASE WHEN l.metric = '{m}' THEN p.share END) AS p_{m}" for m in scoring.A_METRICS) + """
  FROM long_signals l JOIN ref_share p USING (metric, value) GROUP BY l.gpsno, l.anchor_day),
risks AS (SELECT r.*, """ + ", ".join(
    f"CASE WHEN route = 'prior_no_observed_behavior' THEN 0.5::DOUBLE ELSE {e} END AS risk_{n}" for n, e in {
        "model": "p_model", "upstream": "CASE WHEN has_event_feed THEN p_upstream ELSE 0.5 END",
        "control": "CASE WHEN has_event_feed THEN 0.75::DOUBLE * p_control_event + 0.25::DOUBLE * p_control_imu ELSE 0.375::DOUBLE + 0.25::DOUBLE * p_control_imu END",
        "proximal": "CASE WHEN has_event_feed THEN p_proximal ELSE 0.5 END", "history": "CASE WHEN has_event_feed THEN p_history ELSE 0.5 END",
        "quality": "CASE WHEN has_event_feed THEN p_quality ELSE 0.5 END"}.items()) + """
  FROM routed r JOIN wide_pct USING (gpsno, anchor_day)),
cut_a AS (SELECT *, """ + ", ".join(f"{p} * risk_{n} * risk_{n} AS {n}_deduction" for n, p in codes.SCORE_A_POINTS.items()) + """,
  0.6::DOUBLE * CAST(has_event_feed AS INTEGER) + 0.3::DOUBLE * trajectory_coverage + 0.1::DOUBLE * imu_coverage AS evidence_confidence FROM risks),
cards_a AS (SELECT *, """ + " + ".join(f"{n}_deduction" for n in codes.SCORE_A_POINTS) + """ AS total_deduction,
  CASE WHEN evidence_confidence >= 0.8 THEN '高' WHEN evidence_confidence >= 0.5 THEN '中' ELSE '低' END AS confidence_level FROM cut_a)"""
A_CTES = f"{SCORE_CTES}, {SIGNALS}, {A_SCORED}"
A_RISKS = [f"risk_{n}" for n in codes.SCORE_A_POINTS]


def cards_a(spark, sf, anchors=V.SCORE_ANCHORS):
    weights = materialise(scoring.shrink_weights(V.importance(spark, sf), codes.STATES), "weights")
    return scoring.scorecard_a(V.daily_table(spark, sf), V.split_table(spark, sf), V.card_probability(spark, sf, anchors), weights, anchors, 30,
                               0.3125, P.first_day, stage=materialise)


@query("p23_neutral_risks", Q.shape(f"SELECT gpsno, anchor_day, route, {', '.join(A_RISKS)} FROM risks", A_RISKS, ["anchor_day"], A_CTES))
def p23(spark, sf):
    return cards_a(spark, sf).select("gpsno", "anchor_day", "route", *A_RISKS)


A_CUTS = [f"{n}_deduction" for n in codes.SCORE_A_POINTS]


@query("p24_deductions", Q.shape(f"SELECT gpsno, anchor_day, {', '.join(A_CUTS)}, total_deduction, 100 - total_deduction AS safety_score FROM cards_a",
                                 [*A_CUTS, "total_deduction", "safety_score"], ["anchor_day"], A_CTES))
def p24(spark, sf):
    return cards_a(spark, sf).select("gpsno", "anchor_day", *A_CUTS, "total_deduction", "safety_score")


def bands_sql(bands, pick, low, score="100 - total_deduction"):
    whens = " ".join(f"WHEN {score} >= {b[1]} THEN '{b[pick]}'" for b in bands if b[1] is not None)
    return f"CASE WHEN confidence_level = '低' THEN '{low}' {whens} ELSE '{bands[-1][pick]}' END"


def name_case(code="event_code"):
    return "CASE " + " ".join(f"WHEN {code} = {c} THEN '{n}'" for c, n in codes.EVENT_NAMES.items()) + " END"


def top_case(labels, suffix):
    names = list(labels)
    best = "GREATEST(" + ", ".join(suffix(n) for n in names) + ")"
    return "CASE " + " ".join(f"WHEN {suffix(n)} = {best} THEN '{labels[n]}'" for n in names) + " END"


A_LABELS = {n: l for n, l in codes.SCORE_A_LABELS.items() if n != "model"}
TOP_A = f"""top_a AS (SELECT gpsno, anchor_day, STRING_AGG(CAST(event_code AS VARCHAR) || {name_case()}, '；' ORDER BY no) AS top_risk_events FROM (
  SELECT gpsno, anchor_day, event_code, ROW_NUMBER() OVER (PARTITION BY gpsno, anchor_day ORDER BY burden * weight DESC, event_code DESC) AS no
  FROM burden JOIN state_weights USING (event_code) WHERE state <> 'exposure' AND burden * weight > 0) t WHERE no <= 3 GROUP BY gpsno, anchor_day)"""


@query("m7_scorecard_a", Q.shape(f"""
    SELECT c.gpsno, c.anchor_day, {Q.FIRST} + CAST(c.anchor_day - 1 AS INTEGER) AS as_of_date, 100 - total_deduction AS safety_score, probability, route,
           evidence_confidence, confidence_level, {bands_sql(codes.SCORE_A_GRADES, 0, 'U')} AS grade,
           {bands_sql(codes.SCORE_A_GRADES, 2, codes.SCORE_A_UNRATED[1])} AS risk_level,
           {bands_sql(codes.SCORE_A_GRADES, 3, codes.SCORE_A_UNRATED[2])} AS management_action,
           {top_case(A_LABELS, lambda n: n + '_deduction')} AS top_risk_dimension, COALESCE(t.top_risk_events, '{codes.NO_EVENTS_A}') AS top_risk_events
    FROM cards_a c LEFT JOIN top_a t USING (gpsno, anchor_day)""", ["safety_score", "probability", "evidence_confidence"], ["anchor_day"],
    f"{A_CTES}, {TOP_A}", ["as_of_date"]))
def m7(spark, sf):
    return cards_a(spark, sf).select("gpsno", "anchor_day", "as_of_date", "safety_score", "probability", "route", "evidence_confidence", "confidence_level",
                                     "grade", "risk_level", "management_action", "top_risk_dimension", "top_risk_events")


@query("m7_scorecard_ranks", Q.shape("""SELECT gpsno, anchor_day, RANK() OVER (PARTITION BY anchor_day ORDER BY s DESC) AS safety_rank,
    RANK() OVER (PARTITION BY anchor_day ORDER BY s) AS risk_rank,
    (RANK() OVER (PARTITION BY anchor_day ORDER BY s) + (COUNT(*) OVER (PARTITION BY anchor_day, s) - 1) / 2.0::DOUBLE) / COUNT(*) OVER (PARTITION BY anchor_day)
      AS fleet_safety_percentile FROM (SELECT gpsno, anchor_day, ROUND(100 - total_deduction, 4) AS s FROM cards_a) c""", ["fleet_safety_percentile"],
    ["anchor_day", "safety_rank", "risk_rank"], A_CTES))
def m7_ranks(spark, sf):
    cards = cards_a(spark, sf).select("gpsno", "anchor_day", F.round("safety_score", 4).alias("safety_score"))
    return scoring.with_ranks(cards).select("gpsno", "anchor_day", "safety_rank", "risk_rank", "fleet_safety_percentile")


B_LONG = f"""{Q.ENTITIES}, b_rows AS (
  SELECT c.gpsno, c.anchor_day, c.event_code, e.is_development, LN(1 + 1000 * total / (km + 100)) AS rate_km, LN(1 + 100 * total / (hours + 1)) AS rate_hour,
         active_days / c.anchor_day::DOUBLE AS active_share, EXP(-(c.anchor_day - last_day) / 14.0::DOUBLE) AS recency
  FROM code_totals c JOIN exposure x USING (gpsno, anchor_day) JOIN entities e USING (gpsno) WHERE total > 0),
b_long AS (SELECT gpsno, anchor_day, event_code, is_development, 'rate_km' AS metric, ROUND(rate_km, 9) AS value FROM b_rows
  UNION ALL SELECT gpsno, anchor_day, event_code, is_development, 'rate_hour', ROUND(rate_hour, 9) FROM b_rows
  UNION ALL SELECT gpsno, anchor_day, event_code, is_development, 'active_share', active_share FROM b_rows),
{midrank('b_long', 'b_mid', ('anchor_day', 'event_code', 'metric'), True)},
event_values AS (SELECT r.gpsno, r.anchor_day, r.event_code, 0.35::DOUBLE * MAX(CASE WHEN metric = 'rate_km' THEN pct END)
    + 0.25::DOUBLE * MAX(CASE WHEN metric = 'rate_hour' THEN pct END) + 0.20::DOUBLE * MAX(CASE WHEN metric = 'active_share' THEN pct END)
    + 0.20::DOUBLE * MAX(r.recency) AS event_value
  FROM b_mid m JOIN b_rows r USING (gpsno, anchor_day, event_code) GROUP BY r.gpsno, r.anchor_day, r.event_code)"""
TREND = f"""trend_rows AS (
  SELECT s.gpsno, s.day_index AS anchor_day, e.is_development, CAST(s.streak AS DOUBLE) AS streak, recent_sum / len AS recent,
         CASE WHEN s.day_index > len THEN (all_sum - recent_sum) / CAST(s.day_index - len AS DOUBLE) ELSE 0.0 END AS previous
  FROM (SELECT a.*, LEAST(14, GREATEST(7, a.day_index // 3)) AS len, SUM(active) OVER (PARTITION BY gpsno ORDER BY day_index) AS all_sum,
               CASE LEAST(14, GREATEST(7, a.day_index // 3)) {' '.join(f"WHEN {n} THEN SUM(active) OVER (PARTITION BY gpsno ORDER BY day_index ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in range(7, 15))} END
                 / 1.0::DOUBLE AS recent_sum FROM streaks a) s JOIN entities e USING (gpsno)
  WHERE s.day_index IN ({', '.join(map(str, V.SCORE_ANCHORS))})),
trend_long AS (SELECT gpsno, anchor_day, is_development, 'recent' AS metric, recent AS value FROM trend_rows
  UNION ALL SELECT gpsno, anchor_day, is_development, 'increase', GREATEST(recent - previous, 0) FROM trend_rows
  UNION ALL SELECT gpsno, anchor_day, is_development, 'streak', streak FROM trend_rows),
{midrank('trend_long', 'trend_mid', ('anchor_day', 'metric'), True)},
trend AS (SELECT gpsno, anchor_day, 0.50::DOUBLE * MAX(CASE WHEN metric = 'recent' THEN pct END) + 0.30::DOUBLE * MAX(CASE WHEN metric = 'increase' THEN pct END)
    + 0.20::DOUBLE * MAX(CASE WHEN metric = 'streak' THEN pct END) AS trend FROM trend_mid GROUP BY gpsno, anchor_day)"""


@query("w10_trend_risk", Q.shape("SELECT gpsno, anchor_day, trend FROM trend", ["trend"], ["anchor_day"],
                                 f"{Q.DAILY_CTES}, {Q.ENTITIES}, {STREAKS}, {TREND}"))
def w10(spark, sf):
    return scoring.trend_risk(V.daily_table(spark, sf), V.split_table(spark, sf), V.SCORE_ANCHORS, DIMENSION_CODES, materialise)


B_DIMS = list(codes.DIMENSIONS)
B_CARDS = f"""{Q.IMPORTANCE}, {weights_sql(codes.DIMENSIONS, 'dimension', 'dimension_weights')},
b_exposed AS (SELECT x.gpsno, x.anchor_day, e.is_development, x.control_imu AS value FROM exposure x JOIN entities e USING (gpsno)),
{midrank('b_exposed', 'b_imu', ('anchor_day',), False)},
b_sums AS (SELECT gpsno, anchor_day, {', '.join(f"SUM(CASE WHEN dimension = '{d}' THEN weight * event_value ELSE 0 END) AS s_{d}" for d in B_DIMS)}
  FROM event_values JOIN dimension_weights USING (event_code) GROUP BY gpsno, anchor_day),
b_raw AS (SELECT x.gpsno, x.anchor_day, e.has_event_feed, e.is_development,
    0.5::DOUBLE * CAST(e.has_event_feed AS INTEGER) + 0.3::DOUBLE * x.trajectory_coverage + 0.2::DOUBLE * x.imu_coverage AS evidence_confidence,
    {', '.join((f"0.75::DOUBLE * COALESCE(s_{d}, 0) + 0.25::DOUBLE * i.pct" if d == 'control' else f"COALESCE(s_{d}, 0)") + f" AS raw_{d}" for d in B_DIMS)}, t.trend AS raw_trend
  FROM exposure x JOIN entities e USING (gpsno) LEFT JOIN b_sums USING (gpsno, anchor_day) JOIN b_imu i USING (gpsno, anchor_day) JOIN trend t USING (gpsno, anchor_day)),
b_typical AS (SELECT anchor_day, {', '.join(f"QUANTILE_CONT(raw_{d}, 0.5) AS t_{d}" for d in codes.SCORE_B_POINTS)} FROM b_raw WHERE is_development GROUP BY anchor_day),
b_level AS (SELECT *, CASE WHEN evidence_confidence >= 0.8 THEN '高' WHEN evidence_confidence >= 0.5 THEN '中' ELSE '低' END AS confidence_level FROM b_raw),
b_risk AS (SELECT l.gpsno, l.anchor_day, evidence_confidence, confidence_level,
    {', '.join(f"CASE WHEN confidence_level = '低' THEN t_{d} ELSE raw_{d} END AS risk_{d}" for d in codes.SCORE_B_POINTS)} FROM b_level l JOIN b_typical USING (anchor_day)),
cards_b AS (SELECT *, {' + '.join(f'{p} * risk_{d}' for d, p in codes.SCORE_B_POINTS.items())} AS total_deduction,
    {', '.join(f'{p} * risk_{d} AS deduction_{d}' for d, p in codes.SCORE_B_POINTS.items())} FROM b_risk)"""
B_CTES = (f"{Q.DAILY_CTES}, {history_sql(V.SCORE_ANCHORS)}, {Q.LONG_CODES}, {EXPOSURE}, {CODE_TOTALS}, {B_LONG}, {STREAKS}, {TREND}, {B_CARDS}")
B_RISKS = [f"risk_{d}" for d in codes.SCORE_B_POINTS]
B_CUTS = [f"deduction_{d}" for d in codes.SCORE_B_POINTS]


def cards_b(spark, sf):
    return scoring.scorecard_b(V.daily_table(spark, sf), V.split_table(spark, sf), V.importance(spark, sf), V.SCORE_ANCHORS, stage=materialise)


@query("p25_low_evidence_fallback", Q.shape(f"SELECT gpsno, anchor_day, confidence_level, {', '.join(B_RISKS)} FROM cards_b", B_RISKS, ["anchor_day"], B_CTES))
def p25(spark, sf):
    return cards_b(spark, sf).select("gpsno", "anchor_day", "confidence_level", *B_RISKS)


@query("m8_scorecard_b", Q.shape(f"""
    SELECT gpsno, anchor_day, evidence_confidence, confidence_level, {', '.join(B_CUTS)}, total_deduction, 100 - total_deduction AS safety_score,
           {bands_sql(codes.SCORE_B_GRADES, 0, 'U')} AS grade, {bands_sql(codes.SCORE_B_GRADES, 2, codes.SCORE_B_UNRATED[1])} AS risk_level,
           {bands_sql(codes.SCORE_B_GRADES, 3, codes.SCORE_B_UNRATED[2])} AS management_action, {top_case(codes.SCORE_B_LABELS, lambda n: 'deduction_' + n)} AS top_risk_dimension
    FROM cards_b""", ["evidence_confidence", *B_CUTS, "total_deduction", "safety_score"], ["anchor_day"], B_CTES))
def m8(spark, sf):
    return cards_b(spark, sf).select("gpsno", "anchor_day", "evidence_confidence", "confidence_level", *B_CUTS, "total_deduction", "safety_score",
                                     "grade", "risk_level", "management_action", "top_risk_dimension")


TOP_B = f"""contrib AS (SELECT gpsno, anchor_day, event_code, CASE dimension {' '.join(f"WHEN '{d}' THEN {p}" for d, p in codes.SCORE_B_POINTS.items() if d != 'trend')} END
    * CASE WHEN dimension = 'control' THEN 0.75 ELSE 1 END * weight * event_value AS value FROM event_values JOIN dimension_weights USING (event_code))"""


@query("m8_event_contributions", Q.shape("""SELECT gpsno, anchor_day, event_code, value, no AS position FROM (SELECT *, ROW_NUMBER() OVER (
    PARTITION BY gpsno, anchor_day ORDER BY ROUND(value, 6) DESC, event_code DESC) AS no FROM contrib WHERE value > 0) t WHERE no <= 3""",
    ["value"], ["anchor_day", "event_code", "position"], f"{B_CTES}, {TOP_B}"))
def m8_contributions(spark, sf):
    """Top contributions of scorecard B per (entity, anchor), as numbers."""
    entities, anchors, daily = V.split_table(spark, sf), V.SCORE_ANCHORS, V.daily_table(spark, sf)
    values = scoring.event_values(K.code_totals(K.active_code_days(daily, DIMENSION_CODES), anchors), K.exposure_totals(daily, anchors), entities,
                                  stage=materialise)
    weights = scoring.shrink_weights(V.importance(spark, sf), codes.DIMENSIONS, "dimension")
    worth = F.coalesce(*[F.when(F.col("dimension") == d, F.lit(p)) for d, p in codes.SCORE_B_POINTS.items()])
    factor = F.when(F.col("dimension") == "control", 0.75).otherwise(1.0)
    rows = (values.join(F.broadcast(weights), "event_code")
            .select("gpsno", "anchor_day", "event_code", F.round(worth * factor * F.col("weight") * F.col("event_value"), 6).alias("value")))
    return scoring.top_codes(rows, "value").select("gpsno", "anchor_day", "event_code", "value", "position")
