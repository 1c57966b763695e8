"""Data contracts (Q1-Q7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from telerisk import codes
from telerisk.catalog import sqlviews as Q
from telerisk.catalog import views as V
from telerisk.catalog.joins import BAG_CTES, BAGS, LABELS
from telerisk.catalog.registry import query
from telerisk.catalog.sources_sinks import bags
from telerisk.catalog.windows import A_CTES, bands_sql, cards_a
from telerisk.operators import metrics as M
from telerisk.operators import quality, scoring
from telerisk.session import materialise

P = V.PERIOD


@query("q1_unique_key", """SELECT 'duplicate_order_line' AS rule, COUNT(*) AS violations FROM (SELECT l_orderkey, l_linenumber FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1) t UNION ALL
    SELECT 'duplicate_event', COUNT(*) FROM (SELECT event_id FROM events GROUP BY event_id HAVING COUNT(*) > 1) t""")
def q1(spark, sf):
    return quality.union_all([quality.unique_key(V.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "duplicate_order_line"),
                              quality.unique_key(V.table(spark, sf, "events"), ["event_id"], "duplicate_event")])


@query("q2_calendar_gaps", Q.shape("""SELECT gpsno, COUNT(*) AS rows, COUNT(DISTINCT day) AS days, MIN(day) AS first_day, MAX(day) AS last_day FROM event_daily
    GROUP BY gpsno HAVING NOT (COUNT(*) = 30 AND COUNT(DISTINCT day) = 30 AND MIN(day) = DATE '2024-01-01' AND MAX(day) = DATE '2024-01-30')""",
    ctes=Q.EVENT_CTES, t=["first_day", "last_day"]))
def q2(spark, sf):
    """Entities whose sparse event days are not a whole calendar (the dense table has none)."""
    return quality.calendar_gaps(V.event_daily(spark, sf), P.first_day, P.last_day)


@query("q3_range_rules", """SELECT 'discount' AS rule, COUNT(*) FILTER (WHERE NOT (l_discount BETWEEN 0 AND 0.05)) AS violations FROM lineitem
    UNION ALL SELECT 'quantity', COUNT(*) FILTER (WHERE NOT (l_quantity >= 10)) FROM lineitem
    UNION ALL SELECT 'flag', COUNT(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) FROM lineitem""")
def q3(spark, sf):
    li = quality.require_columns(V.table(spark, sf, "lineitem"), ("l_discount", "l_quantity", "l_returnflag"))
    return quality.range_rules(li, {"discount": F.col("l_discount").between(0, 0.05), "quantity": F.col("l_quantity") >= 10,
                                    "flag": F.col("l_returnflag").isin("A", "N")})


_items = {
    "profile_rows": "SELECT COUNT(*) FROM profile", "profile_vehicles": "SELECT COUNT(DISTINCT gpsno) FROM profile",
    "daily_rows": "SELECT COUNT(*) FROM daily",
    "daily_rows_outside_window": f"SELECT COUNT(*) FROM daily WHERE day < {Q.FIRST} OR day > {Q.LAST}",
    "negative_measures": "SELECT COUNT(*) FROM daily WHERE distance_km < 0 OR drive_hours < 0",
    "daily_duplicates": "SELECT COUNT(*) - COUNT(DISTINCT (gpsno, day)) FROM daily",
    "days_per_vehicle_min": "SELECT MIN(n) FROM (SELECT COUNT(*) AS n FROM daily GROUP BY gpsno) t",
    "days_per_vehicle_max": "SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM daily GROUP BY gpsno) t",
    "bag_rows": "SELECT COUNT(*) FROM bags", "bag_anchors": "SELECT COUNT(DISTINCT anchor_date) FROM bags",
    "bag_duplicates": "SELECT COUNT(*) - COUNT(DISTINCT (gpsno, anchor_date)) FROM bags",
    "target_rows": f"SELECT COUNT(*) FROM bags WHERE anchor_date = DATE '{P.final_anchor}'",
    "target_known_labels": f"SELECT COUNT(label) FROM bags WHERE anchor_date = DATE '{P.final_anchor}'",
    "label_mismatches": "SELECT COUNT(*) FROM bags JOIN labels l USING (gpsno, anchor_date) WHERE label <> CASE WHEN l.accident_events > 0 THEN 1 ELSE 0 END",
    "after_rule_end_events": f"SELECT COUNT(*) FROM targets WHERE event_ts >= CAST({Q.LAST} + 1 AS TIMESTAMP)"}


@query("q4_preprocessing_report", f"WITH {Q.DAILY_CTES}, {Q.TARGETS}, {LABELS}, {BAGS} "
       + " UNION ALL ".join(f"SELECT '{k}' AS item, CAST(({v}) AS BIGINT) AS value" for k, v in _items.items()))
def q4(spark, sf):
    return quality.preprocessing_report(V.profile(spark, sf), V.daily_table(spark, sf), materialise(bags(spark, sf), "bags"),
                                        V.targets(spark, sf), P.first_day, P.last_day, P.anchors, P.final_anchor, P.horizon)


_q5 = {
    "score_out_of_range": "SELECT COUNT(*) FROM final WHERE safety_score < 0 OR safety_score > 100",
    "deductions_do_not_reconcile": "SELECT COUNT(*) FROM final WHERE ABS(safety_score + total_deduction - 100) > 1e-8",
    "unknown_grade": "SELECT COUNT(*) FROM final WHERE grade NOT IN ('A', 'B', 'C', 'D', 'E', 'U')",
    "low_confidence_iff_unrated": f"SELECT COUNT(*) FROM final WHERE (confidence_level = '{codes.CONFIDENCE_LOW}') <> (grade = 'U')",
    "null_value": "SELECT COUNT(*) FROM final f WHERE f.gpsno IS NULL OR safety_score IS NULL OR grade IS NULL OR confidence_level IS NULL OR probability IS NULL",
    "missing_vehicle": "SELECT COUNT(*) FROM profile WHERE gpsno NOT IN (SELECT gpsno FROM final)",
    "unknown_vehicle": "SELECT COUNT(*) FROM final WHERE gpsno NOT IN (SELECT gpsno FROM profile)",
    "incomplete_history": f"SELECT COUNT(*) FROM (SELECT COUNT(*) AS n, COUNT(DISTINCT anchor_day) AS a FROM history_a GROUP BY gpsno) h WHERE n <> {len(V.SCORE_ANCHORS)} OR a <> {len(V.SCORE_ANCHORS)}",
    "history_anchor_outside": f"SELECT COUNT(*) FROM history_a WHERE anchor_day NOT BETWEEN {V.SCORE_ANCHORS[0]} AND {V.SCORE_ANCHORS[-1]}",
    "weights_do_not_sum_to_one": "SELECT COUNT(*) FROM (SELECT SUM(weight) AS w FROM state_weights GROUP BY state) s WHERE ABS(w - 1) > 1e-8",
    "fleet_total_differs": "SELECT CASE WHEN (SELECT COUNT(*) FROM final) = (SELECT COUNT(*) FROM profile) THEN 0 ELSE 1 END",
    "duplicate_vehicle": "SELECT COUNT(*) - COUNT(DISTINCT gpsno) FROM final"}


@query("q5_score_contract", f"WITH {A_CTES}, history_a AS (SELECT *, 100 - total_deduction AS safety_score, {bands_sql(codes.SCORE_A_GRADES, 0, 'U')} AS grade FROM cards_a), "
       "final AS (SELECT * FROM history_a WHERE anchor_day = 30) " + " UNION ALL ".join(f"SELECT '{k}' AS rule, CAST(({v}) AS BIGINT) AS violations" for k, v in _q5.items()))
def q5(spark, sf):
    """Every delivery rule of a scorecard run, as (rule, violations)."""
    history = materialise(cards_a(spark, sf), "cards")
    final = history.where("anchor_day = 30")
    fleet = M.share_by(final, ["grade", "risk_level"], mean_score="safety_score")
    weights = scoring.shrink_weights(V.importance(spark, sf), codes.STATES)
    return quality.score_contract(final, history, weights, fleet, V.profile(spark, sf), V.SCORE_ANCHORS)


_labelled = "(SELECT * FROM bags WHERE anchor_date = DATE '2024-01-20' AND label IS NOT NULL) r"
_expected = "CASE WHEN label = 1 THEN 'observed_positive' ELSE 'provisional_negative' END"
_q6 = {"label_not_binary": f"SELECT COUNT(*) FROM {_labelled} WHERE label NOT IN (0, 1)",
       "status_differs": f"SELECT COUNT(*) FROM {_labelled} WHERE label_status <> {_expected}",
       "input_start_differs": f"SELECT COUNT(*) FROM {_labelled} WHERE input_start <> {Q.FIRST}",
       "input_end_differs": f"SELECT COUNT(*) FROM {_labelled} WHERE input_end <> DATE '2024-01-20'",
       "future_end_differs": f"SELECT COUNT(*) FROM {_labelled} WHERE future_end <> DATE '2024-01-30'",
       "missing_class": f"SELECT 2 - COUNT(DISTINCT label) FROM {_labelled}",
       "duplicate_vehicle": f"SELECT COUNT(*) FROM (SELECT gpsno FROM {_labelled} GROUP BY gpsno HAVING COUNT(*) > 1) d"}


@query("q6_label_contract", f"WITH {BAG_CTES} " + " UNION ALL ".join(f"SELECT '{k}' AS rule, CAST(({v}) AS BIGINT) AS violations" for k, v in _q6.items()))
def q6(spark, sf):
    return quality.label_contract(bags(spark, sf), "2024-01-20", P.first_day, P.horizon)


_final = f"(SELECT * FROM bags WHERE anchor_date = {Q.LAST}) r"
_q6b = {"label_known": f"SELECT COUNT(label) FROM {_final}", "status_differs": f"SELECT COUNT(*) FROM {_final} WHERE label_status <> 'target_unknown'",
        "input_start_differs": f"SELECT COUNT(*) FROM {_final} WHERE input_start <> DATE '2024-01-11'",
        "input_end_differs": f"SELECT COUNT(*) FROM {_final} WHERE input_end <> {Q.LAST}",
        "missing_vehicle": f"SELECT COUNT(*) FROM profile WHERE gpsno NOT IN (SELECT gpsno FROM {_final})",
        "unknown_vehicle": f"SELECT COUNT(*) FROM {_final} WHERE gpsno NOT IN (SELECT gpsno FROM profile)",
        "duplicate_vehicle": f"SELECT COUNT(*) FROM (SELECT gpsno FROM {_final} GROUP BY gpsno HAVING COUNT(*) > 1) d"}


@query("q6_prediction_index", f"WITH {BAG_CTES} " + " UNION ALL ".join(f"SELECT '{k}' AS rule, CAST(({v}) AS BIGINT) AS violations" for k, v in _q6b.items()))
def q6_index(spark, sf):
    return quality.prediction_index_contract(bags(spark, sf), V.profile(spark, sf), P.final_anchor, "2024-01-11")


_cand = "(SELECT * FROM predictions WHERE anchor_day = 20) c"
_q7 = {"probability_out_of_range": f"SELECT COUNT(*) FROM {_cand} WHERE NOT (probability BETWEEN 0 AND 1)", "class_differs": "SELECT 0",
       "status_differs": f"SELECT COUNT(*) FROM {_cand} WHERE fold = 3",
       "missing_vehicle": f"SELECT COUNT(*) FROM profile WHERE gpsno NOT IN (SELECT gpsno FROM {_cand})",
       "unknown_vehicle": f"SELECT COUNT(*) FROM {_cand} WHERE gpsno NOT IN (SELECT gpsno FROM profile)", "duplicate_vehicle": "SELECT 0",
       "prior_routed_differs": f"SELECT ABS(COUNT(*) - 22) FROM {_cand} WHERE fold = 4"}


@query("q7_prediction_contract", f"WITH {Q.PROFILE}, {Q.PREDICTIONS} "
       + " UNION ALL ".join(f"SELECT '{k}' AS rule, CAST(({v}) AS BIGINT) AS violations" for k, v in _q7.items()))
def q7(spark, sf):
    p = V.predictions(spark, sf).where("anchor_day = 20").select(
        "gpsno", "probability", (F.col("probability") >= 0.5).cast("int").alias("prediction"),
        F.when(F.col("fold") == 3, "known").otherwise("future_unknown").alias("label_status"),
        F.when(F.col("fold") == 4, codes.ROUTE_PRIOR).otherwise(codes.ROUTE_FULL).alias("route"))
    return quality.prediction_contract(p, V.profile(spark, sf).select("gpsno"), expected_prior=22)
