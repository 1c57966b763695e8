"""Occlusion of a fitted model: what one code's events are worth."""

from __future__ import annotations

from pyspark.sql import functions as F

from telerisk import codes
from telerisk.catalog import sqlviews as Q
from telerisk.catalog import views as V
from telerisk.catalog.aggregates import LANDMARK_NUMBERS, LANDMARK_SQL, history_sql
from telerisk.catalog.registry import query
from telerisk.catalog.sqlmetrics import auc_sql
from telerisk.operators import landmarks as K
from telerisk.operators import metrics as M
from telerisk.operators import model
from telerisk.operators.scaling import long_features
from telerisk.session import materialise

ANCHOR, INTERCEPT = V.LAST_DAY, -4.0
#: parameters of a model as a fit would return them, given here so that SQL can score with the same ones
GIVEN = [(f, -(2.0 + i % 3), 2.0 + i % 4, (i % 5 - 2) / 8, (i % 3 - 1) / 4, 1 + (i % 4) / 4, (i % 7 - 3) / 32, (i % 5) / 8, 1 + (i % 2) / 2, (i % 3 - 1) / 16)
         for i, f in enumerate(LANDMARK_NUMBERS)]
EVENT_FEATURES = [f for f in LANDMARK_NUMBERS if f.startswith("event_")]


def _without(field: str) -> str:
    """The day's value of an event field with the code ``a.event_code`` taken away."""
    if field == "event_total_episodes":
        return f"COALESCE({field}, 0) - CASE a.event_code " + " ".join(f"WHEN {c} THEN COALESCE(event_{c}_episodes, 0)" for c in codes.EVENT_CODES) + " END"
    return f"CASE WHEN a.event_code = {field.split('_')[1]} THEN 0 ELSE {field} END"


def _long(source: str, keys: str, features) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM {source}" for f in features)


def _term(v: str) -> str:
    clipped = f"LEAST(GREATEST(SIGN({v}) * LN(1 + ABS({v})), low), high)"
    return (f"(coefficient * (CASE WHEN {v} IS NULL THEN median ELSE {clipped} END - mean) * factor "
            f"+ flag_coefficient * (CASE WHEN {v} IS NULL THEN 1 ELSE 0 END - flag_mean) * flag_factor)")


_row = lambda r: "(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in r) + ")"
TERMS = f"""given AS (SELECT * FROM (VALUES {', '.join(map(_row, GIVEN))}) AS g({', '.join(model.PARAMETERS)})),
{history_sql((ANCHOR,))}, base_land AS (SELECT gpsno, {', '.join(f'{e} AS {n}' for n, e in LANDMARK_SQL.items())} FROM history GROUP BY gpsno, anchor_day),
had AS (SELECT DISTINCT gpsno, event_code FROM long_codes WHERE (n > 0 OR episodes > 0) AND day_index <= {ANCHOR}),
zeroed AS (SELECT h.gpsno, h.anchor_day, h.back, h.distance_km, a.event_code, {', '.join(f'{_without(f)} AS {f}' for f in codes.LANDMARK_EVENT_FIELDS)}
  FROM history h JOIN had a USING (gpsno)),
masked_land AS (SELECT gpsno, event_code, {', '.join(f'{LANDMARK_SQL[f]} AS {f}' for f in EVENT_FEATURES)} FROM zeroed GROUP BY gpsno, event_code, anchor_day),
base_terms AS (SELECT gpsno, feature, {_term('v')} AS term FROM ({_long('base_land', 'gpsno', LANDMARK_NUMBERS)}) l JOIN given USING (feature)),
masked_terms AS (SELECT gpsno, event_code, feature, {_term('v')} AS term FROM ({_long('masked_land', 'gpsno, event_code', EVENT_FEATURES)}) l JOIN given USING (feature)),
terms AS (SELECT m.gpsno, m.event_code, SUM(b.term - m.term) AS term FROM masked_terms m JOIN base_terms b USING (gpsno, feature) GROUP BY m.gpsno, m.event_code),
logits AS (SELECT gpsno, {INTERCEPT}::DOUBLE + SUM(term) AS logit FROM base_terms GROUP BY gpsno)"""
CODE_VALUES = "(VALUES " + ", ".join(f"({c})" for c in codes.EVENT_CODES) + ") AS c(event_code)"
OCCLUDED = f"""occluded AS (
  SELECT l.gpsno, l.logit, c.event_code, t.term IS NOT NULL AS active, 1 - POW(1 - 1 / (1 + EXP(-l.logit)), 40) AS baseline_probability,
         1 - POW(1 - 1 / (1 + EXP(-(l.logit - COALESCE(t.term, 0.0)))), 40) AS masked_probability
  FROM logits l CROSS JOIN {CODE_VALUES} LEFT JOIN terms t USING (gpsno, event_code))"""
OCCLUSION_CTES = f"{Q.DAILY_CTES}, {Q.LONG_CODES}, {TERMS}, {OCCLUDED}"


def occluded(spark, sf):
    """Every entity and code at the last anchor: probability with the code's events and without them, by one fitted model."""
    daily = V.daily_table(spark, sf)
    land = materialise(K.landmark_summary(daily, (ANCHOR,)), "landmarks")
    given = spark.createDataFrame(GIVEN, ", ".join(f"{n} {'string' if n == 'feature' else 'double'}" for n in model.PARAMETERS))
    logits = model.model_logits(long_features(land, ["gpsno", "anchor_day"], LANDMARK_NUMBERS), given, INTERCEPT).drop("anchor_day")
    terms = model.code_terms(K.without_code(daily, land, (ANCHOR,)), given).drop("anchor_day")
    return model.occlusion(logits, terms, 40, codes.EVENT_CODES)


@query("j16_code_ablation", Q.shape("SELECT * FROM occluded", ["logit", "baseline_probability", "masked_probability"], ["event_code"],
                                    OCCLUSION_CTES))
def j16(spark, sf):
    return occluded(spark, sf)


IMPORTANCE_BY_AUC = """ablation AS (SELECT o.*, e.label FROM occluded o JOIN (SELECT gpsno, label FROM predictions WHERE anchor_day = 20) e USING (gpsno))"""


@query("a36_ablation_summary", Q.shape(f"""
    SELECT a.event_code, a.roc_auc AS baseline_auc, m.roc_auc AS masked_auc, a.roc_auc - m.roc_auc AS auc_drop_when_masked, c.mean_change, c.mean_abs_change
    FROM ({auc_sql('ablation', ['event_code'], 'baseline_probability')}) a JOIN ({auc_sql('ablation', ['event_code'], 'masked_probability')}) m USING (event_code)
    JOIN (SELECT event_code, AVG(baseline_probability - masked_probability) AS mean_change, AVG(ABS(baseline_probability - masked_probability)) AS mean_abs_change
          FROM ablation GROUP BY event_code) c USING (event_code)""",
    ["baseline_auc", "masked_auc", "auc_drop_when_masked", "mean_change", "mean_abs_change"], ["event_code"],
    f"{OCCLUSION_CTES}, {Q.PREDICTIONS}, {IMPORTANCE_BY_AUC}"))
def a36(spark, sf):
    labels = V.predictions(spark, sf).where("anchor_day = 20").select("gpsno", "label")
    rows = occluded(spark, sf).join(labels, "gpsno")
    auc = lambda c, n: M.ranking_metrics(rows, ["event_code"], score=c).select("event_code", F.col("roc_auc").alias(n))
    delta = F.col("baseline_probability") - F.col("masked_probability")
    change = rows.groupBy("event_code").agg(F.avg(delta).alias("mean_change"), F.avg(F.abs(delta)).alias("mean_abs_change"))
    return (auc("baseline_probability", "baseline_auc").join(auc("masked_probability", "masked_auc"), "event_code").join(change, "event_code")
            .withColumn("auc_drop_when_masked", F.col("baseline_auc") - F.col("masked_auc")))
