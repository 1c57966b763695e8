"""Model jobs (M1-M6) and reusable surfaces."""

from __future__ import annotations

from math import ceil

from pyspark.sql import functions as F

from telerisk import codes
from telerisk.catalog import sqlviews as Q
from telerisk.catalog import views as V
from telerisk.catalog.aggregates import FIT_STD, LANDMARK_CTES, LANDMARK_NUMBERS, PARAM_DOUBLES, STD_FEATURES, train_days
from telerisk.catalog.expressions import EVIDENCE_CTES, NODE_DOUBLES, NODE_INTS, NODE_SQL
from telerisk.catalog.joins import OUTCOME_CTES, OUTCOMES, outcomes
from telerisk.catalog.occlusion import OCCLUSION_CTES, occluded
from telerisk.catalog.registry import query
from telerisk.catalog.sqlmetrics import auc_sql, binary_sql
from telerisk.catalog.windows import SPLIT
from telerisk.functions.columns import horizon_probability
from telerisk.operators import daily as D
from telerisk.operators import labels as L
from telerisk.operators import landmarks as K
from telerisk.operators import masks, metrics, model, scoring, splits, tensors
from telerisk.operators.scaling import RobustScaler, long_features
from telerisk.session import materialise, shared_folder

#: every numeric column of the landmark table
FULL_COLUMNS = tuple(LANDMARK_NUMBERS)
FOLDS = 5


def with_folds(spark, sf, rows):
    """Stratified folds (W17) of the rows' development entities."""
    entities = outcomes(spark, sf).where("anchor_day = 20 AND label IS NOT NULL").select("gpsno", "label")
    return rows.join(splits.stratified_split(entities, 2026, FOLDS).where("fold IS NOT NULL").select("gpsno", "fold"), "gpsno")


def training_tables(spark, sf):
    """Landmarks and outcomes of development entities, written once."""
    daily = V.daily_table(spark, sf)
    dev = V.split_entities(spark, sf).where("is_development").select("gpsno")
    land = materialise(K.landmark_summary(daily, V.ANCHORS).join(dev, "gpsno", "left_semi"), "landmarks")
    out = materialise(outcomes(spark, sf, daily).join(dev, "gpsno", "left_semi"), "outcomes")
    return daily, land, out


FOLDED = f"""dev_land AS (SELECT l.* FROM landmarks l JOIN entities e USING (gpsno) WHERE is_development),
dev_outcomes AS (SELECT o.* FROM outcomes o JOIN entities e USING (gpsno) WHERE is_development)"""
DEV_CTES = f"{LANDMARK_CTES}, {Q.ENTITIES}, {OUTCOMES}, {FOLDED}"
_missing = " UNION ALL ".join(f"SELECT 'm_{c}' AS feature, COUNT({c}) < COUNT(*) AS flagged FROM dev_land" for c in FULL_COLUMNS)


@query("m1_hazard_model", f"""WITH {DEV_CTES} SELECT feature, TRUE AS optimal FROM (SELECT '(intercept)' AS feature UNION ALL SELECT UNNEST([{', '.join(f"'x_{c}'" for c in FULL_COLUMNS)}])
    UNION ALL SELECT feature FROM ({_missing}) m WHERE flagged) f""")
def m1(spark, sf):
    """The fit is at the optimum of its objective: gradient and penalty balance for the intercept, every feature and every missing flag."""
    _, land, out = training_tables(spark, sf)
    compressed = materialise(L.compress_outcomes(out), "compressed")
    fitted = model.HazardModel.fit(land, compressed, FULL_COLUMNS, c=0.1)
    return fitted.optimality(land, compressed).select("feature", (F.col("residual") <= F.col("allowed")).alias("optimal"))


COEFFICIENTS = {c: ((i % 5) - 2) / 16.0 for i, c in enumerate(FULL_COLUMNS)}


@query("m2_hazard_scoring", Q.shape(f"""SELECT gpsno, anchor_day, q AS daily_hazard, 1 - POW(1 - q, 40) AS probability FROM (
    SELECT gpsno, anchor_day, 1 / (1 + EXP(-(-4 + {' + '.join(f'COALESCE({c}, 0.0) * {v}::DOUBLE' for c, v in COEFFICIENTS.items())}))) AS q FROM landmarks) l""",
    ["daily_hazard", "probability"], ["anchor_day"], LANDMARK_CTES))
def m2(spark, sf):
    land = K.landmark_summary(V.daily(spark, sf), V.ANCHORS)
    table = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(v).alias("coefficient")) for c, v in COEFFICIENTS.items()]))
    scored = model.linear_hazard(long_features(land, ["gpsno", "anchor_day"], FULL_COLUMNS),
                                 spark.range(1).select(table.alias("_x")).select("_x.*"), -4.0)
    return scored.select("gpsno", "anchor_day", "daily_hazard", horizon_probability("daily_hazard", 40).alias("probability"))


def labelled_windows(spark, sf):
    daily = V.daily_table(spark, sf)
    dev = V.split_entities(spark, sf).where("is_development").select("gpsno")
    features = K.window_features(daily, (20,)).join(dev, "gpsno", "left_semi")
    labels = outcomes(spark, sf, daily).where("anchor_day = 20").select("gpsno", "label")
    return daily, materialise(features.join(labels, "gpsno"), "windows")


@query("m3_boosted_pair", f"""WITH {DEV_CTES} SELECT gpsno, CAST(first_event_day IS NOT NULL AS BIGINT) AS label, TRUE AS full_in_range, TRUE AS fallback_in_range,
    TRUE AS full_above_prior, TRUE AS fallback_above_prior FROM dev_outcomes WHERE anchor_day = 20""")
def m3(spark, sf):
    """Both models give every entity a probability, and rank better than the prior, whose AUC is one half."""
    _, rows = labelled_windows(spark, sf)
    full, fallback = K.window_columns(rows.drop("label"))
    rows = model.doubles(rows, full).withColumn("held", model.validation_share())
    pair = model.boosted_pair(rows, full, fallback, validation="held")
    one, two = (model.positive_probability(m.transform(rows), ["gpsno", "label"], "probability") for m in pair)
    one, two = materialise(one, "full"), materialise(two, "fallback")
    fine = F.col("probability").between(0, 1)
    above = lambda df, name: metrics.ranking_metrics(df).select((F.col("roc_auc") > 0.5).alias(name), F.lit(0).alias("_k"))
    both = one.select("gpsno", "label", fine.alias("full_in_range"), F.lit(0).alias("_k")).join(two.select("gpsno", fine.alias("fallback_in_range")), "gpsno")
    return both.join(above(one, "full_above_prior"), "_k").join(above(two, "fallback_above_prior"), "_k").drop("_k")


@query("m4_out_of_fold", Q.shape("""SELECT o.gpsno, o.anchor_day, s.fold, o.horizon_days, o.first_event_day, CASE WHEN first_event_day IS NULL THEN 0 ELSE 1 END AS label,
    TRUE AS in_range, TRUE AS fold_optimal FROM dev_outcomes o JOIN split s USING (gpsno) WHERE s.fold IS NOT NULL""", b=["anchor_day", "fold", "horizon_days",
    "first_event_day", "label"], ctes=f"""{DEV_CTES}, reference AS (SELECT gpsno, CASE WHEN first_event_day IS NULL THEN 0 ELSE 1 END AS label FROM outcomes WHERE anchor_day = 20),
    {SPLIT}"""))
def m4(spark, sf):
    """Every landmark is scored by the model of the other folds, whose fit is at its optimum."""
    _, land, out = training_tables(spark, sf)
    compressed = materialise(L.compress_outcomes(out), "compressed")
    land = materialise(with_folds(spark, sf, land), "folded")

    def fit_predict(train, held):
        rows = materialise(compressed.join(train.select("gpsno", "anchor_day"), ["gpsno", "anchor_day"], "left_semi"), "fold")
        fitted = model.HazardModel.fit(train, rows, FULL_COLUMNS, c=0.1)
        worse = fitted.optimality(train, rows).where("residual > allowed").count()
        scored = fitted.daily_hazard(held.select("gpsno", "anchor_day", *FULL_COLUMNS)).select("gpsno", "anchor_day", "daily_hazard")
        return scored.withColumn("fold_optimal", F.lit(worse == 0))

    oof = model.out_of_fold(land, FOLDS, fit_predict)
    rows = oof.join(out.select("gpsno", "anchor_day", "horizon_days", "first_event_day", "label"), ["gpsno", "anchor_day"])
    p = horizon_probability("daily_hazard", "horizon_days")
    return rows.select("gpsno", "anchor_day", "fold", "horizon_days", "first_event_day", "label",
                       ((F.col("daily_hazard") > 0) & (p >= F.col("daily_hazard") * (1 - 1e-9)) & (p < 1)).alias("in_range"), "fold_optimal")


@query("m5_occlusion_sensitivity", Q.shape("""SELECT event_code, state, COUNT(*) FILTER (WHERE active) AS active_vehicles,
    CASE WHEN COUNT(*) FILTER (WHERE active) > 0 THEN AVG(d) FILTER (WHERE active) ELSE AVG(d) END AS mean_signed_probability_delta,
    CASE WHEN COUNT(*) FILTER (WHERE active) > 0 THEN AVG(ABS(d)) FILTER (WHERE active) ELSE AVG(ABS(d)) END AS mean_abs_probability_delta
    FROM (SELECT *, baseline_probability - masked_probability AS d FROM occluded) o JOIN (SELECT * FROM (VALUES """ + ", ".join(
    f"('{s}', {c})" for s, cs in codes.STATES.items() for c in cs) + """) v(state, event_code)) s USING (event_code) GROUP BY event_code, state""",
    ["mean_signed_probability_delta", "mean_abs_probability_delta"], ["event_code"], OCCLUSION_CTES))
def m5(spark, sf):
    states = scoring.code_table(spark, codes.STATES, "state")
    return model.sensitivity(occluded(spark, sf), scoring.code_name(F.col("event_code")), states).drop("event_name")


def node_days(spark, sf):
    """The days of every cell of the tensor: quiet ones too, whose mask flag is part of the result."""
    return V.day_table(spark, sf)


_u = lambda h, p: f"((CAST('0x' || substr({h}, {p}, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE)"
_len = lambda h: f"CAST(FLOOR({_u(h, 1)} * 4) + 2 AS INTEGER)"
_start = lambda h: f"CAST(FLOOR({_u(h, 9)} * ({V.LAST_DAY} - {_len(h)} + 1)) + 1 AS INTEGER)"
STATE_MASKS = f"""blocks AS (SELECT gpsno, state, {_start('h')} AS start_day, {_len('h')} AS length FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY gpsno ORDER BY -LN({_u('h', 17)}) / p, state) AS no FROM (
    SELECT c.gpsno, s.state, s.p, md5('7:state:' || c.gpsno || ':' || s.state) AS h FROM profile c,
      (VALUES {', '.join(f"('{s}', {p}::DOUBLE)" for s, p in codes.STATE_MASK_PROBABILITY.items())}) AS s(state, p)) d) r WHERE no <= 2)"""


@query("m6_state_blocks", Q.shape("SELECT * FROM blocks", b=["start_day", "length"], ctes=f"{Q.PROFILE}, {STATE_MASKS}"))
def m6_blocks(spark, sf):
    return masks.state_blocks(V.profile(spark, sf), 7, V.LAST_DAY)


NODE_CTES = f"{Q.DAILY_CTES}, {Q.DAY_TABLE}, {NODE_SQL}"
SEED = 7
_target = max(1, round(V.LAST_DAY * 0.15))
_hidden = max(1, round(len(codes.EVENT_CODES) * 0.10))
EVENT_MASKS = f"""spans AS (SELECT gpsno, start_day, length FROM (
  SELECT *, COALESCE(SUM(length) OVER (PARTITION BY gpsno ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS covered FROM (
    SELECT gpsno, draw, {_start('h')} AS start_day, {_len('h')} AS length FROM (
      SELECT gpsno, draw, md5('{SEED}:span:' || gpsno || ':' || CAST(draw AS VARCHAR)) AS h FROM profile, (SELECT UNNEST(RANGE({ceil(_target / 2)})) AS draw) k) a) b) c
  WHERE covered < {_target}),
hidden AS (SELECT gpsno, event_code FROM (SELECT gpsno, event_code, ROW_NUMBER() OVER (PARTITION BY gpsno ORDER BY md5('{SEED}:code:' || gpsno || ':' || CAST(event_code AS VARCHAR))) AS no
  FROM profile, (VALUES {', '.join(f'({c})' for c in codes.EVENT_CODES)}) AS c(event_code)) r WHERE no <= {_hidden}),
event_hits AS (SELECT gpsno, day_index, event_code FROM (SELECT gpsno, UNNEST(RANGE(start_day, start_day + length)) AS day_index FROM spans) s,
    (VALUES {', '.join(f'({c})' for c in codes.EVENT_CODES)}) AS c(event_code)
  UNION SELECT gpsno, UNNEST(RANGE(1, {V.LAST_DAY + 1})), event_code FROM hidden)"""
STATE_HITS = "state_hits AS (SELECT DISTINCT gpsno, day_index, event_code FROM (SELECT gpsno, state, UNNEST(RANGE(start_day, start_day + length)) AS day_index FROM blocks) b JOIN (VALUES " + ", ".join(
    f"('{s}', {c})" for s, cs in codes.STATES.items() for c in cs) + ") AS v(state, event_code) USING (state))"


def masked_sql(hits: str) -> str:
    """Cells of the tensor with the fields under a hit at zero."""
    fields = ", ".join(f"CASE WHEN h.gpsno IS NULL THEN {f} ELSE 0 END AS {f}" if f in masks.MASKED_FIELDS else f"n.{f}" for f in (*NODE_DOUBLES, *NODE_INTS))
    return f"SELECT n.gpsno, {fields}, CASE WHEN h.gpsno IS NULL THEN 0 ELSE 1 END AS masked FROM nodes n LEFT JOIN {hits} h USING (gpsno, day_index, event_code)"


@query("m6_masked_events", Q.shape(masked_sql("event_hits"), NODE_DOUBLES, [*NODE_INTS, "masked"], f"{NODE_CTES}, {EVENT_MASKS}"))
def m6(spark, sf):
    """Event bundles hidden over spans and codes: exposure flags and night share stay."""
    entities = V.profile(spark, sf)
    return masks.mask_events(node_days(spark, sf), masks.event_spans(entities, 7, V.LAST_DAY), masks.masked_codes(entities, 7))


@query("m6_masked_states", Q.shape(masked_sql("state_hits"), NODE_DOUBLES, [*NODE_INTS, "masked"], f"{NODE_CTES}, {STATE_MASKS}, {STATE_HITS}"))
def m6_states(spark, sf):
    return masks.mask_states(node_days(spark, sf), masks.state_blocks(V.profile(spark, sf), 7, V.LAST_DAY))


CHANNELS = codes.DAY_NUMERIC
_gaps = max(1, round(len(CHANNELS) * 0.25))
CONTEXT_HITS = f"""gaps AS (SELECT gpsno, channel, UNNEST(RANGE(start_day, start_day + length)) AS day_index FROM (
  SELECT gpsno, channel, {_start('h')} AS start_day, {_len('h')} AS length, ROW_NUMBER() OVER (PARTITION BY gpsno ORDER BY md5('{SEED}:channel:' || gpsno || ':' || channel)) AS no
  FROM (SELECT gpsno, md5('{SEED}:context:' || gpsno) AS h FROM profile) p, (VALUES {', '.join(f"('{c}')" for c in CHANNELS)}) AS c(channel)) r WHERE no <= {_gaps})"""


@query("m6_masked_context", Q.shape("""SELECT l.gpsno, l.day_index, l.channel, CASE WHEN g.gpsno IS NULL THEN l.value ELSE 0.0 END AS value,
    CASE WHEN g.gpsno IS NULL THEN 0 ELSE 1 END AS masked FROM (""" + " UNION ALL ".join(
    f"SELECT gpsno, day_index, '{c}' AS channel, CAST({c} AS DOUBLE) AS value FROM daily" for c in CHANNELS) + """) l
    LEFT JOIN gaps g USING (gpsno, day_index, channel)""", ["value"], ["day_index", "masked"], f"{Q.DAILY_CTES}, {CONTEXT_HITS}"))
def m6_context(spark, sf):
    long = (long_features(V.daily(spark, sf), ["gpsno", "day_index"], CHANNELS).withColumnRenamed("feature", "channel"))
    return masks.mask_context(long, masks.context_spans(V.profile(spark, sf), 7, CHANNELS, V.LAST_DAY, fraction=0.25))


STATE_CHANNELS = [c for names in codes.STATE_CONTEXT.values() for c in names]
_context_rows = ", ".join(f"('{s}', '{c}')" for s, names in codes.STATE_CONTEXT.items() for c in names)
STATE_GAPS = f"""gaps AS (SELECT DISTINCT gpsno, day_index, channel FROM (SELECT gpsno, state, UNNEST(RANGE(start_day, start_day + length)) AS day_index FROM blocks) b
  JOIN (VALUES {_context_rows}) AS v(state, channel) USING (state))"""


def context_sql(channels) -> str:
    return """SELECT l.gpsno, l.day_index, l.channel, CASE WHEN g.gpsno IS NULL THEN l.value ELSE 0.0 END AS value, CASE WHEN g.gpsno IS NULL THEN 0 ELSE 1 END AS masked
    FROM (""" + " UNION ALL ".join(f"SELECT gpsno, day_index, '{c}' AS channel, CAST({c} AS DOUBLE) AS value FROM daily" for c in channels) + """) l
    LEFT JOIN gaps g USING (gpsno, day_index, channel)"""


def context_values(spark, sf, channels):
    return long_features(V.daily(spark, sf), ["gpsno", "day_index"], channels).withColumnRenamed("feature", "channel")


@query("m6_masked_state_context", Q.shape(context_sql(STATE_CHANNELS), ["value"], ["day_index", "masked"], f"{Q.DAILY_CTES}, {STATE_MASKS}, {STATE_GAPS}"))
def m6_state_context(spark, sf):
    """The context half of the state mask: channels of a state are hidden on the days on which its events are."""
    hits = masks.state_hits(masks.state_blocks(V.profile(spark, sf), 7, V.LAST_DAY))
    return masks.hide_context(context_values(spark, sf, STATE_CHANNELS), hits)


def _light(name: str, sql: str, share: float) -> str:
    """The masking SQL with the smaller shares of a light view and its own seed."""
    target, hidden = max(1, round(V.LAST_DAY * 0.05)), max(1, round(len(codes.EVENT_CODES) * share))
    return (sql.replace(f"'{SEED}:", f"'{SEED}:view:0:").replace(f"covered < {_target})", f"covered < {target})")
            .replace(f"RANGE({ceil(_target / 2)})", f"RANGE({ceil(target / 2)})").replace(f"no <= {_hidden})", f"no <= {hidden})")
            .replace(f"no <= {_gaps})", f"no <= {max(1, round(len(CHANNELS) * share))})"))


def light(spark, sf):
    return masks.light_view(node_days(spark, sf), context_values(spark, sf, CHANNELS), V.profile(spark, sf), SEED, V.LAST_DAY, CHANNELS)


@query("m6_light_events", Q.shape(masked_sql("event_hits"), NODE_DOUBLES, [*NODE_INTS, "masked"], f"{NODE_CTES}, {_light('events', EVENT_MASKS, 0.04)}"))
def m6_light_events(spark, sf):
    return light(spark, sf)[0]


@query("m6_light_context", Q.shape(context_sql(CHANNELS), ["value"], ["day_index", "masked"], f"{Q.DAILY_CTES}, {_light('context', CONTEXT_HITS, 0.04)}"))
def m6_light_context(spark, sf):
    return light(spark, sf)[1]


@query("m6_shuffled_states", """WITH seen AS (SELECT """ + Q.CODE + """ AS event_code, COUNT(*) AS n FROM events GROUP BY 1),
    slots AS (SELECT event_code, ROW_NUMBER() OVER (ORDER BY md5('2026:' || CAST(event_code AS VARCHAR))) AS no FROM (VALUES """ + ", ".join(
    f"({c})" for c in codes.EVENT_CODES) + """) v(event_code)),
    labels AS (SELECT state, ROW_NUMBER() OVER (ORDER BY event_code) AS no FROM (VALUES """ + ", ".join(
    f"('{s}', {c})" for s, cs in codes.STATES.items() for c in cs) + """) v(state, event_code))
    SELECT l.state, COUNT(*) AS codes, CAST(SUM(n) AS BIGINT) AS events FROM slots JOIN labels l USING (no) JOIN seen USING (event_code) GROUP BY l.state""")
def m6_shuffled(spark, sf):
    """Events per shuffled state: group sizes are those of the real states."""
    table = masks.shuffled_states(scoring.code_table(spark, codes.STATES, "state"), 2026)
    n = V.table(spark, sf, "events").groupBy(V._code().alias("event_code")).agg(F.count(F.lit(1)).alias("n"))
    return table.join(n, "event_code").groupBy("state").agg(F.count(F.lit(1)).alias("codes"), F.sum("n").alias("events"))


# --- reusable surfaces ----------------------------------------------------------------

@query("d1_score_report", Q.shape(f"""SELECT b.n, b.positive, b.brier, b.accuracy, b.f1, r.roc_auc, r.pr_auc FROM ({binary_sql('predictions', ['fold'])}) b
    JOIN ({auc_sql('predictions', ['fold'])}) r USING (fold)""", ["brier", "accuracy", "f1", "roc_auc", "pr_auc"], ctes=Q.PREDICTIONS))
def d1(spark, sf):
    return metrics.score_binary(V.predictions(spark, sf), ["fold"]).select("n", "positive", "brier", "accuracy", "f1", "roc_auc", "pr_auc")


@query("d2_row_expansion", Q.shape(f"""SELECT o.gpsno, o.anchor_day, COUNT(*) AS days, SUM(CASE WHEN g.d = first_event_day THEN 1 ELSE 0 END) AS hits
    FROM outcomes o JOIN (SELECT UNNEST(RANGE(1, {V.HORIZON + 1})) AS d) g ON g.d <= COALESCE(first_event_day, horizon_days) GROUP BY o.gpsno, o.anchor_day""",
    b=["anchor_day", "hits"], ctes=OUTCOME_CTES))
def d2(spark, sf):
    """Outcomes expanded to person-days: what the compressed rows stand for."""
    last = F.coalesce("first_event_day", "horizon_days")
    days = outcomes(spark, sf).select("gpsno", "anchor_day", "first_event_day", F.explode(F.sequence(F.lit(1), last)).alias("d"))
    return days.groupBy("gpsno", "anchor_day").agg(F.count(F.lit(1)).alias("days"), F.count_if(F.col("d") == F.col("first_event_day")).alias("hits"))


@query("d3_scaler_round_trip", Q.shape("SELECT feature, low, high, median, scale, observed FROM std_fitted", PARAM_DOUBLES, ctes=f"{Q.DAILY_CTES}, {FIT_STD}"))
def d3(spark, sf):
    path = shared_folder(spark, "scaler")
    RobustScaler.fit(train_days(spark, sf), STD_FEATURES).save(path)
    return RobustScaler.from_description(spark.read.parquet(path), STD_FEATURES).params


_sum = " + ".join(f"CAST(CAST({f} AS FLOAT) AS DOUBLE)" for f in ("log_count", "log_episodes", "log_rate_100km", "log_rate_hour", "occurred", "km_observed",
                                                                     "hours_observed", "night_share"))


@query("d3_node_sequences", Q.shape(f"""SELECT gpsno, COUNT(DISTINCT day_index) AS days, COUNT(DISTINCT event_code) AS codes, 8 AS features, SUM({_sum}) AS total
    FROM nodes GROUP BY gpsno""", ["total"], ["features"], NODE_CTES))
def d3_sequences(spark, sf):
    """Nested [day][code][feature] arrays per entity, summarised by shape and total."""
    seq = tensors.node_sequences(D.event_node_features(V.day_table(spark, sf), packed=True))
    flat = F.flatten(F.flatten("events"))
    return seq.select("gpsno", F.size("events").alias("days"), F.size(F.col("events")[0]).alias("codes"), F.size(F.col("events")[0][0]).alias("features"),
                      F.aggregate(flat, F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("m4_candidate_routing", Q.shape("""
    SELECT gpsno, CASE WHEN has_event_feed THEN 'full' WHEN trajectory_coverage > 0 OR imu_coverage > 0 THEN 'fallback_no_matched_event_record'
             ELSE 'prior_no_observed_behavior' END AS route,
           CASE WHEN has_event_feed THEN full_probability WHEN trajectory_coverage > 0 OR imu_coverage > 0 THEN full_probability / 2 ELSE prior END AS probability,
           CASE WHEN CASE WHEN has_event_feed THEN full_probability WHEN trajectory_coverage > 0 OR imu_coverage > 0 THEN full_probability / 2 ELSE prior END >= 0.5
             THEN 1 ELSE 0 END AS prediction_at_0_5
    FROM (SELECT e.*, ((CAST(gpsno AS BIGINT) * 17 + 150) % 101) / 128.0::DOUBLE AS full_probability, (SELECT AVG(label) FROM predictions WHERE anchor_day = 20) AS prior
          FROM evidence e WHERE anchor_day = 30) x""", ["probability"], ["prediction_at_0_5"], f"{EVIDENCE_CTES}, {Q.PREDICTIONS}"))
def m4_routing(spark, sf):
    from telerisk.catalog.expressions import evidence
    rows = evidence(spark, sf).where("anchor_day = 30").join(V.card_probability(spark, sf, (30,)).drop("anchor_day"), "gpsno")
    prior = L.prior_rate(V.predictions(spark, sf), 20).withColumn("_k", F.lit(0))
    rows = (rows.withColumn("full_probability", F.col("probability")).withColumn("fallback_probability", F.col("probability") / 2)
            .withColumn("_k", F.lit(0)).join(F.broadcast(prior), "_k"))  # one row
    return model.route_probability(rows, F.col("prior")).select("gpsno", "route", "probability", "prediction_at_0_5")
