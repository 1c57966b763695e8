"""Explainable 0-100 safety scorecards over many anchors at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telerisk import codes
from telerisk.functions.columns import clip, sum_of
from telerisk.operators.labels import group_active
from telerisk.operators.landmarks import (by_day, active_code_days, code_totals, exposure_totals, longest_streak)
from telerisk.operators.ordered import Stage, metric_quantiles, percentile_against, rank_by_value, staged
from telerisk.session import large

KEYS = ["gpsno", "anchor_day"]


def code_table(spark, groups: Mapping[str, Sequence[int]], name: str) -> DataFrame:
    """(group, event_code, position): a dimension of fixed size."""
    items = [F.struct(F.lit(g).alias(name), F.lit(c).alias("event_code"), F.lit(i).alias("position"))
             for g, members in groups.items() for i, c in enumerate(members)]
    return spark.range(1).select(F.explode(F.array(*items)).alias("_x")).select("_x.*")


def shrink_weights(importance: DataFrame, groups: Mapping[str, Sequence[int]], name: str = "state",
                   uniform_share: float = 0.5, value: str = "mean_abs_probability_delta") -> DataFrame:
    """Weights shrunk to uniform inside each group; an all-zero group is uniform."""
    table = code_table(importance.sparkSession, groups, name).join(
        importance.select("event_code", F.coalesce(value, F.lit(0.0)).alias("importance")), "event_code", "left")
    w = Window.partitionBy(name)
    raw = F.coalesce("importance", F.lit(0.0))
    size, whole = F.count(F.lit(1)).over(w), F.sum(raw).over(w)
    learned = F.when(whole > 0, raw / whole).otherwise(F.lit(1.0) / size)
    return table.select(name, "event_code", raw.alias("importance"),
                        (F.lit(uniform_share) / size + F.lit(1 - uniform_share) * learned).alias("weight"))


def event_burden(totals: DataFrame, exposure: DataFrame, recent_days: int = 14) -> DataFrame:
    """Exposure-normalised, trend-aware burden of every active (entity, code, anchor)."""
    t, n = F.col("anchor_day"), F.col("count_total")
    short = F.least(F.lit(recent_days), t)
    recent = F.col("count_recent") / short
    past = F.when(t > short, (n - F.col("count_recent")) / (t - short)).otherwise(0.0)
    trend = F.least(F.greatest(recent - past, F.lit(0.0)) / (past + 0.10), F.lit(5.0))
    burden = (F.log1p(1000 * n / (F.col("km") + 100)) + 0.40 * F.log1p(100 * n / (F.col("hours") + 1))
              + 0.80 * F.col("active_days") / t + 0.25 * F.log1p(trend))
    return (totals.where(n > 0).join(large(exposure.select(*KEYS, "km", "hours")), KEYS)
            .select(*KEYS, "event_code", burden.alias("burden")))


def state_signals(burden: DataFrame, weights: DataFrame, exposure: DataFrame,
                  states: Sequence[str] = ("upstream", "control", "proximal", "history", "quality")) -> DataFrame:
    """Weighted burden per state plus motion signal and coverage, one row per (entity, anchor)."""
    weighted = burden.join(F.broadcast(weights), "event_code")  # one row per code
    sums = weighted.groupBy(*KEYS).agg(*[
        F.sum(F.when(F.col("state") == s, F.col("burden") * F.col("weight")).otherwise(0.0)).alias(f"{s}_event")
        for s in states])
    return exposure.join(large(sums), KEYS, "left").select(
        *KEYS, *[F.coalesce(f"{s}_event", F.lit(0.0)).alias(f"{s}_event") for s in states],
        "control_imu", "trajectory_coverage", "imu_coverage")


def evidence(feed: Column, weights: tuple[float, float, float]) -> Column:
    a, b, c = weights
    return (F.lit(a) * feed.cast("double") + F.lit(b) * F.col("trajectory_coverage")
            + F.lit(c) * F.col("imu_coverage"))


def confidence_level(value: Column) -> Column:
    return (F.when(value >= 0.80, codes.CONFIDENCE_HIGH).when(value >= 0.50, codes.CONFIDENCE_MID)
            .otherwise(codes.CONFIDENCE_LOW))


def route(feed: Column) -> Column:
    seen = (F.col("trajectory_coverage") > 0) | (F.col("imu_coverage") > 0)
    return F.when(feed, codes.ROUTE_FULL).when(seen, codes.ROUTE_CONTEXT).otherwise(codes.ROUTE_PRIOR)


def grade_columns(score: Column, level: Column, bands: Sequence[tuple], unrated: tuple[str, str, str]) -> list[Column]:
    """Grade, risk level and action from fixed bands; low confidence is unrated."""
    out = []
    for name, low_value, pick in (("grade", unrated[0], 0), ("risk_level", unrated[1], 2),
                                  ("management_action", unrated[2], 3)):
        c = F.when(level == codes.CONFIDENCE_LOW, low_value)
        for band in bands:
            c = c.otherwise(band[pick]) if band[1] is None else c.when(score >= band[1], band[pick])
        out.append(c.alias(name))
    return out


def top_column(names: Mapping[str, str], suffix_of) -> Column:
    """Label of the largest column; the first one wins a tie."""
    items = [F.struct(suffix_of(n).alias("v"), F.lit(-i).alias("o"), F.lit(label).alias("label"))
             for i, (n, label) in enumerate(names.items())]
    return F.array_max(F.array(*items))["label"]


def deductions(names: Sequence[str], points: Mapping[str, float], power: int, risk=lambda n: F.col(n)) -> dict[str, Column]:
    if set(points) != set(names) or abs(sum(points.values()) - 100) > 1e-8:
        raise ValueError("maximum deductions must cover every dimension and sum to 100")
    return {n: F.lit(float(points[n])) * (risk(n) * risk(n) if power == 2 else risk(n)) for n in names}


def top_codes(values: DataFrame, value: str, keys: Sequence[str] = KEYS, k: int = 3) -> DataFrame:
    """The k largest positive contributions per key; an entity has at most one row per code."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col("event_code").desc())
    return (values.where(F.col(value) > 0).withColumn("position", F.row_number().over(w))
            .where(F.col("position") <= k))


def code_name(code: Column) -> Column:
    table = F.create_map(*[x for c, n in codes.EVENT_NAMES.items() for x in (F.lit(c), F.lit(n))])
    return table[code]


def join_names(top: DataFrame, text: Column, keys: Sequence[str] = KEYS, out: str = "top_risk_events") -> DataFrame:
    """At most k texts per key, joined in order."""
    item = F.struct("position", text.alias("s"))
    return top.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["s"]), "；").alias(out))


# --- scorecard A ----------------------------------------------------------------------

A_METRICS = {"model": "probability", "upstream": "upstream_event", "control_event": "control_event",
             "control_imu": "control_imu", "proximal": "proximal_event", "history": "history_event",
             "quality": "quality_event"}


def reference_signals(signals: DataFrame, reference_anchor: int) -> DataFrame:
    """Long (metric, value): the signals of development entities at the reference anchor, to be kept for later refreshes."""
    items = [F.struct(F.lit(m).alias("metric"), F.col(c).alias("value")) for m, c in A_METRICS.items()]
    chosen = signals.where(F.col("is_development") & (F.col("anchor_day") == reference_anchor))
    return chosen.select(F.explode(F.array(*items)).alias("_x")).select("_x.*")


def risk_percentiles(signals: DataFrame, reference_anchor: int, reference: DataFrame | None = None) -> DataFrame:
    """Percentile of each signal among development entities at the reference anchor, neutralised.

    ``signals`` needs has_event_feed, route, is_development and the probability.  A kept ``reference`` (metric, value)
    takes the place of the entities' own signals, so a few entities can be scored without the rest of the fleet.
    """
    items = [F.struct(F.lit(m).alias("metric"), F.col(c).alias("value")) for m, c in A_METRICS.items()]
    own = F.col("is_development") & (F.col("anchor_day") == reference_anchor) if reference is None else F.lit(False)
    long = (signals.withColumn("is_reference", own).select(*KEYS, "is_reference", F.explode(F.array(*items)).alias("_x"))
            .select(*KEYS, "is_reference", "_x.*"))
    if reference is not None:
        none = [F.lit(None).cast(signals.schema[k].dataType).alias(k) for k in KEYS]
        long = long.unionByName(reference.select(*none, F.lit(True).alias("is_reference"), "metric", "value"))
    scored = percentile_against(long, ["metric"], "value", "is_reference").where(F.col("gpsno").isNotNull())
    wide = scored.groupBy(*KEYS).agg(*[F.max(F.when(F.col("metric") == m, F.col("percentile"))).alias(f"_{m}")
                                       for m in A_METRICS])
    joined = signals.join(large(wide), KEYS)
    feed, prior = F.col("has_event_feed"), F.col("route") == codes.ROUTE_PRIOR
    control = F.when(feed, 0.75 * F.col("_control_event") + 0.25 * F.col("_control_imu")).otherwise(
        0.75 * 0.50 + 0.25 * F.col("_control_imu"))
    risks = {"model": F.col("_model"), "control": control}
    for name in ("upstream", "proximal", "history", "quality"):
        risks[name] = F.when(feed, F.col(f"_{name}")).otherwise(0.50)
    return joined.select(*signals.columns, *[clip(F.when(prior, 0.50).otherwise(risks[n]), 0.0, 1.0).alias(f"risk_{n}")
                                             for n in codes.SCORE_A_POINTS])


def card_signals(daily: DataFrame, entities: DataFrame, probability: DataFrame, weights: DataFrame, anchors: Sequence[int],
                 fallback_probability: float | DataFrame, stage: Stage | None = None) -> tuple[DataFrame, DataFrame]:
    """Signals with route and probability of every (entity, anchor), and the burden of each of their codes."""
    exposure = staged(exposure_totals(daily, anchors), stage, "exposure")
    burden = staged(event_burden(code_totals(active_code_days(daily), anchors), exposure), stage, "burden")
    signals = (state_signals(burden, weights, exposure).join(large(entities), "gpsno").join(large(probability), KEYS)
               .withColumn("route", route(F.col("has_event_feed"))))
    if isinstance(fallback_probability, DataFrame):
        fallback = fallback_probability.select(F.lit(codes.ROUTE_PRIOR).alias("route"), F.col("prior").alias("_prior"))
        signals = signals.join(F.broadcast(fallback), "route", "left")  # one row
    else:
        signals = signals.withColumn("_prior", F.lit(float(fallback_probability)))
    signals = signals.withColumn("probability", F.when(F.col("route") == codes.ROUTE_PRIOR, F.col("_prior"))
                                 .otherwise(F.col("probability"))).drop("_prior")
    return staged(signals, stage, "signals"), burden


def scorecard_a(daily: DataFrame, entities: DataFrame, probability: DataFrame, weights: DataFrame,
                anchors: Sequence[int], reference_anchor: int, fallback_probability: float | DataFrame, first_day: str,
                points: Mapping[str, float] = codes.SCORE_A_POINTS, stage: Stage | None = None, reference: DataFrame | None = None) -> DataFrame:
    """Cards of every (entity, anchor) in one job.  ``stage`` writes what several branches read.

    ``entities``: gpsno, has_event_feed, is_development.  ``probability``: gpsno, anchor_day,
    probability from any model.  A DataFrame fallback has one row with column ``prior``.  ``reference`` as in ``risk_percentiles``.
    """
    signals, burden = card_signals(daily, entities, probability, weights, anchors, fallback_probability, stage)
    risks = risk_percentiles(signals, reference_anchor, reference)
    cut = deductions(list(points), points, 2, lambda n: F.col(f"risk_{n}"))
    total = sum_of(list(cut.values()))
    cards = (risks.select("*", *[c.alias(f"{n}_deduction") for n, c in cut.items()], total.alias("total_deduction"))
             .withColumn("safety_score", clip(100.0 - F.col("total_deduction"), 0.0, 100.0))
             .withColumn("evidence_confidence", evidence(F.col("has_event_feed"), codes.SCORE_A_EVIDENCE))
             .withColumn("confidence_level", confidence_level(F.col("evidence_confidence")))
             .withColumn("evidence_confidence", clip("evidence_confidence", 0.0, 1.0))
             .withColumn("as_of_date", F.date_add(F.lit(first_day).cast("date"), F.col("anchor_day") - 1)))
    labels = {n: l for n, l in codes.SCORE_A_LABELS.items() if n != "model"}
    cards = cards.select("*", *grade_columns(F.col("safety_score"), F.col("confidence_level"), codes.SCORE_A_GRADES,
                                             codes.SCORE_A_UNRATED),
                         top_column(labels, lambda n: F.col(f"{n}_deduction")).alias("top_risk_dimension"))
    scored = weights.where(F.col("state") != "exposure")
    weighted = burden.join(F.broadcast(scored), "event_code").withColumn("value", F.col("burden") * F.col("weight"))
    names = join_names(top_codes(weighted, "value"),
                       F.concat(F.col("event_code").cast("string"), code_name(F.col("event_code"))))
    return (cards.join(large(names), KEYS, "left")
            .withColumn("top_risk_events", F.coalesce("top_risk_events", F.lit(codes.NO_EVENTS_A))))


def with_ranks(cards: DataFrame, groups: Sequence[str] = ("anchor_day",), score: str = "safety_score") -> DataFrame:
    """Safety rank (best first), risk rank (worst first) and fleet percentile of each card."""
    return (rank_by_value(cards, groups, score).withColumnRenamed("rank_desc", "safety_rank")
            .withColumnRenamed("rank_asc", "risk_rank").withColumnRenamed("rank_pct", "fleet_safety_percentile")
            .drop("mid_rank"))


# --- scorecard B ----------------------------------------------------------------------

def event_values(totals: DataFrame, exposure: DataFrame, reference: DataFrame,
                 mix: Mapping[str, float] = codes.SCORE_B_MIX, stage: Stage | None = None) -> DataFrame:
    """Event risk of every active (entity, code, anchor): mid-rank percentiles plus recency.

    Zero is no risk, so inactive codes score 0 and stay out of the reference.
    """
    t, n = F.col("anchor_day"), F.col("count_total")
    rows = (totals.where(n > 0).join(large(exposure.select(*KEYS, "km", "hours")), KEYS)
            .join(large(reference.select("gpsno", "is_development")), "gpsno")
            .select(*KEYS, "event_code", "is_development",
                    F.log1p(1000 * n / (F.col("km") + 100)).alias("rate_km"),
                    F.log1p(100 * n / (F.col("hours") + 1)).alias("rate_hour"),
                    (F.col("active_days") / t).alias("active_share"),
                    F.exp(-(t - F.col("last_count_day")) / 14.0).alias("recency")))
    rows = staged(rows, stage, "event-rows")
    ranked = ("rate_km", "rate_hour", "active_share")
    items = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ranked]
    keys = [*KEYS, "event_code"]
    long = (rows.select(*keys, "is_development", F.explode(F.array(*items)).alias("_x"))
            .select(*keys, "is_development", "_x.*"))
    scored = percentile_against(long, ["anchor_day", "event_code", "metric"], "value", "is_development",
                                mid_rank=True, where=F.col("value") > 0)
    # one row for each metric; added up in a fixed order, so that the last digits do not depend on the order of rows
    wide = scored.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col("percentile"))).alias(f"_{m}") for m in ranked])
    part = sum_of([F.lit(float(mix[m])) * F.col(f"_{m}") for m in ranked])
    return (wide.select(*keys, part.alias("_ranked")).join(large(rows.select(*keys, "recency")), keys)
            .select(*keys, (F.col("_ranked") + F.lit(float(mix["recency"])) * F.col("recency")).alias("event_value")))


def trend_risk(daily: DataFrame, reference: DataFrame, anchors: Sequence[int], wanted: Sequence[int],
               stage: Stage | None = None) -> DataFrame:
    """.50 recent share + .30 increase + .20 longest streak, each as a mid-rank percentile."""
    active = group_active(wanted, "count")
    days = longest_streak(daily, active)
    spans = sorted({min(14, max(7, a // 3)) for a in anchors})
    recents = {s: F.sum("active").over(by_day().rowsBetween(-(s - 1), 0)) for s in spans}
    everything = F.sum("active").over(by_day().rowsBetween(Window.unboundedPreceding, 0))
    t = F.col("day_index")
    length = F.least(F.lit(14), F.greatest(F.lit(7), F.floor(t / 3))).cast("int")
    recent_sum = F.coalesce(*[F.when(length == s, c) for s, c in recents.items()])
    at = days.select("gpsno", t.alias("anchor_day"), "streak", length.alias("_len"), recent_sum.alias("_recent"),
                     everything.alias("_sum")).where(F.col("anchor_day").isin(*anchors))
    a, n = F.col("anchor_day"), F.col("_len")
    recent = F.col("_recent") / n
    previous = F.when(a > n, (F.col("_sum") - F.col("_recent")) / (a - n)).otherwise(0.0)
    parts = {"recent": recent, "increase": F.greatest(recent - previous, F.lit(0.0)), "streak": F.col("streak").cast("double")}
    items = [F.struct(F.lit(m).alias("metric"), c.alias("value")) for m, c in parts.items()]
    long = (at.join(large(reference.select("gpsno", "is_development")), "gpsno")
            .select(*KEYS, "is_development", F.explode(F.array(*items)).alias("_x")).select(*KEYS, "is_development", "_x.*"))
    scored = percentile_against(staged(long, stage, "trend"), ["anchor_day", "metric"], "value", "is_development", mid_rank=True,
                                where=F.col("value") > 0)
    share = {"recent": 0.50, "increase": 0.30, "streak": 0.20}
    wide = scored.groupBy(*KEYS).agg(*[F.max(F.when(F.col("metric") == m, F.col("percentile"))).alias(f"_{m}") for m in share])
    return wide.select(*KEYS, sum_of([F.lit(w) * F.col(f"_{m}") for m, w in share.items()]).alias("trend"))


def scorecard_b(daily: DataFrame, entities: DataFrame, importance: DataFrame, anchors: Sequence[int],
                points: Mapping[str, float] = codes.SCORE_B_POINTS, uniform_share: float = 0.5,
                control_share: tuple[float, float] = (0.75, 0.25), stage: Stage | None = None) -> DataFrame:
    """Hierarchical card: events -> dimensions -> score.  ``entities`` as in ``scorecard_a``."""
    wanted = [c for members in codes.DIMENSIONS.values() for c in members]
    weights = shrink_weights(importance, codes.DIMENSIONS, "dimension", uniform_share)
    exposure = staged(exposure_totals(daily, anchors), stage, "exposure")
    totals = code_totals(active_code_days(daily, wanted), anchors)
    values = staged(event_values(totals, exposure, entities, stage=stage), stage, "event-values")
    weighted = values.join(F.broadcast(weights), "event_code")  # one row per code
    sums = weighted.groupBy(*KEYS).agg(*[
        F.sum(F.when(F.col("dimension") == d, F.col("weight") * F.col("event_value")).otherwise(0.0)).alias(f"_{d}")
        for d in codes.DIMENSIONS])
    motion = percentile_against(exposure.select(*KEYS, "control_imu").join(large(entities.select("gpsno", "is_development")), "gpsno"),
                                ["anchor_day"], "control_imu", "is_development", out="_imu", mid_rank=True)
    base = (exposure.join(large(entities), "gpsno").join(large(sums), KEYS, "left").join(large(motion.select(*KEYS, "_imu")), KEYS)
            .join(large(trend_risk(daily, entities, anchors, wanted, stage)), KEYS))
    risk = {d: F.coalesce(F.col(f"_{d}"), F.lit(0.0)) for d in codes.DIMENSIONS}
    risk["control"] = F.lit(control_share[0]) * risk["control"] + F.lit(control_share[1]) * F.col("_imu")
    risk["trend"] = F.col("trend")
    level = evidence(F.col("has_event_feed"), codes.SCORE_B_EVIDENCE)
    raw = base.select(*KEYS, "has_event_feed", "is_development", level.alias("evidence_confidence"),
                      confidence_level(level).alias("confidence_level"), *[risk[d].alias(f"raw_{d}") for d in points])
    raw = staged(raw, stage, "raw-risk")
    items = [F.struct(F.lit(d).alias("dimension"), F.col(f"raw_{d}").alias("value")) for d in points]
    reference = (raw.where("is_development").select("anchor_day", F.explode(F.array(*items)).alias("_x"))
                 .select("anchor_day", "_x.*"))
    typical = metric_quantiles(reference, ["anchor_day", "dimension"], "value", {"median": 0.5})
    typical = typical.groupBy("anchor_day").agg(*[
        F.max(F.when(F.col("dimension") == d, F.col("median"))).alias(f"_typical_{d}") for d in points])
    low = F.col("confidence_level") == codes.CONFIDENCE_LOW
    final = raw.join(F.broadcast(typical), "anchor_day").select(  # one row per anchor
        *KEYS, "has_event_feed", "evidence_confidence", "confidence_level",
        *[F.when(low, F.col(f"_typical_{d}")).otherwise(F.col(f"raw_{d}")).alias(f"risk_{d}") for d in points])
    cut = deductions(list(points), points, 1, lambda n: F.col(f"risk_{n}"))
    cards = (final.select("*", *[c.alias(f"deduction_{n}") for n, c in cut.items()],
                          sum_of(list(cut.values())).alias("total_deduction"))
             .withColumn("safety_score", clip(100.0 - F.col("total_deduction"), 0.0, 100.0)))
    cards = cards.select("*", *grade_columns(F.col("safety_score"), F.col("confidence_level"), codes.SCORE_B_GRADES,
                                             codes.SCORE_B_UNRATED),
                         top_column(codes.SCORE_B_LABELS, lambda n: F.col(f"deduction_{n}")).alias("top_risk_dimension"))
    factor = F.when(F.col("dimension") == "control", control_share[0]).otherwise(1.0)
    worth = F.coalesce(*[F.when(F.col("dimension") == d, F.lit(float(p))) for d, p in points.items()])
    contributions = weighted.withColumn("value", worth * factor * F.col("weight") * F.col("event_value"))
    text = F.format_string("%s%s(%.2f分)", F.col("event_code").cast("string"), code_name(F.col("event_code")), F.col("value"))
    names = join_names(top_codes(contributions, "value"), text)
    return (cards.join(large(names), KEYS, "left")
            .withColumn("top_risk_events", F.coalesce("top_risk_events", F.lit(codes.NO_EVENTS_B))))


def card_history(cards: DataFrame) -> DataFrame:
    """The delivery columns of the day-by-day history."""
    return cards.select("gpsno", "anchor_day", "as_of_date", "safety_score", "grade", "risk_level", "probability",
                        "evidence_confidence", "confidence_level", "route",
                        *[f"{s}_deduction" for s in codes.SCORE_A_POINTS])
