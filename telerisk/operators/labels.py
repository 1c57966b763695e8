"""Labels and outcomes: everything here reads only days after the anchor."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telerisk.functions.columns import counted, counted_sql, zero
from telerisk.session import large


def day_array(days: Sequence[str]) -> Column:
    return F.array(*[F.lit(d).cast("date") for d in days])


def count_after_anchor(targets: DataFrame, anchors: Sequence[str], horizon: int) -> DataFrame:
    """Target events in [anchor+1 day, anchor+horizon+1 days) per (entity, anchor).

    Each event lists the few anchors whose window holds it, so the range join becomes a
    filter plus one aggregate with map-side combine.
    """
    inside = F.filter(day_array(anchors), lambda a: (F.col("event_ts") >= F.date_add(a, 1).cast("timestamp_ntz"))
                      & (F.col("event_ts") < F.date_add(a, horizon + 1).cast("timestamp_ntz")))
    return (targets.select("gpsno", "event_ts", F.explode(inside).alias("anchor_date"))
            .groupBy("gpsno", "anchor_date").agg(F.count("event_ts").alias("accident_events"),
                                                 F.min("event_ts").alias("first_accident_ts")))


def anchor_grid(entities: DataFrame, anchors: Sequence[str]) -> DataFrame:
    return entities.select("gpsno", F.explode(day_array(anchors)).alias("anchor_date"))


def label_index(cover: DataFrame, targets: DataFrame, anchors: Sequence[str], final_anchor: str,
                first_day: str, horizon: int = 40, lookback: int = 20) -> DataFrame:
    """One row per (entity, anchor) with windows, label and label status."""
    counts = count_after_anchor(targets, anchors, horizon)
    grid = (anchor_grid(cover, anchors).join(large(counts), ["gpsno", "anchor_date"], "left")
            .withColumn("accident_events", F.coalesce("accident_events", F.lit(0))))
    anchor, hits, feed = F.col("anchor_date"), F.col("accident_events"), F.col("has_event_feed")
    unknown = anchor == F.lit(final_anchor).cast("date")
    return (grid.join(large(cover.select("gpsno", "has_event_feed", "has_trajectory", "has_imu")), "gpsno")
            .select("gpsno", "anchor_date",
                    F.greatest(F.lit(first_day).cast("date"), F.date_sub(anchor, lookback - 1)).alias("input_start"),
                    anchor.alias("input_end"), F.date_add(anchor, horizon).alias("future_end"),
                    F.when(~unknown & feed, (hits > 0).cast("int")).alias("label"),
                    F.when(unknown, "target_unknown").when(~feed, "unlabeled_no_event_feed")
                    .when(hits > 0, "observed_positive").otherwise("provisional_negative").alias("label_status"),
                    F.when(~unknown, hits).alias("accident_events"),
                    F.when(~unknown, F.col("first_accident_ts")).alias("first_accident_ts"),
                    "has_event_feed", "has_trajectory", "has_imu"))


def group_active(members: Sequence[int], kind: str = "episodes") -> Column:
    """Does any code of the group occur on the day?"""
    return F.expr(" + ".join(counted_sql(f"event_{c}_{kind}") for c in members) + " > 0")


def target_day(target_codes: Sequence[int]) -> Column:
    return group_active(target_codes, "count")


def make_outcomes(daily: DataFrame, anchors: Sequence[int], last_day: int, target_codes: Sequence[int],
                  max_horizon: int = 40) -> DataFrame:
    """First target day in (t, t+c], c = min(max_horizon, last_day - t); right-censored.

    ``daily`` is dense per entity (``day_index`` 1..last_day), so a window of at most
    ``last_day`` rows per entity answers every anchor in one pass.
    """
    w = Window.partitionBy("gpsno").orderBy("day_index").rowsBetween(1, max_horizon)
    t = F.col("day_index")
    c = F.least(F.lit(max_horizon), F.lit(last_day) - t)
    first = F.min(F.when(target_day(target_codes), t)).over(w)
    km = F.sum(F.greatest(zero("distance_km"), F.lit(0.0))).over(w)
    return (daily.select("gpsno", t.alias("anchor_day"), c.alias("horizon_days"),
                         (first - t).alias("first_event_day"), (km / F.greatest(c, F.lit(1))).alias("future_km_per_day"))
            .where(F.col("anchor_day").isin(*anchors) & (F.col("horizon_days") >= 1))
            .withColumn("label", F.col("first_event_day").isNotNull().cast("int")))


def compress_outcomes(outcomes: DataFrame) -> DataFrame:
    """At most two weighted rows per landmark whose logistic loss equals the daily survival loss."""
    unit = F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("gpsno"))
    hit = F.col("first_event_day").isNotNull()
    quiet = F.when(hit, F.col("first_event_day") - 1).otherwise(F.col("horizon_days"))
    rows = F.array(F.struct(F.lit(0).alias("y"), (quiet * unit).alias("weight")),
                   F.struct(F.lit(1).alias("y"), F.when(hit, unit).otherwise(0.0).alias("weight")))
    return (outcomes.select("gpsno", "anchor_day", rows.alias("_rows"))
            .select("gpsno", "anchor_day", F.explode(F.filter("_rows", lambda r: r["weight"] > 0)).alias("_r"))
            .select("gpsno", "anchor_day", "_r.y", "_r.weight"))


def horizon_labels(daily: DataFrame, anchors: Sequence[int], horizons: Sequence[int], last_day: int,
                   target_codes: Sequence[int]) -> DataFrame:
    """Long multi-horizon labels; a horizon beyond the last day is masked, never a negative."""
    order = Window.partitionBy("gpsno").orderBy("day_index")
    hit = target_day(target_codes).cast("int")
    parts = [F.struct(F.lit(h).alias("horizon_days"),
                      F.coalesce(F.max(hit).over(order.rowsBetween(1, h)), F.lit(0)).alias("seen")) for h in horizons]
    long = (daily.select("gpsno", F.col("day_index").alias("anchor_day"), F.array(*parts).alias("_p"))
            .where(F.col("anchor_day").isin(*anchors))
            .select("gpsno", "anchor_day", F.explode("_p").alias("_x")).select("gpsno", "anchor_day", "_x.*"))
    ok = F.col("anchor_day") + F.col("horizon_days") <= last_day
    return long.select("gpsno", "anchor_day", "horizon_days", F.when(ok, F.col("seen")).otherwise(0).alias("label"),
                       ok.cast("int").alias("available"))


def future_group_occurrence(daily: DataFrame, groups: Mapping[str, Sequence[int]], horizon: int = 7) -> DataFrame:
    """For each day and group: does any code of the group have an episode in the next days?"""
    w = Window.partitionBy("gpsno").orderBy("day_index").rowsBetween(1, horizon)
    flags = [F.coalesce(F.max(group_active(members).cast("int")).over(w), F.lit(0)).alias(f"future_{g}") for g, members in groups.items()]
    return daily.select("gpsno", "day_index", *flags)


def future_state_maxima(daily: DataFrame, states: Mapping[str, Sequence[int]], horizon: int, last_day: int) -> DataFrame:
    """Future maximum of occurrence and log1p(count) per state, for days with a complete window."""
    w = Window.partitionBy("gpsno").orderBy("day_index").rowsBetween(1, horizon)
    columns = []
    for name, members in states.items():
        top = F.greatest(*[counted(f"event_{c}_count") for c in members]) if len(members) > 1 else counted(f"event_{members[0]}_count")
        columns += [F.max((top > 0).cast("int")).over(w).alias(f"{name}_occurs"),
                    F.max(F.log1p(top)).over(w).alias(f"{name}_magnitude")]
    return daily.select("gpsno", "day_index", *columns).where(F.col("day_index") + horizon <= last_day)


def base_hazard(outcomes: DataFrame, *groups: str) -> DataFrame:
    """Events per person-day, clamped to [1e-4, 0.1]."""
    days = F.sum(F.coalesce("first_event_day", "horizon_days"))
    events = F.count("first_event_day")
    rate = events / F.greatest(days, F.lit(1))
    return outcomes.groupBy(*groups).agg(events.alias("events"), days.alias("person_days"),
                                         F.least(F.greatest(rate, F.lit(1e-4)), F.lit(0.1)).alias("base_hazard"))


def positive_weights(targets: DataFrame, columns: Sequence[str], last_full_day: int) -> DataFrame:
    """negatives/positives per target group, clamped to [1, 20], over days with a full future."""
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).alias("y")) for c in columns]))
    y = F.col("y")
    weight = (F.count(y) - F.sum(y)) / F.greatest(F.sum(y), F.lit(1))
    return (targets.where(F.col("day_index") <= last_full_day).select(items.alias("_x")).select("_x.*")
            .groupBy("target").agg(F.count(y).alias("cells"), F.sum(y).alias("positives"),
                                   F.least(F.greatest(weight, F.lit(1.0)), F.lit(20.0)).alias("positive_weight")))


def code_support(active: DataFrame) -> DataFrame:
    """Entities with any history per code, and the rarity weight 1+20/(1+support)."""
    pairs = active.where(F.col("n") > 0).select("gpsno", "event_code").dropDuplicates()
    return (pairs.groupBy("event_code").agg(F.count(F.lit(1)).alias("support"))
            .withColumn("rarity", 1 + F.lit(20.0) / (1 + F.col("support"))))


def prior_rate(outcomes: DataFrame, anchor: int) -> DataFrame:
    return outcomes.where(F.col("anchor_day") == anchor).agg(F.avg("label").alias("prior"))


def survival_loss(rows: DataFrame, hazard: str = "daily_hazard") -> DataFrame:
    """Right-censored log loss: mean over the anchors of an entity, then over entities."""
    q, j = F.col(hazard), F.col("first_event_day")
    quiet = F.when(j.isNotNull(), j - 1).otherwise(F.col("horizon_days"))
    loss = -quiet * F.log1p(-q) - F.when(j.isNotNull(), F.log(q)).otherwise(0.0)
    per_entity = rows.groupBy("gpsno").agg(F.avg(loss).alias("loss"))
    return per_entity.agg(F.count(F.lit(1)).alias("entities"), F.avg("loss").alias("survival_loss"))
