"""Data contracts as rule tables (rule, violations) and one-pass quality counters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telerisk import codes
from telerisk.errors import ContractError
from telerisk.functions.columns import is_finite
from telerisk.operators.labels import count_after_anchor
from telerisk.operators.splits import rule_rows
from telerisk.session import large

#: rows that one task groups by their key
KEYS_OF_TASK = 1 << 20


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def require(rules: DataFrame, limit: int = 20) -> DataFrame:
    """Raise if any rule of a (small) rule table is violated, else return it."""
    broken = rules.where(F.col("violations") > 0).limit(limit).collect()
    if broken:
        raise ContractError("; ".join(f"{r['rule']}: {r['violations']}" for r in broken))
    return rules


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def dealt_by_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of all rows, in parts of about KEYS_OF_TASK rows, equal keys together."""
    rows = df.select(*keys)
    return rows.repartition(max(1, -(-rows.count() // KEYS_OF_TASK)), *keys)


def has_duplicates(df: DataFrame, keys: Sequence[str]) -> bool:
    """Does a key occur twice?  (Null is a key like any other.)

    Rows are dealt by key before they are grouped: otherwise the task that reads a file of entities would hold every
    (entity, day) that its rows explode to.
    """
    return not duplicate_keys(dealt_by_key(df, keys), keys).isEmpty()


def unique_key(df: DataFrame, keys: Sequence[str], rule: str = "duplicate_key") -> DataFrame:
    return duplicate_keys(df, keys).agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def require_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df


def range_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One scan: number of rows for which each predicate is not true."""
    row = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, ok in rules.items()])
    return rule_rows(row, list(rules))


def calendar_gaps(daily: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Entities whose rows are not exactly the consecutive days of the calendar."""
    low, high = F.lit(first_day).cast("date"), F.lit(last_day).cast("date")
    per = daily.groupBy("gpsno").agg(F.count(F.lit(1)).alias("rows"), F.min("day").alias("first_day"),
                                     F.max("day").alias("last_day"), F.countDistinct("day").alias("days"))
    expected = F.datediff(high, low) + 1
    complete = (F.col("rows") == expected) & (F.col("days") == expected) & (F.col("first_day") == low) & (F.col("last_day") == high)
    return per.where(~complete)


def spread_over_files(df: DataFrame, key: str = "gpsno", file: str = "source_file") -> DataFrame:
    """Entities found in more than one source file."""
    return (df.groupBy(key).agg(F.countDistinct(file).alias("files")).where(F.col("files") > 1)
            .agg(F.count(F.lit(1)).alias("cross_part_vehicles")))


def event_counters(canonical: DataFrame, rule_end: str) -> DataFrame:
    after = F.col("event_ts") >= F.date_add(F.lit(rule_end).cast("date"), 1).cast("timestamp_ntz")
    return canonical.agg(
        F.count(F.lit(1)).alias("raw_rows"), F.countDistinct("gpsno").alias("raw_vehicles"),
        F.count_if(F.col("event_ts").isNull() | F.col("event_type").isNull() | (F.col("gpsno") == "")).alias("invalid_key_or_time_rows"),
        F.count_if(after).alias("after_rule_end_rows"),
        F.count_if(F.col("bad_lat") | F.col("bad_lng")).alias("bad_coordinate_rows"),
        F.count_if(F.col("bad_speed")).alias("bad_speed_rows"))


def trajectory_counters(canonical: DataFrame, rule_end: str) -> DataFrame:
    after = F.col("ts") >= F.date_add(F.lit(rule_end).cast("date"), 1).cast("timestamp_ntz")
    return canonical.agg(
        F.count(F.lit(1)).alias("raw_rows"), F.countDistinct("gpsno").alias("raw_vehicles"),
        F.count_if(F.col("ts").isNull() | (F.col("gpsno") == "")).alias("invalid_key_or_time_rows"),
        F.count_if(after).alias("after_rule_end_rows"),
        F.count_if((F.col("distance_cm") > 0) & (F.col("run_time_s") == 0)).alias("distance_without_runtime_rows"),
        F.count_if(F.col("speed").isNull()).alias("invalid_speed_rows"))


def imu_counters(canonical: DataFrame, rule_end: str) -> DataFrame:
    after = F.col("ts") >= F.date_add(F.lit(rule_end).cast("date"), 1).cast("timestamp_ntz")
    missing = lambda *cs: reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cs])
    return canonical.agg(
        F.count(F.lit(1)).alias("raw_rows"), F.countDistinct("gpsno").alias("raw_vehicles"),
        F.count_if(F.col("ts").isNull() | (F.col("gpsno") == "")).alias("invalid_key_or_time_rows"),
        F.count_if(after).alias("after_rule_end_rows"),
        F.count_if(F.col("ems_speed").isNull()).alias("ems_speed_missing_rows"),
        F.count_if(F.col("gps_speed").isNull()).alias("gps_speed_missing_rows"),
        F.count_if(missing("ax", "ay", "az")).alias("accel_invalid_rows"),
        F.count_if(missing("gx", "gy", "gz")).alias("gyro_invalid_rows"))


def preprocessing_report(profile: DataFrame, daily: DataFrame, bags: DataFrame, targets: DataFrame,
                         first_day: str, last_day: str, anchors: Sequence[str], final_anchor: str,
                         horizon: int) -> DataFrame:
    """Long (item, value) report of the processed tables, with labels derived a second time."""
    low, high = F.lit(first_day).cast("date"), F.lit(last_day).cast("date")
    end = F.date_add(high, 1).cast("timestamp_ntz")
    per_day = daily.groupBy("gpsno", "day").agg(F.count(F.lit(1)).alias("n"))
    per_entity = per_day.groupBy("gpsno").agg(F.sum("n").alias("n"))
    per_bag = bags.groupBy("gpsno", "anchor_date").agg(F.count(F.lit(1)).alias("n"))
    again = count_after_anchor(targets, anchors, horizon).select("gpsno", "anchor_date", F.col("accident_events").alias("again"))
    labelled = bags.where((F.col("anchor_date") != F.lit(final_anchor).cast("date")) & F.col("label").isNotNull())
    wrong = labelled.join(again, ["gpsno", "anchor_date"], "left").where(
        F.col("label") != (F.coalesce("again", F.lit(0)) > 0).cast("int"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return union_all([items_of(x) for x in (
        profile.agg(F.count(F.lit(1)).alias("profile_rows"), F.countDistinct("gpsno").alias("profile_vehicles")),
        daily.agg(F.count(F.lit(1)).alias("daily_rows"),
                  F.count_if((F.col("day") < low) | (F.col("day") > high)).alias("daily_rows_outside_window"),
                  F.count_if((F.col("distance_km") < 0) | (F.col("drive_hours") < 0)).alias("negative_measures")),
        per_day.agg(F.sum(F.col("n") - 1).alias("daily_duplicates")),
        per_entity.agg(F.min("n").alias("days_per_vehicle_min"), F.max("n").alias("days_per_vehicle_max")),
        bags.agg(F.count(F.lit(1)).alias("bag_rows"), F.countDistinct("anchor_date").alias("bag_anchors")),
        per_bag.agg(F.sum(F.col("n") - 1).alias("bag_duplicates")),
        bags.where(F.col("anchor_date") == F.lit(final_anchor).cast("date")).agg(
            F.count(F.lit(1)).alias("target_rows"), F.count("label").alias("target_known_labels")),
        count(wrong, "label_mismatches"),
        count(targets.where(F.col("event_ts") >= end), "after_rule_end_events"))])


def items_of(row: DataFrame) -> DataFrame:
    items = [F.struct(F.lit(c).alias("item"), F.coalesce(F.col(c).cast("long"), F.lit(0)).alias("value")) for c in row.columns]
    return row.select(F.explode(F.array(*items)).alias("_x")).select("_x.*")


def label_contract(bags: DataFrame, reference_anchor: str, first_day: str, horizon: int) -> DataFrame:
    """Rules of the supervised anchor: 0/1 labels, matching status, exact window dates."""
    a = F.lit(reference_anchor).cast("date")
    rows = bags.where((F.col("anchor_date") == a) & F.col("label").isNotNull())
    expected = F.when(F.col("label") == 1, "observed_positive").otherwise("provisional_negative")
    rules = range_rules(rows, {
        "label_not_binary": F.col("label").isin(0, 1), "status_differs": F.col("label_status") == expected,
        "input_start_differs": F.col("input_start") == F.lit(first_day).cast("date"),
        "input_end_differs": F.col("input_end") == a, "future_end_differs": F.col("future_end") == F.date_add(a, horizon)})
    both = rows.agg((F.lit(2) - F.countDistinct("label")).alias("missing_class"))
    return union_all([rules, rule_rows(both, ["missing_class"]), unique_key(rows, ["gpsno"], "duplicate_vehicle")])


def prediction_index_contract(bags: DataFrame, profile: DataFrame, final_anchor: str, first_input: str) -> DataFrame:
    a = F.lit(final_anchor).cast("date")
    rows = bags.where(F.col("anchor_date") == a)
    rules = range_rules(rows, {"label_known": F.col("label").isNull(), "status_differs": F.col("label_status") == "target_unknown",
                               "input_start_differs": F.col("input_start") == F.lit(first_input).cast("date"),
                               "input_end_differs": F.col("input_end") == a})
    missing = profile.join(rows, "gpsno", "left_anti").agg(F.count(F.lit(1)).alias("missing_vehicle"))
    extra = rows.join(profile, "gpsno", "left_anti").agg(F.count(F.lit(1)).alias("unknown_vehicle"))
    return union_all([rules, rule_rows(missing, ["missing_vehicle"]), rule_rows(extra, ["unknown_vehicle"]),
                      unique_key(rows, ["gpsno"], "duplicate_vehicle")])


def prediction_contract(candidates: DataFrame, profile: DataFrame, threshold: float = 0.5,
                        prior_route: str = codes.ROUTE_PRIOR, expected_prior: int | None = None) -> DataFrame:
    """Population equals the profile, probability finite in [0,1], class equals the threshold."""
    p = F.col("probability")
    rules = range_rules(candidates, {
        "probability_out_of_range": is_finite(p) & p.between(0, 1),
        "class_differs": F.col("prediction") == (p >= threshold).cast("int"),
        "status_differs": F.col("label_status") == "future_unknown"})
    missing = profile.join(candidates, "gpsno", "left_anti").agg(F.count(F.lit(1)).alias("missing_vehicle"))
    extra = candidates.join(profile, "gpsno", "left_anti").agg(F.count(F.lit(1)).alias("unknown_vehicle"))
    parts = [rules, rule_rows(missing, ["missing_vehicle"]), rule_rows(extra, ["unknown_vehicle"]),
             unique_key(candidates, ["gpsno"], "duplicate_vehicle")]
    if expected_prior is not None:
        routed = candidates.agg(F.abs(F.count_if(F.col("route") == prior_route) - F.lit(expected_prior)).alias("prior_routed_differs"))
        parts.append(rule_rows(routed, ["prior_routed_differs"]))
    return union_all(parts)


def score_contract(cards: DataFrame, history: DataFrame, weights: DataFrame, fleet: DataFrame, profile: DataFrame,
                   anchors: Sequence[int], group: str = "state") -> DataFrame:
    """Delivery rules of a scorecard run."""
    score = F.col("safety_score")
    low, unrated = F.col("confidence_level") == codes.CONFIDENCE_LOW, F.col("grade") == "U"
    rules = range_rules(cards, {
        "score_out_of_range": score.between(0, 100),
        "deductions_do_not_reconcile": F.abs(score - (100 - F.col("total_deduction"))) <= 1e-8,
        "unknown_grade": F.col("grade").isin("A", "B", "C", "D", "E", "U"), "low_confidence_iff_unrated": low == unrated,
        "null_value": reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cards.columns])})
    missing = profile.join(large(cards), "gpsno", "left_anti").agg(F.count(F.lit(1)).alias("missing_vehicle"))
    extra = cards.join(large(profile), "gpsno", "left_anti").agg(F.count(F.lit(1)).alias("unknown_vehicle"))
    per = history.groupBy("gpsno").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("anchor_day").alias("anchors"))
    incomplete = per.agg(F.count_if((F.col("rows") != len(anchors)) | (F.col("anchors") != len(anchors))).alias("incomplete_history"))
    outside = history.agg(F.count_if(~F.col("anchor_day").isin(*anchors)).alias("history_anchor_outside"))
    sums = (weights.groupBy(group).agg(F.sum("weight").alias("s"))
            .agg(F.count_if(F.abs(F.col("s") - 1) > 1e-8).alias("weights_do_not_sum_to_one")))
    total = (fleet.agg(F.sum("vehicles").alias("n"), F.lit(0).alias("_k"))
             .join(profile.agg(F.count(F.lit(1)).alias("m"), F.lit(0).alias("_k")), "_k")
             .select((F.col("n") != F.col("m")).cast("long").alias("fleet_total_differs")))
    return union_all([rules, *[rule_rows(x, x.columns) for x in (missing, extra, incomplete, outside, sums, total)],
                      unique_key(cards, ["gpsno"], "duplicate_vehicle")])


def code_partition(table: DataFrame, wanted: Sequence[int] = codes.EVENT_CODES) -> DataFrame:
    """Every event code belongs to exactly one group."""
    codes_df = table.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in wanted])).alias("event_code"))
    missing = codes_df.join(table, "event_code", "left_anti").agg(F.count(F.lit(1)).alias("code_missing"))
    unknown = table.join(codes_df, "event_code", "left_anti").agg(F.count(F.lit(1)).alias("code_unknown"))
    return union_all([rule_rows(missing, ["code_missing"]), rule_rows(unknown, ["code_unknown"]),
                      unique_key(table, ["event_code"], "code_in_two_groups")])
