"""Event-log operators: cleaning, episodes and entity-day event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telerisk import codes
from telerisk.functions.columns import epoch_second
from telerisk.operators.ordered import Stage, summarise

CLEAN_COLUMNS = ("gpsno", "event_ts", "event_type", "event_name", "lat", "lng", "speed")


def in_rule_window(df: DataFrame, ts: str, first_day: str, last_day: str, key: str = "gpsno") -> DataFrame:
    """Half-open window [first_day, last_day + 1 day) and a non-blank key."""
    low = F.lit(first_day).cast("date").cast("timestamp_ntz")
    high = F.date_add(F.lit(last_day).cast("date"), 1).cast("timestamp_ntz")
    return df.where((F.col(key) != "") & (F.col(ts) >= low) & (F.col(ts) < high))


def clean_events(canonical: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Set semantics on the seven event columns inside the rule window."""
    return (in_rule_window(canonical, "event_ts", first_day, last_day)
            .where(F.col("event_type").isNotNull()).select(*CLEAN_COLUMNS).dropDuplicates())


def target_events(clean: DataFrame, target_codes: Sequence[int] = codes.TARGET_CODES) -> DataFrame:
    return clean.where(F.col("event_type").isin(*target_codes)).select("gpsno", "event_ts", "event_type")


def mark_episodes(events: DataFrame, keys: Sequence[str] = ("gpsno", "event_type"), ts: str = "event_ts",
                  gap_s: int = 60, slice_s: int | None = None) -> DataFrame:
    """Adds ``episode_start``: no earlier event of the same key within ``gap_s`` whole seconds.

    The series of a key is cut into time slices; events of the last ``gap_s`` seconds of a
    slice are also seen by the next one.  One shuffle, and no key is sorted in one task.
    """
    slice_s = slice_s or max(3600, 4 * gap_s)
    if slice_s < gap_s:
        raise ValueError("a slice must be at least as long as the gap")
    second = F.col("_second")
    own = F.floor(second / slice_s)
    near_end = second - own * slice_s >= slice_s - gap_s
    copies = F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own)))
    w = Window.partitionBy(*keys, "_slice").orderBy("_second")
    seen = (events.withColumn("_second", epoch_second(ts)).select("*", copies.alias("_slice"))
            .withColumn("_before", F.lag("_second").over(w)))
    start = F.col("_before").isNull() | (second - F.col("_before") > gap_s)
    return (seen.where(F.col("_slice") == own).withColumn("episode_start", start)
            .drop("_second", "_slice", "_before"))


def code_counts(code: str, flag: str, wanted: Sequence[int]) -> list[Column]:
    """Count and episode-count aggregates for every code, in one pass."""
    return [F.expr(text) for c in wanted for text in (
        f"count_if({code} = {c}) AS event_{c}_count", f"count_if({code} = {c} AND {flag}) AS event_{c}_episodes")]


def event_daily(marked: DataFrame, wanted: Sequence[int] = codes.EVENT_CODES, speed_p90: bool = True,
                stage: Stage | None = None) -> DataFrame:
    """Entity-day event table: totals, episodes, unlisted codes, speed p90, per-code columns."""
    keyed = marked.withColumn("day", F.to_date("event_ts"))
    flag = F.col("episode_start")
    listed = ", ".join(map(str, wanted))
    totals = {"event_total_episodes": F.count_if(flag),
              "event_other_count": F.expr(f"count_if(event_type NOT IN ({listed}))")}
    order = ["gpsno", "day", "event_total_count", *totals]
    if not speed_p90:
        return keyed.groupBy("gpsno", "day").agg(
            F.count(F.lit(1)).alias("event_total_count"), *[a.alias(n) for n, a in totals.items()],
            *code_counts("event_type", "episode_start", wanted))
    per_code = {f"event_{c}_{kind}": F.expr(text) for c in wanted for kind, text in (
        ("count", f"count_if(event_type = {c})"), ("episodes", f"count_if(event_type = {c} AND episode_start)"))}
    out = summarise(keyed, ["gpsno", "day"], ["event_type", "episode_start"], {**totals, **per_code},
                    {"event_speed_p90": ("speed", 0.9)}, stage)
    return out.withColumnRenamed("n", "event_total_count").select(*order, "event_speed_p90", *per_code)
