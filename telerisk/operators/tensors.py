"""Model inputs as array columns: one row per bag, days in offset order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telerisk.functions.columns import is_finite
from telerisk.session import large


def bag_days(bags: DataFrame, daily: DataFrame, features: Sequence[str], first_day: str, lookback: int = 20) -> DataFrame:
    """Each bag with its ``lookback`` days: day mask, raw values and value mask as arrays.

    A bag holds exactly ``lookback`` rows, so the collected lists are bounded.
    """
    offset = F.col("offset")
    days = (bags.select("gpsno", "anchor_date", F.explode(F.sequence(F.lit(0), F.lit(lookback - 1))).alias("offset"))
            .withColumn("day", F.date_add(F.date_sub("anchor_date", lookback - 1), offset))
            .withColumn("day_mask", (F.col("day") >= F.lit(first_day).cast("date")).cast("int")))
    values = [F.when(is_finite(F.col(f).cast("double")), F.col(f).cast("double")) for f in features]
    wide = daily.select("gpsno", "day", F.array(*values).alias("values"))
    blank = F.array_repeat(F.lit(None).cast("double"), len(features))
    joined = days.join(large(wide), ["gpsno", "day"], "left").withColumn(
        "values", F.when(F.col("day_mask") == 1, F.coalesce("values", blank)).otherwise(blank))
    item = F.struct("offset", "day_mask", "values")
    packed = joined.groupBy("gpsno", "anchor_date").agg(F.sort_array(F.collect_list(item)).alias("_d"))
    mask = lambda row: F.transform(row["values"], lambda v: v.isNotNull().cast("int"))
    return packed.select("gpsno", "anchor_date", F.transform("_d", lambda r: r["day_mask"]).alias("day_mask"),
                         F.transform("_d", lambda r: r["values"]).alias("x"),
                         F.transform("_d", mask).alias("value_mask"))


def one_hot(category: Column, categories: Sequence[str]) -> list[Column]:
    """Indicator per known category and a last "other" slot."""
    known = category.isin(*categories) if categories else F.lit(False)
    return [*[F.coalesce((category == c).cast("int"), F.lit(0)).alias(f"category_{i}") for i, c in enumerate(categories)],
            F.coalesce((~known).cast("int"), F.lit(1)).alias("category_other")]


def node_sequences(nodes: DataFrame) -> DataFrame:
    """Per entity: days x codes x features nested arrays (a calendar of fixed length).

    ``nodes`` has a row for each (entity, day, code), or is ``packed`` to one for each entity-day, which is shuffled once.
    """
    fields = ["log_count", "log_episodes", "log_rate_100km", "log_rate_hour",
              "occurred", "km_observed", "hours_observed", "night_share"]
    vector = lambda x: F.array(*[(F.col(c) if x is None else x[c]).cast("float") for c in fields])
    if "nodes" in nodes.columns:
        item = F.transform("nodes", lambda x: F.struct(x["event_code"].alias("event_code"), vector(x).alias("v")))
        # dealt by entity alone, so both groupings below need no further shuffle; an entity-day that repeats comes together
        day = (nodes.select("gpsno", "day_index", item.alias("_c")).repartition("gpsno").groupBy("gpsno", "day_index")
               .agg(F.sort_array(F.flatten(F.collect_list("_c"))).alias("_c")))
    else:
        day = nodes.groupBy("gpsno", "day_index").agg(F.sort_array(F.collect_list(F.struct("event_code", vector(None).alias("v")))).alias("_c"))
    day = day.select("gpsno", "day_index", F.transform("_c", lambda s: s["v"]).alias("codes"))
    return (day.groupBy("gpsno").agg(F.sort_array(F.collect_list(F.struct("day_index", "codes"))).alias("_d"))
            .select("gpsno", F.transform("_d", lambda s: s["codes"]).alias("events")))
