"""Self-supervision masks: short day spans and whole code groups, drawn from seeded hashes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telerisk import codes
from telerisk.functions.columns import seeded_hex
from telerisk.operators.daily import event_node_features
from telerisk.session import large

MASKED_FIELDS = ("log_count", "log_episodes", "log_rate_100km", "log_rate_hour", "occurred")


def uniform(hex_text: Column, position: int = 1) -> Column:
    """Uniform (0, 1) from eight hex digits."""
    return (F.conv(F.substring(hex_text, position, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def span(hex_text: Column, days: int, shortest: int = 2, longest: int = 5) -> tuple[Column, Column]:
    """(start day, length) of one contiguous span inside the calendar."""
    top = min(longest, days)
    length = (F.floor(uniform(hex_text, 1) * (top - shortest + 1)) + shortest).cast("int")
    start = (F.floor(uniform(hex_text, 9) * (days - length + 1)) + 1).cast("int")
    return start, length


def event_spans(entities: DataFrame, seed: int | str, days: int, day_fraction: float = 0.15) -> DataFrame:
    """Spans drawn until the target number of days is covered (at most target/2 spans)."""
    target = max(1, round(days * day_fraction))
    draws = entities.select("gpsno", F.explode(F.sequence(F.lit(0), F.lit(ceil(target / 2) - 1))).alias("draw"))
    start, length = span(seeded_hex(seed, F.lit("span"), "gpsno", "draw"), days)
    before = Window.partitionBy("gpsno").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    rows = draws.select("gpsno", "draw", start.alias("start_day"), length.alias("length"))
    return (rows.withColumn("_covered", F.coalesce(F.sum("length").over(before), F.lit(0)))
            .where(F.col("_covered") < target).drop("_covered"))


def masked_codes(entities: DataFrame, seed: int | str, wanted: Sequence[int] = codes.EVENT_CODES,
                 fraction: float = 0.10) -> DataFrame:
    """Codes hidden over the whole series of an entity (lowest hashes of a fixed list)."""
    count = max(1, round(len(wanted) * fraction))
    rows = (entities.select("gpsno", F.explode(F.array(*[F.lit(c) for c in wanted])).alias("event_code"))
            .withColumn("_hex", seeded_hex(seed, F.lit("code"), "gpsno", "event_code")))
    w = Window.partitionBy("gpsno").orderBy("_hex")
    return rows.withColumn("_no", F.row_number().over(w)).where(F.col("_no") <= count).select("gpsno", "event_code")


def context_spans(entities: DataFrame, seed: int | str, channels: Sequence[str], days: int, fraction: float = 0.10) -> DataFrame:
    """One short span per entity over a few context channels, as a sensor gap would look."""
    count = max(1, round(len(channels) * fraction))
    start, length = span(seeded_hex(seed, F.lit("context"), "gpsno"), days)
    rows = (entities.select("gpsno", start.alias("start_day"), length.alias("length"),
                            F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel"))
            .withColumn("_hex", seeded_hex(seed, F.lit("channel"), "gpsno", "channel")))
    w = Window.partitionBy("gpsno").orderBy("_hex")
    return (rows.withColumn("_no", F.row_number().over(w)).where(F.col("_no") <= count)
            .select("gpsno", "channel", "start_day", "length"))


def state_blocks(entities: DataFrame, seed: int, days: int, blocks: int = 2,
                 probability: Mapping[str, float] = codes.STATE_MASK_PROBABILITY) -> DataFrame:
    """Whole semantic states over short spans; states are drawn without replacement by weight."""
    items = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(p).alias("p")) for s, p in probability.items()]))
    drawn = entities.select("gpsno", items.alias("_s")).select("gpsno", "_s.*")
    drawn = drawn.withColumn("_hex", seeded_hex(seed, F.lit("state"), "gpsno", "state"))
    race = -F.log(uniform(F.col("_hex"), 17)) / F.col("p")
    w = Window.partitionBy("gpsno").orderBy(race, "state")
    start, length = span(F.col("_hex"), days)
    return (drawn.withColumn("_no", F.row_number().over(w)).where(F.col("_no") <= blocks)
            .select("gpsno", "state", start.alias("start_day"), length.alias("length")))


def _covered(df: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-semi keys (keys, day_index) of the covered days."""
    last = F.col("start_day") + F.col("length") - 1
    return (spans.select(*keys, F.explode(F.sequence("start_day", last)).alias("day_index"))
            .dropDuplicates([*keys, "day_index"]).withColumn("_hit", F.lit(True)))


def _masked_days(days: DataFrame, by_day: Column, n_of: Column) -> DataFrame:
    """Nodes of the day table ``days`` with the masked fields at zero, and the flag ``masked``.

    ``by_day`` hides all codes of a day; ``n_of`` maps its hidden codes to how often they are hidden.  A code that is hidden n
    times gives n rows, as a join on it would.
    """
    marked = days.withColumn("_day", F.coalesce(by_day, F.lit(False))).withColumn("_codes", n_of)
    most = F.coalesce(F.array_max(F.map_values("_codes")), F.lit(1))
    nodes = event_node_features(marked.withColumn("_copy", F.explode(F.sequence(F.lit(1), most))), keep=("_day", "_codes", "_copy"))
    n = F.coalesce(F.col("_codes")[F.col("event_code")], F.lit(0))
    hidden = F.col("_day") | (n > 0)
    kept = [F.when(hidden, F.lit(0).cast(nodes.schema[c].dataType)).otherwise(F.col(c)).alias(c)
            if c in MASKED_FIELDS else F.col(c) for c in nodes.columns if not c.startswith("_")]
    return nodes.where(F.greatest(n, F.lit(1)) >= F.col("_copy")).select(*kept, hidden.cast("int").alias("masked"))


def _code_map(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the map ``_codes`` from each hidden code to its number of hits."""
    counted = hits.groupBy(*keys, "event_code").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("event_code", "_n"))).alias("_codes"))


def mask_events(nodes: DataFrame, spans: DataFrame, hidden: DataFrame) -> DataFrame:
    """Zero the derived count, rate and occurrence fields; exposure flags stay.

    ``nodes`` has one row per node, or is the day table of which they are made (``daily.day_table``): then days and codes come
    to a day as one row of their entity, and the nodes, many times as many rows, are made after the join.
    """
    if "event_code" not in nodes.columns:
        days = _covered(nodes, spans, ["gpsno"]).groupBy("gpsno").agg(F.collect_set("day_index").alias("_days"))  # of one calendar
        entities = days.join(large(_code_map(hidden, ["gpsno"])), "gpsno", "full").withColumnRenamed("_codes", "_hidden")
        return _masked_days(nodes.join(large(entities), "gpsno", "left"), F.array_contains("_days", F.col("day_index")), F.col("_hidden"))
    by_day = _covered(nodes, spans, ["gpsno"]).withColumnRenamed("_hit", "_day")
    by_code = hidden.withColumn("_code", F.lit(True))
    joined = nodes.join(large(by_day), ["gpsno", "day_index"], "left").join(large(by_code), ["gpsno", "event_code"], "left")
    masked = F.coalesce("_day", F.lit(False)) | F.coalesce("_code", F.lit(False))
    kept = [F.when(masked, F.lit(0).cast(nodes.schema[c].dataType)).otherwise(F.col(c)).alias(c)
            if c in MASKED_FIELDS else F.col(c) for c in nodes.columns]
    return joined.select(*kept, masked.cast("int").alias("masked"))


def state_hits(blocks: DataFrame, states: Mapping[str, Sequence[int]] = codes.STATES,
               context: Mapping[str, Sequence[str]] = codes.STATE_CONTEXT) -> DataFrame:
    """State blocks as one relation (gpsno, day_index, event_code, channel): a hidden code or a hidden context channel.

    Event codes and context channels of a state are hidden on the same days, since both come from the same block.
    """
    items = [(s, c, None) for s, members in states.items() for c in members] + [(s, None, c) for s, names in context.items() for c in names]
    table = blocks.sparkSession.createDataFrame(items, "state string, event_code int, channel string")
    covered = _covered(blocks, blocks, ["gpsno", "state"]).join(F.broadcast(table), "state")  # one row per code and channel
    return covered.select("gpsno", "day_index", "event_code", "channel").dropDuplicates()


def mask_states(nodes: DataFrame, blocks: DataFrame, states: Mapping[str, Sequence[int]] = codes.STATES) -> DataFrame:
    """State blocks expanded to the event codes of the state."""
    return hide_nodes(nodes, state_hits(blocks, states, {}))


def hide_nodes(nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """Event nodes, or those of a day table (as in ``mask_events``), with the derived fields under a hit at zero, and the flag ``masked``."""
    if "event_code" not in nodes.columns:
        by_day = _code_map(hits.where(F.col("event_code").isNotNull() & F.col("day_index").isNotNull()), ["gpsno", "day_index"])
        entities = by_day.groupBy("gpsno").agg(F.map_from_entries(F.collect_list(F.struct("day_index", "_codes"))).alias("_hidden"))
        return _masked_days(nodes.join(large(entities), "gpsno", "left"), F.lit(False), F.col("_hidden")[F.col("day_index")])
    events = hits.where(F.col("event_code").isNotNull()).select("gpsno", "day_index", "event_code", F.lit(True).alias("_hit"))
    joined = nodes.join(large(events), ["gpsno", "day_index", "event_code"], "left")
    masked = F.coalesce("_hit", F.lit(False))
    kept = [F.when(masked, F.lit(0).cast(nodes.schema[c].dataType)).otherwise(F.col(c)).alias(c)
            if c in MASKED_FIELDS else F.col(c) for c in nodes.columns]
    return joined.select(*kept, masked.cast("int").alias("masked"))


def hide_context(long: DataFrame, hits: DataFrame) -> DataFrame:
    """Context values (gpsno, day_index, channel, value) at zero under a hit, and the flag ``masked``."""
    channels = hits.where(F.col("channel").isNotNull()).select("gpsno", "day_index", "channel", F.lit(True).alias("_hit"))
    masked = F.coalesce("_hit", F.lit(False))
    return long.join(large(channels), ["gpsno", "day_index", "channel"], "left").select(
        "gpsno", "day_index", "channel", F.when(masked, 0.0).otherwise(F.col("value")).alias("value"), masked.cast("int").alias("masked"))


def light_view(nodes: DataFrame, long: DataFrame, entities: DataFrame, seed: int, days: int, channels: Sequence[str],
               wanted: Sequence[int] = codes.EVENT_CODES, view: int = 0) -> tuple[DataFrame, DataFrame]:
    """A view of the same history for contrast: few and short gaps (5 % of days, 4 % of codes and channels).

    ``view`` numbers independent views of one seed.
    """
    own = f"{seed}:view:{view}"
    events = mask_events(nodes, event_spans(entities, own, days, 0.05), masked_codes(entities, own, wanted, 0.04))
    return events, mask_context(long, context_spans(entities, own, channels, days, 0.04))


def mask_context(long: DataFrame, spans: DataFrame) -> DataFrame:
    """Zero the spans of masked channels in a long (gpsno, day_index, channel, value) table."""
    hits = _covered(long, spans, ["gpsno", "channel"]).drop("_hit")
    return hide_context(long, hits)


def shuffled_states(table: DataFrame, seed: int = 2026) -> DataFrame:
    """Permute the state labels of the code table (fixed size); group sizes are preserved."""
    target = Window.orderBy(seeded_hex(seed, "event_code"))
    source = Window.orderBy("event_code")
    labels = table.select("state", F.row_number().over(source).alias("_no"))
    slots = table.select("event_code", F.row_number().over(target).alias("_no"))
    return slots.join(labels, "_no").select("event_code", "state")
