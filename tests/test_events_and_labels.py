import datetime as dt
import math
import random

import pytest
from conftest import code_day_frame, rows
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telerisk import codes
from telerisk.operators import episodes, labels


def test_episode_gap_is_strictly_greater(spark):
    base = dt.datetime(2026, 6, 1, 0, 59, 30)
    secs = [0, 60, 121, 121.9, 181.9]
    df = spark.createDataFrame([("a", 1, base + dt.timedelta(seconds=s)) for s in secs], "gpsno string, event_type int, event_ts timestamp_ntz")
    got = rows(episodes.mark_episodes(df, gap_s=60), "event_ts")
    assert [r["episode_start"] for r in got] == [True, False, True, False, False]


def test_sliced_episodes_equal_plain_lag(spark):
    rng = random.Random(1)
    base = dt.datetime(2026, 6, 1)
    data = [(rng.choice("hhhhx"), rng.choice((1, 2)), base + dt.timedelta(seconds=rng.randrange(40000))) for _ in range(1500)]
    df = spark.createDataFrame(data, "gpsno string, event_type int, event_ts timestamp_ntz").dropDuplicates()
    w = Window.partitionBy("gpsno", "event_type").orderBy("event_ts")
    gap = F.unix_timestamp("event_ts") - F.unix_timestamp(F.lag("event_ts").over(w))
    plain = df.withColumn("s", F.coalesce(gap > 60, F.lit(True)))
    sliced = episodes.mark_episodes(df, gap_s=60, slice_s=100)
    order = ("gpsno", "event_type", "event_ts")
    assert [r["episode_start"] for r in rows(sliced, *order)] == [r["s"] for r in rows(plain, *order)]


def test_outcomes_start_the_day_after_the_anchor(spark):
    hit = {"event_11804_count": 1}
    df = code_day_frame(spark, {"a": {20: hit, 21: hit, 60: hit}, "b": {}})
    got = {(r["gpsno"], r["anchor_day"]): r for r in rows(labels.make_outcomes(df, (14, 20, 53, 60), 60, codes.TARGET_CODES))}
    assert got[("a", 14)]["first_event_day"] == 6 and got[("a", 20)]["first_event_day"] == 1
    assert got[("a", 53)]["first_event_day"] == 7 and got[("a", 53)]["horizon_days"] == 7
    assert got[("b", 20)]["label"] == 0 and got[("b", 20)]["first_event_day"] is None
    assert ("a", 60) not in got


def test_horizon_masks(spark):
    hit = {"event_11803_count": 1}
    df = code_day_frame(spark, {"a": {21: hit, 60: hit}})
    out = rows(labels.horizon_labels(df, codes.SEQUENCE_ANCHORS, codes.LABEL_HORIZONS, 60, codes.TARGET_CODES), "anchor_day", "horizon_days")
    by = {(r["anchor_day"], r["horizon_days"]): r for r in out}
    assert by[(20, 40)]["label"] == 1
    assert [by[(53, h)]["available"] for h in codes.LABEL_HORIZONS] == [1, 0, 0, 0, 0]
    assert by[(53, 7)]["label"] == 1 and by[(53, 40)]["label"] == 0


def test_compressed_rows_equal_daily_likelihood(spark):
    out = spark.createDataFrame([("a", 20, 40, 1), ("a", 30, 30, 12), ("b", 20, 40, None)],
                                "gpsno string, anchor_day int, horizon_days int, first_event_day int")
    q = {("a", 20): 0.03, ("a", 30): 0.05, ("b", 20): 0.01}
    got = rows(labels.compress_outcomes(out))
    assert len(got) == 4
    loss = -sum(r["weight"] * math.log(q[(r["gpsno"], r["anchor_day"])] if r["y"] else 1 - q[(r["gpsno"], r["anchor_day"])]) for r in got)
    want = (-math.log(.03) - 11 * math.log(.95) - math.log(.05)) / 2 - 40 * math.log(.99)
    assert loss == pytest.approx(want)
    hazard = F.create_map(*[x for k, v in q.items() for x in (F.lit(f"{k[0]}{k[1]}"), F.lit(v))])[F.concat("gpsno", "anchor_day")]
    total = rows(labels.survival_loss(out.withColumn("daily_hazard", hazard)))[0]
    assert total["survival_loss"] * 2 == pytest.approx(want)
