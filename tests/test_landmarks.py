import math

import pytest
from conftest import code_day_frame, rows
from pyspark.sql import functions as F

from telerisk import codes
from telerisk.operators import landmarks as K


def by_key(df):
    return {(r["gpsno"], r["anchor_day"]): r for r in rows(df)}


def test_summary_and_recency(spark):
    df = code_day_frame(spark, {"a": {20: {"event_11804_count": 1}, 21: {"event_11803_count": 1}}})
    r = by_key(K.landmark_summary(df, (14, 20, 30)))
    assert r[("a", 20)]["event_11804_count_per_day"] == pytest.approx(1 / 20)
    assert r[("a", 20)]["event_11803_count_per_day"] == 0 and r[("a", 20)]["event_11803_recency_days"] is None
    assert r[("a", 20)]["event_11804_recency_days"] == 0 and r[("a", 30)]["event_11804_recency_days"] == 10
    assert r[("a", 14)]["exposure_km_per_day"] == 1 and len(K.landmark_columns(K.landmark_summary(df, (14,)))[0]) == 55


def test_code_metrics(spark):
    df = code_day_frame(spark, {"a": {20: {"event_11405_episodes": 1, "event_11405_count": 12}, 21: {"event_41001_episodes": 100}}}, km=10.0)
    long = {(r["anchor_day"], r["event_code"]): r for r in rows(K.code_landmarks(df, (20,)))}
    assert long[(20, 11405)]["episodes_per_day"] == pytest.approx(0.05) and long[(20, 11405)]["counts_per_day"] == pytest.approx(0.6)
    assert long[(20, 11405)]["recency_proximity"] == 1 and long[(20, 41001)]["episodes_per_day"] == 0
    assert long[(20, 11405)]["episodes_per_100km"] == pytest.approx(100 / 300)
    assert len(long) == 24
    wide = K.code_landmarks_wide(K.code_landmarks(df, (20,)))
    assert len(wide.columns) == 2 + 24 * 9


def test_chain_direction_and_truncation(spark):
    df = code_day_frame(spark, {"a": {3: {"event_41001_episodes": 1}, 5: {"event_30002_episodes": 1},
                                      13: {"event_41001_episodes": 1}, 15: {"event_30002_episodes": 1}}})
    got = {(r["anchor_day"], r["chain"]): r for r in rows(K.chain_landmarks(df, (14, 20)))}
    assert got[(14, "fatigue_to_control")]["within3_given_source"] == 0.5  # day 15 is beyond the anchor
    assert got[(20, "fatigue_to_control")]["within3_given_source"] == 1
    assert got[(14, "control_to_severe")]["within7_given_source"] == 0
    assert len(got) == 10


@pytest.mark.parametrize("build", [
    lambda d: K.landmark_summary(d, (14, 20)), lambda d: K.code_landmarks(d, (14, 20)), lambda d: K.role_landmarks(d, (14, 20)),
    lambda d: K.chain_landmarks(d, (14, 20)), lambda d: K.window_features(d, (20,)), lambda d: K.exposure_totals(d, (14, 20))])
def test_future_days_cannot_change_features(spark, build):
    days = {i: {"event_41001_episodes": i % 3, "event_30002_count": i % 2, "event_11804_count": int(i == 9)} for i in range(1, 61)}
    df = code_day_frame(spark, {"a": days, "b": {7: {"event_11803_count": 2}}})
    late = F.col("day_index") > 20
    changed = df.select(*[F.when(late, F.lit(10 ** 6).cast(t)).otherwise(F.col(c)).alias(c)
                          if c.startswith(("event_", "distance", "drive", "imu_")) and t in ("bigint", "double") else F.col(c) for c, t in df.dtypes])
    key = lambda r: tuple(map(str, r))
    assert sorted(build(df).collect(), key=key) == sorted(build(changed).collect(), key=key)


def test_no_feed_is_unknown_but_feed_without_events_is_zero(spark):
    off = {i: {"has_event_feed": False, "event_11804_count": None, "event_total_count": None} for i in range(1, 61)}
    df = code_day_frame(spark, {"off": off, "on": {}})
    got = by_key(K.window_features(df, (20,)))
    assert got[("off", 20)]["event_11804_count_7"] is None and got[("off", 20)]["near_miss_days_7"] is None
    assert got[("on", 20)]["event_11804_count_7"] == 0 and got[("on", 20)]["near_miss_days_7"] == 0


def test_longest_streak(spark):
    df = code_day_frame(spark, {"a": {i: {"event_30000_count": 1} for i in (2, 3, 4, 8, 9)}}, last_day=10)
    got = rows(K.longest_streak(df, F.col("event_30000_count") > 0), "day_index")
    assert [r["streak"] for r in got] == [0, 1, 2, 3, 3, 3, 3, 3, 3, 3]


def test_role_recency_and_feature_sets(spark):
    df = code_day_frame(spark, {"a": {12: {"event_30000_episodes": 1, "event_30000_count": 1}}})
    wide, sets = K.causal_landmarks(df, (14,))
    r = rows(wide)[0]
    assert r["role_proximal_recency_proximity"] == pytest.approx(1 / 3) and r["role_proximal_active_type_fraction"] == 0.5
    assert [len(v) for v in sets.values()] == [55, 55 + 60, 55 + 60 + 10, 55 + 60 + 20]
    assert math.isclose(r["role_proximal_count_per_day"], 1 / 14)
    assert set(sets["directed_chains"]) <= set(wide.columns) and codes.CHAINS
