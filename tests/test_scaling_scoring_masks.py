import random

import numpy as np
import pytest
from conftest import code_day_frame, rows
from pyspark.sql import functions as F

from telerisk import codes
from telerisk.operators import daily as D
from telerisk.operators import masks, model, scaling, scoring


@pytest.fixture(scope="module")
def train(spark):
    rng = random.Random(2)
    data = [(str(i), rng.lognormvariate(1, 1), None if i % 5 == 0 else float(rng.randrange(9)), i % 2 == 0) for i in range(400)]
    return spark.createDataFrame(data, "gpsno string, km double, x_count double, flag boolean")


def test_iqr_scaler_matches_numpy(train):
    got = {r["feature"]: r for r in rows(scaling.fit_iqr_scaler(train, ["km", "x_count", "flag"], ["flag"]))}
    data = train.collect()
    for name, move in (("km", lambda v: v), ("x_count", np.log1p)):
        v = move(np.array([r[name] for r in data if r[name] is not None]))
        lo, hi = np.quantile(v, [0.01, 0.99])
        c = np.clip(v, lo, hi)
        q25, q75 = np.quantile(c, [0.25, 0.75])
        assert [got[name][k] for k in ("low", "high", "median", "scale")] == pytest.approx([lo, hi, np.median(c), q75 - q25])
    assert got["x_count"]["log1p"] and not got["km"]["log1p"] and got["flag"]["scale"] == 1


def test_std_scaler_matches_numpy_and_round_trips(train, spark, tmp_path):
    scaler = scaling.RobustScaler.fit(train, ["km", "x_count"])
    got = {r["feature"]: r for r in rows(scaler.params)}
    for name in ("km", "x_count"):
        raw = np.array([np.nan if r[name] is None else r[name] for r in train.collect()])
        v = np.sign(raw) * np.log1p(np.abs(raw))
        lo, hi = np.nanpercentile(v, [1, 99])
        c = np.clip(v, lo, hi)
        med = np.nanmedian(c)
        sd = np.where(np.isfinite(c), c, med).std()
        assert [got[name][k] for k in ("low", "high", "median", "scale")] == pytest.approx([lo, hi, med, sd])
    scaler.save(str(tmp_path / "s"))
    back = scaling.RobustScaler.from_description(spark.read.parquet(str(tmp_path / "s")), ["km", "x_count"])
    assert rows(back.params, "feature") == rows(scaler.params, "feature")
    with pytest.raises(ValueError):
        scaling.RobustScaler.from_description(spark.read.parquet(str(tmp_path / "s")), ["km"])


def test_other_entities_cannot_change_a_fitted_scaler(spark):
    df = code_day_frame(spark, {"car_a": {5: {"event_30000_count": 1}}, "car_b": {}})
    wild = df.withColumn("distance_km", F.when(F.col("gpsno") == "car_b", 1e9).otherwise(F.col("distance_km")))
    fit = lambda d: rows(scaling.fit_std_scaler(d.where("gpsno = 'car_a' and day_index <= 53"), ["distance_km", "speed_p90"]), "feature")
    assert fit(df) == fit(wild)


def test_missing_counts_scale_to_zero(spark, train):
    params = scaling.fit_iqr_scaler(train, ["x_count"])
    long = scaling.long_features(train.where("x_count is null"), ["gpsno"], ["x_count"])
    assert {(r["scaled"], r["observed"]) for r in rows(scaling.apply_iqr_scaler(long, params))} == {(0.0, 0)}


def test_shrunk_weights(spark):
    imp = spark.createDataFrame([(11803, 3.0), (11804, 1.0)], "event_code int, mean_abs_probability_delta double")
    w = {(r["state"], r["event_code"]): r["weight"] for r in rows(scoring.shrink_weights(imp, codes.STATES))}
    assert w[("history", 11803)] == pytest.approx(0.25 + 0.5 * 0.75)
    assert w[("quality", 41006)] == pytest.approx(0.5) and len(w) == 24


def test_deductions_and_grades(spark):
    df = spark.createDataFrame([(v, *[v] * 6) for v in (0.0, 0.5, 1.0)], "id double, " + ", ".join(f"{n} double" for n in codes.SCORE_A_POINTS))
    cut = scoring.deductions(list(codes.SCORE_A_POINTS), codes.SCORE_A_POINTS, 2)
    got = [r["s"] for r in rows(df.select("id", (100 - sum(cut.values())).alias("s")), "id")]
    assert got == pytest.approx([100, 75, 0])
    cases = spark.createDataFrame([(90.0, "高"), (40.0, "高"), (90.0, "低")], "score double, level string")
    a = scoring.grade_columns(F.col("score"), F.col("level"), codes.SCORE_A_GRADES, codes.SCORE_A_UNRATED)
    assert [r[0] for r in cases.select(a[0]).collect()] == ["A", "E", "U"]
    with pytest.raises(ValueError):
        scoring.deductions(["model"], codes.SCORE_A_POINTS, 2)


@pytest.fixture(scope="module")
def fleet(spark):
    rng = random.Random(9)
    days = lambda k: {i: {f"event_{c}_count": 1 for c in rng.sample(codes.EVENT_CODES, k)} for i in range(1, 61)}
    return code_day_frame(spark, {"calm": {}, "mild": days(1), "wild": days(6), "off": {i: {
        "trajectory_recorded_today": False, "imu_recorded_today": False, "imu_accel_peak_p99": None, "imu_accel_variability_p90": None,
        "imu_gyro_peak": None} for i in range(1, 61)}})


def entities(spark):
    return spark.createDataFrame([("calm", True, True), ("mild", True, True), ("wild", True, True), ("off", False, False)],
                                 "gpsno string, has_event_feed boolean, is_development boolean")


def test_scorecard_a_neutral_evidence(spark, fleet):
    p = entities(spark).select("gpsno", F.explode(F.array(F.lit(20), F.lit(60))).alias("anchor_day"), F.lit(0.2).alias("probability"))
    imp = spark.createDataFrame([(11803, 1.0)], "event_code int, mean_abs_probability_delta double")
    cards = scoring.scorecard_a(fleet, entities(spark), p, scoring.shrink_weights(imp, codes.STATES), (20, 60), 60, 0.3, "2026-06-01")
    got = {(r["gpsno"], r["anchor_day"]): r for r in rows(cards)}
    off = got[("off", 60)]
    assert off["route"] == codes.ROUTE_PRIOR and off["probability"] == 0.3 and off["grade"] == "U"
    assert all(off[f"risk_{n}"] == 0.5 for n in codes.SCORE_A_POINTS)
    assert got[("calm", 60)]["safety_score"] > got[("mild", 60)]["safety_score"] > got[("wild", 60)]["safety_score"]
    assert got[("calm", 60)]["top_risk_events"] == codes.NO_EVENTS_A and str(got[("calm", 20)]["as_of_date"]) == "2026-06-20"
    assert rows(scoring.with_ranks(cards).where("gpsno = 'wild' and anchor_day = 60"))[0]["risk_rank"] == 1


def test_scorecard_b_reconciles(spark, fleet):
    imp = spark.createDataFrame([(11803, 1.0)], "event_code int, mean_abs_probability_delta double")
    got = {r["gpsno"]: r for r in rows(scoring.scorecard_b(fleet, entities(spark), imp, (60,)))}
    for r in got.values():
        assert r["safety_score"] == pytest.approx(100 - sum(r[f"deduction_{d}"] for d in codes.SCORE_B_POINTS))
    assert got["off"]["grade"] == "U" and got["calm"]["safety_score"] > got["wild"]["safety_score"]
    assert got["wild"]["top_risk_events"].count("；") == 2


def test_masks_move_whole_bundles(spark, fleet):
    ents = entities(spark).select("gpsno")
    spans = masks.event_spans(ents, 3, 60)
    per = rows(spans.groupBy("gpsno").agg(F.sum("length").alias("days"), F.min("start_day").alias("lo"), F.max(F.col("start_day") + F.col("length")).alias("hi")))
    assert all(9 <= r["days"] <= 13 and r["lo"] >= 1 and r["hi"] <= 61 for r in per) and len(per) == 4
    nodes = D.event_node_features(D.day_table(fleet, "2026-06-01"))
    masked = masks.mask_events(nodes, spans, masks.masked_codes(ents, 3)).where("masked = 1")
    worst = rows(masked.agg(*[F.max(c).alias(c) for c in masks.MASKED_FIELDS], F.max("km_observed").alias("km")))[0]
    assert all(worst[c] == 0 for c in masks.MASKED_FIELDS) and worst["km"] == 1
    blocks = rows(masks.state_blocks(ents, 3, 60))
    assert len(blocks) == 8 and {b["state"] for b in blocks} <= set(codes.STATES)
    real = scoring.code_table(spark, codes.STATES, "state")
    sizes = lambda t: {r["state"]: r["count"] for r in rows(t.groupBy("state").count())}
    assert sizes(masks.shuffled_states(real)) == sizes(real)


def test_segment_probabilities_are_monotone(spark):
    df = spark.createDataFrame([("a", i, 0.1 * i) for i in range(1, 6)], "k string, segment int, hazard double")
    p = [r["probability"] for r in rows(model.cumulative_segments(df, ["k"]), "segment")]
    assert p == sorted(p) and p[1] == pytest.approx(1 - 0.9 * 0.8)


def _sides_of_broadcasts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "gpsno" in line]


def test_tables_of_entities_are_never_broadcast(spark):
    """Exploded rows and maps seem small before they are counted; as broadcasts they would fill the driver."""
    people = spark.range(40).select(F.col("id").cast("string").alias("gpsno"))
    long = people.crossJoin(spark.range(1, 31).select(F.col("id").cast("int").alias("day_index"))).select(
        "*", F.lit("distance_km").alias("channel"), F.lit(1.0).alias("value"))
    hidden = masks.mask_context(long, masks.context_spans(people, 7, ["distance_km", "drive_hours"], 30, fraction=0.5))
    assert _sides_of_broadcasts(hidden) == [] and 0 < hidden.where("masked = 1").count() < hidden.count() == 1200
    signals = spark.range(1).select(F.explode(F.array(*[F.lit(str(i)) for i in range(40)])).alias("gpsno")).select(
        "gpsno", F.lit(30).alias("anchor_day"), F.lit(0.5).alias("control_imu"), F.lit(1.0).alias("trajectory_coverage"), F.lit(1.0).alias("imu_coverage"))
    burden = signals.select("gpsno", "anchor_day", F.lit(11804).alias("event_code"), F.lit(1.0).alias("burden"))
    weights = scoring.shrink_weights(spark.createDataFrame([(11804, 1.0)], "event_code int, mean_abs_probability_delta double"), codes.STATES)
    states = scoring.state_signals(burden, weights, signals)
    assert _sides_of_broadcasts(states) == [] and states.count() == 40
