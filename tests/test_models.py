"""Fitted models: scoring from their parameters, occlusion without a new fit, and how near a fit is to its optimum."""
import math
import random

import pytest
from conftest import code_day_frame, rows
from pyspark.sql import functions as F

from telerisk import codes
from telerisk.operators import landmarks as K
from telerisk.operators import masks, model
from telerisk.operators.scaling import long_features

ANCHORS = (20, 30)


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(3)
    entries = {}
    for e in range(24):
        days = {}
        for day in range(1, 31):
            cell = {"distance_km": rng.random() * 90 * (e % 5 > 0), "drive_hours": rng.random() * 9}
            for c in rng.sample(codes.EVENT_CODES, 3) if rng.random() < 0.5 else []:
                cell[f"event_{c}_episodes"] = rng.randrange(1, 4)
                cell[f"event_{c}_count"] = cell[f"event_{c}_episodes"] + rng.randrange(3)
            cell["event_total_count"] = sum(v for k, v in cell.items() if k.endswith("_count"))
            cell["event_total_episodes"] = sum(v for k, v in cell.items() if k.endswith("_episodes"))
            days[day] = cell
        entries[f"v{e}"] = days
    daily = code_day_frame(spark, entries, last_day=30).cache()
    land = K.landmark_summary(daily, ANCHORS).cache()
    features = [c for c in land.columns if c not in ("gpsno", "anchor_day")]
    compressed = land.select("gpsno", "anchor_day", F.explode(F.array(
        F.struct(F.lit(0).alias("y"), F.lit(9.0).alias("weight")),
        F.struct(F.lit(1).alias("y"), F.when(F.crc32("gpsno") % 3 == 0, 1.0).otherwise(0.25).alias("weight")))).alias("_r")).select("gpsno", "anchor_day", "_r.*")
    return daily, land, features, compressed, model.HazardModel.fit(land, compressed, features, c=0.1)


def test_parameters_score_as_the_model_does(spark, fitted):
    _, land, features, _, fit = fitted
    logits = model.model_logits(long_features(land, ["gpsno", "anchor_day"], features), fit.parameters(spark), fit.intercept)
    want = {(r.gpsno, r.anchor_day): r.daily_hazard for r in fit.daily_hazard(land).collect()}
    got = {(r.gpsno, r.anchor_day): 1 / (1 + math.exp(-r.logit)) for r in logits.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    assert fit.flagged  # some entities never drove


def test_fit_is_at_its_optimum_and_a_short_fit_is_not(fitted):
    _, land, features, compressed, fit = fitted
    assert fit.optimality(land, compressed).where("residual > allowed").count() == 0
    early = model.HazardModel.fit(land, compressed, features, c=0.1, max_iter=1)
    assert early.optimality(land, compressed).where("residual > allowed").count() > 0


def test_occlusion_equals_landmarks_of_days_without_the_code(spark, fitted):
    daily, land, features, _, fit = fitted
    terms = {(r.gpsno, r.anchor_day, r.event_code): r.term
             for r in model.code_terms(K.without_code(daily, land, ANCHORS), fit.parameters(spark)).collect()}
    full = {(r.gpsno, r.anchor_day): r.logit for r in model.model_logits(long_features(land, ["gpsno", "anchor_day"], features), fit.parameters(spark), fit.intercept).collect()}
    for code in (11803, 11401, codes.EVENT_CODES[-1]):
        n, e = F.col(f"event_{code}_count"), F.col(f"event_{code}_episodes")
        zeroed = (daily.withColumn("event_total_count", F.col("event_total_count") - n).withColumn("event_total_episodes", F.col("event_total_episodes") - e)
                  .withColumn(f"event_{code}_count", F.lit(0).cast("long")).withColumn(f"event_{code}_episodes", F.lit(0).cast("long")))
        again = model.model_logits(long_features(K.landmark_summary(zeroed, ANCHORS), ["gpsno", "anchor_day"], features), fit.parameters(spark), fit.intercept)
        for r in again.collect():
            assert full[r.gpsno, r.anchor_day] - r.logit == pytest.approx(terms.get((r.gpsno, r.anchor_day, code), 0.0), abs=1e-9)
    assert len(terms) > 100


def test_state_mask_hides_events_and_context_on_the_same_days(spark):
    entities = spark.createDataFrame([(f"v{i}",) for i in range(30)], "gpsno string")
    blocks = masks.state_blocks(entities, 5, 30)
    hits = masks.state_hits(blocks).cache()
    days = {}
    for r in rows(blocks):
        for state, part in ((codes.STATES, "event_code"), (codes.STATE_CONTEXT, "channel")):
            for name in state.get(r["state"], ()):
                days.setdefault((r["gpsno"], part, name), set()).update(range(r["start_day"], r["start_day"] + r["length"]))
    got = {}
    for r in rows(hits):
        key = (r["gpsno"], "event_code", r["event_code"]) if r["event_code"] is not None else (r["gpsno"], "channel", r["channel"])
        got.setdefault(key, set()).add(r["day_index"])
    assert got == days and {k[1] for k in got} == {"event_code", "channel"}
    long = entities.select("gpsno", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("day_index"), F.lit("distance_km").alias("channel"), F.lit(2.0).alias("value"))
    hidden = {(r["gpsno"], r["day_index"]) for r in rows(masks.hide_context(long, hits)) if r["masked"] and r["value"] == 0.0}
    assert hidden == {(g, d) for (g, part, name), s in days.items() if name == "distance_km" for d in s}


def test_boosted_pair_stops_by_validation(spark):
    rng = random.Random(1)
    data = [(f"v{i}", float(x := rng.random()), float(rng.random()), int(x + rng.random() * 0.4 > 0.7)) for i in range(300)]
    df = spark.createDataFrame(data, "gpsno string, event_a double, b double, label int").withColumn("held", model.validation_share())
    share = df.agg(F.avg(F.col("held").cast("int"))).first()[0]
    a, b = model.boosted_pair(df, ["event_a", "b"], ["b"], iterations=30, step=0.1, validation="held")
    assert 0.1 < share < 0.3 and a.stages[-1].getNumTrees <= 30 and b.stages[-1].getNumTrees < 30


def test_a_fit_takes_few_passes(spark, fitted, monkeypatch):
    """Time: a pass over the rows for each Newton step, not one for each of thousands of gradient steps."""
    _, land, features, compressed, _ = fitted
    passes, once = [], model._curvature
    monkeypatch.setattr(model, "_curvature", lambda *args: passes.append(1) or once(*args))
    fit = model.HazardModel.fit(land, compressed, features, c=0.1)
    assert 2 < len(passes) < 40 and fit.optimality(land, compressed).where("residual > allowed").count() == 0


def test_a_single_outcome_gives_the_edge_of_the_range(fitted):
    _, land, features, compressed, _ = fitted
    fit = model.HazardModel.fit(land, compressed.where("y = 0"), features[:3], c=0.1)
    assert {r.daily_hazard for r in fit.daily_hazard(land).collect()} == {1e-12}


def test_penalised_minimum_meets_its_conditions():
    import numpy as np
    rng = np.random.default_rng(2)
    for l1 in (1e-6, 1e-2, 0.5):
        x = rng.normal(size=(60, 12)) @ rng.normal(size=(12, 12))
        h, c = x.T @ x / 60, rng.normal(size=12)
        u = model._penalised_minimum(h, c, l1, 0.1 * l1, np.zeros(12))
        slope = h @ u - c + 0.1 * l1 * np.r_[0, u[1:]]
        assert abs(slope[0]) < 1e-8 and all(abs(s + l1 * np.sign(b)) < 1e-8 if b else abs(s) <= l1 + 1e-8 for s, b in zip(slope[1:], u[1:]))
