"""Plans and helpers that must stay cheap as tables grow."""

import hashlib
import threading

from pyspark.sql import functions as F

from conftest import code_day_frame, rows
from telerisk.catalog.aggregates import wide
from telerisk.functions.columns import poisson_draw, poisson_steps
from telerisk.operators import daily as D
from telerisk.operators import labels as L
from telerisk.operators import metrics, model, ordered, quality, scaling, tensors
from telerisk.sources import files

FEATURES = ["x_count", "b", "a"]


def days(spark, entries):
    return spark.createDataFrame(entries, "gpsno string, day_index int, x_count double, b double, a double")


def by_cells(long, mark):
    """The wide table from long rows, one group for each entity-day."""
    marks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("feature", F.col(mark).cast("string").alias("m")))), lambda x: x["m"]), "")
    return long.groupBy("gpsno", "day_index").agg(*[F.max(F.when(F.col("feature") == f, F.col("scaled"))).alias(f) for f in FEATURES], marks.alias(mark))


def test_packed_scaling_equals_the_long_one(spark):
    """a day's cells are scaled in place; repeated and NULL keys come together as before."""
    once = [(str(k), d, float(k * d % 7), None if k % 3 == 0 else k - d / 2.0, float("nan") if d == 2 else 1.0 * d) for k in range(9) for d in (1, 2, 3)]
    for entries in (once, [*once, *once[:5], ("1", 1, 9.0, 3.0, None), (None, 1, 1.0, None, 2.0), (None, 1, 4.0, None, 2.0)]):
        table = days(spark, entries)
        for fit, apply, mark in ((scaling.fit_iqr_scaler, scaling.apply_iqr_scaler, "observed"), (scaling.fit_std_scaler, scaling.apply_std_scaler, "missing")):
            params = fit(table, FEATURES)
            packed = apply(scaling.long_features(table, ["gpsno", "day_index"], FEATURES, packed=True), params, features=FEATURES)
            assert "Generate" not in packed._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
            order = ["gpsno", "day_index"]
            long = apply(scaling.long_features(table, order, FEATURES), params)
            assert rows(wide(packed, FEATURES, mark), *order) == rows(by_cells(long, mark), *order)


def test_scaler_cells_are_written_once(spark, monkeypatch):
    """the cells are read by several branches; the entity-days behind them are computed once."""
    written = []
    monkeypatch.setattr(scaling, "materialise", lambda df, purpose: written.append(purpose) or df, raising=False)
    table = days(spark, [("1", 1, 1.0, 2.0, 3.0), ("2", 1, 4.0, None, 3.0)])
    iqr, std = scaling.fit_iqr_scaler(table, FEATURES), scaling.fit_std_scaler(table, FEATURES)
    assert written == ["scaler-cells"] * 2
    assert {r["feature"]: r["observed"] for r in rows(iqr)} == {r["feature"]: r["observed"] for r in rows(std)} == {"x_count": 2, "b": 1, "a": 2}


def test_draws_of_cells_run_in_many_tasks(spark):
    """the draws of the cells are not left to one task."""
    pair = spark.range(400).select(F.col("id").cast("string").alias("gpsno"), (F.col("id") % 2).alias("label"),
                                   (F.col("id") % 37 / 40).alias("probability_new"), (F.col("id") % 11 / 40).alias("probability_prior"))
    drawn = metrics.bootstrap_cells(pair, 7, 20, ["label", "probability_new", "probability_prior"])
    assert drawn.select(F.spark_partition_id()).distinct().count() > 1


def test_draws_count_the_steps_at_or_below_the_digits(spark):
    for mean in (1, 2, 32, 1024):
        first, steps = poisson_steps(mean)
        digits = ["00000000", "80000000", "ffffffff", *steps[::7]]
        found = rows(spark.createDataFrame([(h,) for h in digits], "h string").select("h", poisson_draw(mean, F.col("h")).alias("n")))
        assert {r["h"]: r["n"] for r in found} == {h: first + sum(s <= h for s in steps) for h in digits}


def test_entity_tables_are_not_broadcast(spark):
    """coverage, entity-days, bags and their tensors grow with the entities."""
    profile = spark.createDataFrame([("1", "x"), ("2", "y")], "gpsno string, energy_type string")
    events = spark.createDataFrame([("1", "2026-06-03 10:00:00")], "gpsno string, t string").select("gpsno", F.col("t").cast("timestamp_ntz").alias("event_ts"), F.lit(11804).alias("event_type"))
    motion = spark.createDataFrame([("1", "2026-06-02", 3)], "gpsno string, d string, n int").select("gpsno", F.to_date("d").alias("day"), F.col("n").alias("trajectory_rows"))
    sensor = motion.withColumnRenamed("trajectory_rows", "imu_valid_samples")
    cover = D.coverage(profile, events, motion, sensor)
    bags = L.label_index(cover, events, ("2026-06-04",), "2026-06-09", "2026-06-01", 2, 3)
    daily = D.calendar(profile, "2026-06-01", "2026-06-05").withColumn("v", F.lit(1.0))
    packed = tensors.bag_days(bags, daily, ["v"], "2026-06-01", 3)
    assert "BroadcastExchange" not in packed._jdf.queryExecution().executedPlan().toString()
    assert [r["x"] for r in rows(packed, "gpsno")] == [[[1.0]] * 3] * 2


def test_folds_are_fitted_side_by_side(spark):
    """a fold does not wait for the ones before it."""
    table = spark.createDataFrame([(str(i), i % 3) for i in range(9)], "gpsno string, fold int")
    together = threading.Barrier(3, timeout=60)

    def fit_predict(train, held):
        together.wait()
        return held.select("gpsno", F.lit(train.count()).alias("n"))

    assert rows(model.out_of_fold(table, 3, fit_predict), "gpsno") == [{"gpsno": str(i), "n": 6, "fold": i % 3} for i in range(9)]


def test_top_fraction_ranks_values_and_not_rows(spark, monkeypatch):
    """what is dealt to ranges are distinct values and the rows tied at the edge, not all rows."""
    dealt = []
    for name in ("merged_counts", "numbered"):
        plain = getattr(ordered, name)
        monkeypatch.setattr(ordered, name, lambda df, *a, plain=plain, **k: dealt.append(df.count()) or plain(df, *a, **k))
    entries = [(i, None if i % 29 == 0 else float("nan") if i % 31 == 0 else float(i % 7 - 3), "x" * 50) for i in range(700)]
    for largest in (True, False):
        dealt.clear()
        got = rows(ordered.top_fraction(spark.createDataFrame(entries, "id long, v double, more string"), "v", 0.2, "id", largest), "id")
        known = [(i, v) for i, v, _ in entries if v is not None]
        place = lambda v: (v != v, v if v == v else 0.0) if not largest else (v != v, -v if v == v else 0.0)
        order = sorted(known, key=lambda x: (place(x[1]), hashlib.md5(str(x[0]).encode()).hexdigest()))
        assert [r["id"] for r in got] == sorted(i for i, _ in order[:len(known) // 5])
        assert len(dealt) == 2 and dealt[0] == 8 and dealt[1] < 120


def test_node_sequences_are_packed_before_the_shuffle(spark):
    """a row for each entity-day is shuffled, once, and repeated days come together as before."""
    fleet = code_day_frame(spark, {"1": {2: {"event_11804_count": 3, "event_11804_episodes": 2}}, "2": {1: {"distance_km": None}}}, last_day=3)
    table = D.day_table(fleet.unionByName(fleet.where("gpsno = '2' AND day_index < 3")), "2026-06-01")
    packed = tensors.node_sequences(D.event_node_features(table, packed=True))
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert rows(packed, "gpsno") == rows(tensors.node_sequences(D.event_node_features(table)), "gpsno")


def test_keys_of_a_contract_are_dealt_before_they_are_grouped(spark, monkeypatch):
    """entity-days exploded in one scan task were grouped there, so its memory grew with the entities."""
    monkeypatch.setattr(quality, "KEYS_OF_TASK", 40)
    grid = D.calendar(spark.createDataFrame([(str(i),) for i in range(20)], "gpsno string").coalesce(1), "2024-01-01", "2024-01-10")
    dealt = quality.dealt_by_key(grid, ["gpsno", "day"])
    assert dealt.rdd.getNumPartitions() == 5 and dealt.count() == 200
    plan = quality.duplicate_keys(dealt, ["gpsno", "day"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "HashAggregate" not in plan[plan.index("Exchange"):]
    asked = []
    monkeypatch.setattr(files, "has_duplicates", lambda df, keys: asked.append(keys) or quality.has_duplicates(df, keys))
    files.load_profile(spark.createDataFrame([("1", "x")], "id string, kind string"), ("id", "kind"))
    assert asked == [["gpsno"]]


def test_repeated_keys_are_found(spark, monkeypatch):
    monkeypatch.setattr(quality, "KEYS_OF_TASK", 2)
    once = [("a", 1), ("a", 2), ("b", 1), (None, 1), ("b", None), (None, None)]
    for entries, found in (([], False), (once, False), *(([*once, again], True) for again in (("a", 2), (None, 1), (None, None)))):
        assert quality.has_duplicates(spark.createDataFrame(entries, "gpsno string, day int"), ["gpsno", "day"]) is found
