import datetime as dt
import gzip

import pytest
from conftest import rows
from pyspark.sql import functions as F

from telerisk import codes
from telerisk.operators import quality
from telerisk.plans.preprocess import PUBLISHED, build
from telerisk.sources import canon, files


@pytest.fixture(scope="module")
def sources(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    ev = [("101", 30002, "2026-06-20 10:00:00"), ("101", 30002, "2026-06-20 10:00:00"), ("101", 11804, "2026-06-21 09:00:00"),
          ("101", 11803, "2026-07-31 00:00:00"), ("102", 30003, "2026-06-19 12:00:00"), ("104", 30002, "2026-07-31 05:00:00"),
          ("105", 11804, "2026-06-22 08:00:00"), ("106", 30002, "2026-06-19 12:00:00")]
    (root / "events.tsv").write_text("".join(f"{g}\t30\t114\t{c}\tname\t{'999' if c == 11804 else '60'}\t{t}\n" for g, c, t in ev))
    for part in (0, 1):
        lines = [f"101\t100\t1\t2026-06-20 10:00:0{2 * i + part}\t4\t90\t30\t114\n" for i in range(2)]
        lines += [f"102\t100\t1\t2026-06-20 10:00:0{2 * i + part}\t4\t90\t30\t114\n" for i in range(2)]
        (root / f"traj-{part}.tsv").write_text("".join(lines))
        imu = [f"{g}\tdevice-{g}\t2026-06-20 10:00:0{2 * i + part}\t20260620\t\\N\t4\t0.1\t0.0\t0.99\t1\t2\t3\n" for g in (101, 102) for i in range(2)]
        with gzip.open(root / f"imu-{part}.gz", "wt") as f:
            f.write("".join(imu))
    return root


@pytest.fixture(scope="module")
def built(spark, sources):
    profile = spark.createDataFrame([(str(i), "fuel") for i in range(101, 107)], "gpsno string, energy_type string")
    tsv = lambda pattern, columns: files.scan_tsv(spark, f"{sources}/{pattern}", columns)
    ev = canon.canonical_events(tsv("events.tsv", codes.EVENT_COLUMNS))
    return ev, build(profile, ev, canon.canonical_trajectory(tsv("traj-*", codes.TRAJECTORY_COLUMNS)),
                     canon.canonical_imu(tsv("imu-*", codes.IMU_COLUMNS)))


def test_label_boundaries(built):
    _, out = built
    got = {(r["gpsno"], str(r["anchor_date"])): r for r in rows(out.bags)}
    at = lambda g, d: got[(g, d)]["label"]
    assert [at(str(g), "2026-06-20") for g in range(101, 107)] == [1, 0, None, None, 1, 0]
    assert [at(str(g), "2026-07-30") for g in range(101, 107)] == [None] * 6
    assert got[("103", "2026-06-20")]["label_status"] == got[("104", "2026-06-20")]["label_status"] == "unlabeled_no_event_feed"
    assert str(got[("101", "2026-06-20")]["future_end"]) == "2026-07-30" and len(got) == 48


def test_calendar_presence_and_counts(built):
    ev, out = built
    assert out.daily.count() == 360 and out.targets.count() == 2
    late = rows(quality.event_counters(ev, "2026-07-30"))[0]
    assert late["after_rule_end_rows"] == 2 and late["bad_speed_rows"] == 2
    day = {(r["gpsno"], str(r["day"])): r for r in rows(out.daily.where("gpsno in ('101', '103', '105')"))}
    assert (day[("105", "2026-06-20")]["has_event_feed"], day[("105", "2026-06-20")]["event_total_count"]) == (False, None)
    assert (day[("105", "2026-06-22")]["has_event_feed"], day[("105", "2026-06-22")]["event_total_count"]) == (True, 1)
    assert day[("101", "2026-06-20")]["event_30002_count"] == 1  # the exact copy is gone
    assert day[("101", "2026-06-20")]["distance_km"] == pytest.approx(0.003)  # the first fix has no gap
    assert day[("103", "2026-06-20")]["event_total_count"] is None
    quality.require(quality.calendar_gaps(out.daily, PUBLISHED.first_day, PUBLISHED.last_day)
                    .agg(F.count(F.lit(1)).alias("violations")).select(F.lit("calendar").alias("rule"), "violations"))
    assert len(out.daily.columns) == 89 and len(files.numeric_features(out.daily)) == 85


def test_cross_file_entities_and_windows(spark, sources, built):
    raw = canon.canonical_trajectory(files.scan_tsv(spark, f"{sources}/traj-*", codes.TRAJECTORY_COLUMNS))
    assert rows(quality.spread_over_files(raw))[0]["cross_part_vehicles"] == 2
    imu = canon.canonical_imu(files.scan_tsv(spark, f"{sources}/imu-*", codes.IMU_COLUMNS))
    assert imu.where("ems_speed is null").count() == 8
    assert {(r["gpsno"], r["imu_valid_windows"]) for r in rows(built[1].imu_daily)} == {("101", 1), ("102", 1)}


def test_profile_contract(spark):
    make = lambda ids: spark.createDataFrame([(i, "a ", *[1.0] * 8) for i in ids], ", ".join(
        f"`{h}` {'string' if k < 2 else 'double'}" for k, h in enumerate(codes.PROFILE_HEADER)))
    assert [r["gpsno"] for r in rows(files.load_profile(make(["101.0", " x7 "])), "gpsno")] == ["101", "x7"]
    for bad in (["1", "1.0"], [" "], [None]):
        with pytest.raises(quality.ContractError):
            files.load_profile(make(bad))
    with pytest.raises(quality.ContractError):
        files.load_profile(make(["1"]).withColumnRenamed(codes.PROFILE_HEADER[0], "id"))


def test_discover_and_list(spark, sources):
    kinds = {"events": "events*", "imu": "imu-*", "trajectory": "traj-*"}
    assert len(rows(files.discover(spark, str(sources), kinds, single=["events"]))) == 5
    with pytest.raises(quality.ContractError):
        files.discover(spark, str(sources), {**kinds, "profile": "profile*"})
    with pytest.raises(quality.ContractError):
        files.discover(spark, str(sources), kinds, single=["imu"])
    got = {r["name"]: r["bytes"] for r in rows(files.list_files(spark, str(sources)))}
    assert got["events.tsv"] == (sources / "events.tsv").stat().st_size


def test_delivery_is_create_only(spark, tmp_path):
    df = spark.createDataFrame([("2", 1, 0.7), ("1", 0, 0.1)], "gpsno string, prediction int, probability double")
    files.write_delivery(df, str(tmp_path / "d"))
    with pytest.raises(Exception):
        files.write_delivery(df, str(tmp_path / "d"))
    with pytest.raises(quality.ContractError):
        files.write_delivery(df.drop("prediction"), str(tmp_path / "e"))


def test_best_fix_prefers_complete_rows(spark):
    from telerisk.operators.trajectory import best_fix
    t = dt.datetime(2026, 6, 1)
    df = spark.createDataFrame([("a", t, 1, 1, None, 0.0, 30.0, 114.0, "f1"), ("a", t, 2, 2, 9.0, 0.0, 30.0, 114.0, "f2"),
                                ("a", t, 3, 3, 9.0, 0.0, 30.0, 114.0, "f3")],
                               "gpsno string, ts timestamp_ntz, distance_cm bigint, run_time_s bigint, speed double, course double, "
                               "lat double, lng double, source_file string")
    assert [r["distance_cm"] for r in rows(best_fix(df))] == [2]
