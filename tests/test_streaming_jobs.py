"""Jobs that continue: several runs in one folder, a source that ends, runs that are repeated, empty sources."""
import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from telerisk.sources.ingest import Ingest
from telerisk.streaming import jobs as J
from telerisk.streaming import streams
from telerisk.streaming.state import BucketTable, Log

DAY = dt.datetime(2024, 1, 1)
EVENTS = "gpsno string, event_type string, ts timestamp_ntz"


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


def stream_of(spark, folder, schema, batches):
    """Each batch is written as a file of its own folder; all are read one file at a time, oldest first."""
    for i, rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/b{i}")
    return streams.file_stream(spark, f"{folder}/in/*", StructType.fromDDL(schema), files_per_trigger=1)


def plain_sessions(rows, gap):
    out = []
    for key in {r[:2] for r in rows}:
        times = sorted(r[2].replace(microsecond=0) for r in rows if r[:2] == key)
        start = last = times[0]
        n = 0
        for t in times:
            if (t - last).total_seconds() > gap:
                out.append((*key, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((*key, start, last, n))
    return sorted(out)


def test_sessions_are_delivered_once_over_runs_and_flush(spark, tmp_path):
    rng, folder = random.Random(1), f"file://{tmp_path}"
    rows, t = [], 0
    for _ in range(300):
        t += rng.choice([1, 5, 30, 60, 61, 200])
        rows.append(("hot" if rng.random() < 0.7 else rng.choice("ab"), rng.choice("xy"), at(t)))
    cut = [rows[:120], rows[120:121], rows[121:250], rows[250:]]
    for i, part in enumerate(cut):
        rng.shuffle(part)
        stream = stream_of(spark, folder, EVENTS, [(i, part)])
        job = J.session_job(stream, f"{folder}/job", gap_s=60, delay_s=300)
        job.run(stream)
        before = sorted(map(tuple, job.delivered().collect()))
        assert set(before) <= set(plain_sessions(rows, 60)) and len(set(before)) == len(before)
        assert len(before) < len(plain_sessions(rows, 60))
    job.run(stream)  # nothing new
    assert sorted(map(tuple, job.delivered().collect())) == before
    job.flush()
    job.flush()
    assert sorted(map(tuple, job.delivered().collect())) == plain_sessions(rows, 60)
    late = stream_of(spark, folder, EVENTS, [(9, [("a", "x", at(0))])])
    job.run(late)
    assert len(job.delivered().collect()) == len(plain_sessions(rows, 60))
    assert spark.read.parquet(f"{folder}/job/late").count() == 1


def test_late_rows_are_kept_aside(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for i, part in enumerate([[("a", "x", at(1000))], [("a", "x", at(10)), ("a", "x", at(990)), ("a", "x", at(2000)), (None, "x", at(2000)), ("a", "x", None)]]):
        stream = stream_of(spark, folder, EVENTS, [(i, part)])
        job = J.session_job(stream, f"{folder}/job", gap_s=60, delay_s=100)
        job.run(stream)
    job.flush()
    assert sorted(map(tuple, job.delivered().collect())) == [("a", "x", at(990), at(1000), 2), ("a", "x", at(2000), at(2000), 1)]
    assert [r.ts for r in spark.read.parquet(f"{folder}/job/late").collect()] == [at(10)]


def test_empty_source_and_repeated_batch(spark, tmp_path):
    folder = f"file://{tmp_path}"
    none = stream_of(spark, folder, EVENTS, [(0, [])])
    job = J.session_job(none, f"{folder}/job", gap_s=60)
    job.run(none)
    job.flush()
    assert job.delivered().count() == 0
    batch = spark.createDataFrame([("a", "x", at(5)), ("a", "x", at(7))], EVENTS)
    job._batch(batch, 3)
    job._batch(batch, 3)  # the same batch again, as after a failure
    job.flush()
    assert [r.events for r in job.delivered().collect()] == [2]


def test_windows_close_and_flush(spark, tmp_path):
    folder, schema = f"file://{tmp_path}", "gpsno string, ts timestamp_ntz, v double"
    summary = lambda rows: rows.groupBy("gpsno", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 10).alias("w")).agg(
        F.count("*").alias("n"), F.percentile("v", 0.5).alias("mid"))
    rows = [("a" if i % 3 else "b", at(i), float(i * 7 % 23)) for i in range(200)]
    for i, part in enumerate([rows[:95], rows[95:]]):
        stream = stream_of(spark, folder, schema, [(i, part)])
        job = J.window_job(stream, f"{folder}/job", summary, delay_s=20)
        job.run(stream)
    some = job.delivered().count()
    job.flush()
    want = summary(spark.createDataFrame(rows, schema))
    assert some < want.count() and sorted(map(tuple, job.delivered().collect())) == sorted(map(tuple, want.collect()))


def test_distinct_forgets_days_and_equals_batch_distinct(spark, tmp_path):
    folder, schema = f"file://{tmp_path}", "gpsno string, event_ts timestamp_ntz, code int"
    rng, rows = random.Random(2), []
    for day in range(12):
        part = [(rng.choice(["a", "b", None]), at(day * 86400 + rng.randrange(86400)), rng.choice([1, None])) for _ in range(20)]
        rows.append(part + rng.sample(part, 5) + ([] if day == 0 else rng.sample(rows[-1][:20], 5)))
    for i, part in enumerate(rows):
        stream = stream_of(spark, folder, schema, [(i, part)])
        job = J.DistinctJob(stream, f"{folder}/job", ["gpsno", "event_ts", "code"], delay_days=1)
        job.run(stream)
    got = Counter(map(tuple, job.delivered().collect()))
    assert got == Counter({r for part in rows for r in part})
    days = sorted(p.name for p in (tmp_path / "job" / "seen").iterdir() if p.name.startswith("day=2024"))
    assert days == ["day=2024-01-11", "day=2024-01-12"]
    job._batch(spark.createDataFrame(rows[-1], schema), 11)  # the last batch again
    assert Counter(map(tuple, job.delivered().collect())) == got
    late = stream_of(spark, folder, schema, [(99, [rows[0][0], ("z", at(11 * 86400), 1), ("z", None, 1)])])
    job.run(late)
    assert sum(1 for _ in job.delivered().collect()) == sum(got.values()) + 1 and spark.read.parquet(f"{folder}/job/late").count() == 2


SCORES = StructType().add("gpsno", "string").add("n", "long").add("last", "timestamp_ntz")


def refresh(spark, folder, stream, calls, buckets=8):
    def score(history, touched):
        calls.append(sorted(r.gpsno for r in touched.collect()))
        return history.groupBy("gpsno").agg(F.count("*").alias("n"), F.max("ts").alias("last"))

    return J.RefreshJob(stream, f"{folder}/job", "gpsno", SCORES, score, buckets)


def test_refresh_touches_only_its_buckets_and_goes_on(spark, tmp_path):
    folder, calls = f"file://{tmp_path}", []
    rows = [[(f"e{i}", "x", at(i)) for i in range(40)], [("e3", "x", at(1000)), ("new", "x", at(1001)), (None, "x", at(5))], []]
    for i, part in enumerate(rows):
        stream = stream_of(spark, folder, EVENTS, [(i, part)])
        job = refresh(spark, folder, stream, calls)
        job.run(stream)
        if i == 0:
            first = job.table.pointers()
    want = Counter(r[0] for part in rows for r in part if r[0])
    got = {r.gpsno: (r.n, r.last) for r in job.scores().collect()}
    assert {k: n for k, (n, _) in got.items()} == dict(want) and got["e3"][1] == at(1000)
    assert calls[1:] == [["e3", "new"]]
    moved = {b for b, w in job.table.pointers().items() if first.get(b) != w}
    assert 1 <= len(moved) <= 2 and len(first) > 4
    job._batch(spark.createDataFrame(rows[1], EVENTS), 1)  # an old batch again: same version, same rows
    assert {r.gpsno: r.n for r in job.scores().collect()} == dict(want)


def test_bucket_table_replaces_and_removes(spark, tmp_path):
    schema = StructType.fromDDL("k string, v int")
    table = BucketTable(spark, f"file://{tmp_path}/t", "k", schema, 4)
    assert table.read().count() == 0
    rows = lambda data: spark.createDataFrame(data, "k string, v int")
    table.replace(rows([("a", 0), ("b", 0)]), rows([("a", 1), ("a", 2), ("b", 3), ("stray", 9)]), 0)
    table.replace(rows([("a", 0), (None, 0)]), rows([]), 1)
    assert [tuple(r) for r in table.read().collect()] == [("b", 3)]
    table.replace(rows([("b", 0)]), rows([]), 2)
    assert table.read().count() == 0
    table.replace(rows([]), rows([]), 3)
    assert table.log.last()[0] == 2
    with pytest.raises(ValueError):
        BucketTable(spark, f"file://{tmp_path}/t", "k", schema, 8)


def test_log_reads_its_last_version(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log", "a int")
    assert log.last() == (-1, [])
    log.commit(0, [(1,)])
    log.commit(5, [(2,), (3,)])
    assert Log(spark, f"file://{tmp_path}/log", "a int").last()[0] == 5 and [r.a for r in log.last(5)[1]] == [1]
    with pytest.raises(ValueError):
        log.commit(6, [])


def test_ingest_reads_only_what_changed(spark, tmp_path):
    source, out, read = f"file://{tmp_path}/in", f"file://{tmp_path}/out", []

    def parse(paths):
        read.append(len(paths))
        return spark.read.schema("v int").csv(list(paths)).select("v", F.col("_metadata.file_path").alias("source_file"))

    def put(part, values):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / part).write_text("".join(f"{v}\n" for v in values))

    schema = StructType.fromDDL("v int, source_file string")
    put("a.txt", [1, 2])
    job = Ingest(spark, source, out, parse, "*.txt")
    values = lambda: sorted(r.v for r in job.rows(schema).collect())
    assert values() == [] and job.run() == 1 and job.run() == 0 and values() == [1, 2]
    put("b.txt", [3])
    put("skip.csv", [99])
    job = Ingest(spark, source, out, parse, "*.txt")
    commit, Ingest._commit = Ingest._commit, lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):  # it dies before the log names what it wrote
        job.run()
    Ingest._commit = commit
    assert values() == [1, 2] and job.run() == 1 and values() == [1, 2, 3]
    put("a.txt", [7, 8, 9])
    assert job.run() == 1 and values() == [3, 7, 8, 9]
    (tmp_path / "in" / "b.txt").unlink()
    assert job.run() == 1 and job.run() == 0 and values() == [7, 8, 9] and read == [1, 1, 1, 1]
