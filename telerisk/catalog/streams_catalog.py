"""Streaming jobs (ST1-ST6), each a one-shot run over the driver files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from telerisk.catalog import sqlviews as Q
from telerisk.catalog import views as V
from telerisk.catalog.expressions import CANON_COLUMNS
from telerisk.catalog.registry import query
from telerisk.catalog.sources_sinks import raw_event_files
from telerisk.catalog.windows import A_CTES, bands_sql
from telerisk import codes
from telerisk.operators import imu as I
from telerisk.operators import scoring
from telerisk.session import materialise, shared_folder
from telerisk.sources import canon, files
from telerisk.streaming import jobs, streams


def event_stream(spark, sf):
    """The event table as a file stream."""
    schema = V.table(spark, sf, "events").schema
    return streams.file_stream(spark, sf, schema, "events.parquet").select(
        F.col("user_id").cast("string").alias("gpsno"), "ts", "event_type", "event_id", "value")


@query("st1_incremental_canonical", Q.shape(f"SELECT {', '.join(CANON_COLUMNS)} FROM canon", ["lat", "lng", "speed"], ["event_type"],
                                            f"{Q.RAW}, {Q.CANON}", ["event_ts"]))
def st1(spark, sf):
    folder = raw_event_files(spark, sf, "st1-in")
    stream = canon.canonical_events(streams.text_stream(spark, folder, files.text_schema(codes.EVENT_COLUMNS)))
    return streams.collect_stream(stream, "st1").select(*CANON_COLUMNS)


SESSION_GAP = 21600
SESSIONS = f"""marked AS (SELECT *, CASE WHEN prev IS NULL OR DATE_DIFF('second', prev, ts) > {SESSION_GAP} THEN 1 ELSE 0 END AS starts FROM (
  SELECT user_id, event_type, ts, LAG(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS prev FROM events) o),
sessions AS (SELECT CAST(user_id AS VARCHAR) AS gpsno, event_type, COUNT(*) AS events, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM (
  SELECT *, SUM(starts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS no FROM marked) m GROUP BY user_id, event_type, no)"""


def runs(spark, sf, rows, purpose, when, days=("2024-01-11", "2024-01-21")):
    """The rows written to a folder in periods, as days of arrival end them; after each, the folder as a stream."""
    folder = shared_folder(spark, purpose)
    limits = [None, *days, None]
    for k, (low, high) in enumerate(zip(limits, limits[1:])):
        part = rows if low is None else rows.where(when >= F.lit(low).cast("timestamp_ntz"))
        part = part if high is None else part.where(when < F.lit(high).cast("timestamp_ntz"))
        part.write.parquet(f"{folder}/in/period-{k}")
        yield f"{folder}/job", streams.file_stream(spark, f"{folder}/in/*", rows.schema)


@query("st2_session_episodes", Q.shape("SELECT gpsno, event_type, date_trunc('second', first_ts) AS first_ts, date_trunc('second', last_ts) AS last_ts, events FROM sessions",
                                       ctes=SESSIONS, t=["first_ts", "last_ts"]))
def st2(spark, sf):
    """Three runs in one folder, the last one brought to its end: every session is delivered once, open ones are carried."""
    rows = V.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("gpsno"), "ts", "event_type")
    for folder, stream in runs(spark, sf, rows, "st2", F.col("ts")):
        job = jobs.session_job(stream, folder, gap_s=SESSION_GAP)
        job.run(stream)
    job.flush()
    return job.delivered()


@query("st3_stream_motion_windows", Q.shape("""SELECT gpsno, imei, window_id, sample_count, valid_accel_samples, valid_gyro_samples, accel_norm_max, accel_norm_p95,
    gyro_norm_p95 FROM imu_windows""", ["accel_norm_max", "accel_norm_p95", "gyro_norm_p95"], ctes=Q.IMU_CTES))
def st3(spark, sf):
    """All samples in two runs; windows that are open at the end of the first are finished in the second."""
    samples = I.motion_samples(V.imu(spark, sf))
    for folder, stream in runs(spark, sf, samples, "st3", F.col("ts"), ("2024-01-16",)):
        job = jobs.window_job(stream, folder, lambda closed: I.imu_windows(closed, stage=materialise))
        job.run(stream)
    job.flush()
    return job.delivered().select("gpsno", "imei", "window_id", "sample_count", "valid_accel_samples", "valid_gyro_samples", "accel_norm_max",
                                  "accel_norm_p95", "gyro_norm_p95")


@query("st4_stream_distinct", Q.shape("SELECT gpsno, event_ts, event_type FROM clean", b=["event_type"], ctes=Q.CLEAN, t=["event_ts"]))
def st4(spark, sf):
    """Copies arrive half a day late, often in the next run; keys older than two days are forgotten.  Equal to the batch distinct."""
    log = V.event_log(spark, sf)
    keys = ["gpsno", "event_ts", "event_type", "event_name", "lat", "lng", "speed"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))  # a few copies of each event
    arrival = F.col("event_ts") + F.when(F.col("copy") > 1, F.expr("INTERVAL 12 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    log = materialise(log.withColumn("copy", nth).withColumn("arrival", arrival), "st4-log")
    for folder, stream in runs(spark, sf, log, "st4", F.col("arrival")):
        job = jobs.DistinctJob(stream, folder, keys, delay_days=2)
        job.run(stream)
    return job.delivered().select("gpsno", "event_ts", "event_type")


REFRESH_ANCHORS = (20, 30)
CARD = "gpsno string, anchor_day int, as_of_date date, safety_score double, grade string, risk_level string, probability double, route string"


@query("st5_daily_refresh", Q.shape(f"""SELECT c.gpsno, c.anchor_day, {Q.FIRST} + CAST(c.anchor_day - 1 AS INTEGER) AS as_of_date, 100 - total_deduction AS safety_score,
    {bands_sql(codes.SCORE_A_GRADES, 0, 'U')} AS grade, {bands_sql(codes.SCORE_A_GRADES, 2, codes.SCORE_A_UNRATED[1])} AS risk_level, probability, route
    FROM cards_a c WHERE c.anchor_day IN {REFRESH_ANCHORS} AND c.gpsno IN (SELECT CAST(user_id AS VARCHAR) FROM events)""",
    ["safety_score", "probability"], ["anchor_day"], A_CTES, ["as_of_date"]))
def st5(spark, sf):
    """Scorecards refreshed by two runs: each rescores the entities with new rows from their history so far, against a kept reference."""
    weights = materialise(scoring.shrink_weights(V.importance(spark, sf), codes.STATES), "weights")
    signals, _ = scoring.card_signals(V.daily_table(spark, sf), V.split_table(spark, sf), V.card_probability(spark, sf, (30,)), weights, (30,), 0.3125, materialise)
    reference = materialise(scoring.reference_signals(signals, 30), "reference")
    schema = StructType.fromDDL(CARD)

    def score(history, touched):
        here = shared_folder(spark, "touched")
        history.drop("gpsno").write.parquet(f"{here}/events.parquet")
        V.table(spark, sf, "customer").join(touched, F.col("c_custkey").cast("string") == F.col("gpsno"), "left_semi").write.parquet(f"{here}/customer.parquet")
        cards = scoring.scorecard_a(V.daily_table(spark, here), V.split_table(spark, here), V.card_probability(spark, here, REFRESH_ANCHORS), weights,
                                    REFRESH_ANCHORS, 30, 0.3125, V.PERIOD.first_day, stage=materialise, reference=reference)
        return cards.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])

    rows = V.table(spark, sf, "events").withColumn("gpsno", F.col("user_id").cast("string"))
    for folder, stream in runs(spark, sf, rows, "st5", F.col("ts"), ("2024-01-21",)):
        job = jobs.RefreshJob(stream, folder, "gpsno", schema, score, buckets=16)
        job.run(stream)
    return job.scores()


@query("st6_late_row_audit", """SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE ts IS NULL) AS no_time, COUNT(*) FILTER (WHERE ts < TIMESTAMP '2024-01-05') AS before_window,
    COUNT(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-26') AS in_window, COUNT(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-26') AS after_window FROM events""")
def st6(spark, sf):
    audit = streams.audit_batches(event_stream(spark, sf), "ts", "2024-01-05", "2024-01-25", "st6")
    return audit.agg(*[F.sum(c).alias(c) for c in ("rows", "no_time", "before_window", "in_window", "after_window")])
