"""Streaming jobs that go on from run to run in one folder, and can be brought to an end.

Each job is a one-shot run over what is new since the last run.  What a later batch may still need (open sessions, samples
of open windows, keys seen of late) lies in small side tables beside the output, so the state that a job carries is bounded
by its delay and not by its history, and a job may be flushed when its source has ended.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from telerisk.streaming.state import BucketTable, Log
from telerisk.streaming.streams import run_batches

Settle = Callable[[DataFrame, Column], DataFrame]


class ClosingJob:
    """Delivers what no later row can change, and carries the rest over to the next batch or run.

    ``carry`` turns arrived rows into rows of ``schema``; ``settle`` takes those together with the rows carried so far, and the
    watermark, and returns them (merged, if need be) with the flag ``closed``.  ``finish`` turns closed rows into what is
    delivered.  Rows from before the watermark come too late: they are kept in the folder ``late`` and are not part of the
    result.  The watermark is the latest time seen less ``delay_s``.
    """

    def __init__(self, spark: SparkSession, folder: str, at: str, carry: Callable[[DataFrame], DataFrame], settle: Settle,
                 schema: StructType, delay_s: int, finish: Callable[[DataFrame], DataFrame] = lambda rows: rows):
        self.spark, self.folder, self.at, self.carry, self.settle = spark, folder, at, carry, settle
        self.schema, self.delay, self.finish = schema, timedelta(seconds=delay_s), finish
        self.log = Log(spark, f"{folder}/marks", "watermark timestamp_ntz")

    def _settled(self, version: int, closed: bool) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(StructType([*self.schema.fields]).add("closed", "boolean")).parquet(f"{self.folder}/settled/version={version}")
        return rows.where(F.col("closed") == closed).drop("closed")

    def _deliver(self, pool: DataFrame, mark: datetime, version: int) -> None:
        settled = self.settle(pool, F.lit(mark).cast("timestamp_ntz")).select(*self.schema.fieldNames(), "closed")
        settled.write.mode("overwrite").partitionBy("closed").parquet(f"{self.folder}/settled/version={version}")
        self.finish(self._settled(version, True)).write.mode("overwrite").parquet(f"{self.folder}/delivered/version={version}")
        self.log.commit(version, [(mark,)])

    def _batch(self, batch: DataFrame, batch_id: int) -> None:
        version = 2 * batch_id + 1
        before, marks = self.log.last(version)
        latest = batch.agg(F.max(F.col(self.at).cast("timestamp_ntz"))).first()[0]
        if latest is None:
            return
        mark = latest - self.delay
        if marks:
            late = F.col(self.at).cast("timestamp_ntz") < F.lit(marks[0].watermark).cast("timestamp_ntz")
            batch.where(late).write.mode("overwrite").parquet(f"{self.folder}/late/version={version}")
            batch, mark = batch.where(~F.coalesce(late, F.lit(False))), max(mark, marks[0].watermark)
        self._deliver(self._settled(before, False).unionByName(self.carry(batch)), mark, version)

    def run(self, stream: DataFrame) -> None:
        """Everything that is new in the stream."""
        run_batches(stream, self._batch, f"{self.folder}/checkpoint")

    def flush(self) -> None:
        """The source has ended: what is open is delivered as it stands.  Rows that arrive after it come too late."""
        version, marks = self.log.last()
        if marks and version % 2:
            self._deliver(self._settled(version, False), datetime(9999, 1, 1), version + 1)

    def delivered(self) -> DataFrame:
        """All rows delivered so far, each once."""
        last, _ = self.log.last()
        schema = self.finish(self.spark.createDataFrame([], self.schema)).schema
        if last < 0:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(StructType([*schema.fields]).add("version", "long")).parquet(f"{self.folder}/delivered")
        return rows.where(F.col("version") <= last).select(*schema.fieldNames())


def session_job(events: DataFrame, folder: str, keys: Sequence[str] = ("gpsno", "event_type"), ts: str = "ts", gap_s: int = 60,
                delay_s: int = 600) -> ClosingJob:
    """Sessions of rows that follow each other within ``gap_s`` seconds (a gap of exactly that many stays one session).

    Rows in one time cell of ``gap_s`` seconds belong together in any case, so a key comes down to one row for each cell
    before its cells are put in order, however many rows it has.  Rows without a time or key are left out.
    """
    schema = StructType([events.schema[k] for k in keys]).add("first_ts", "timestamp_ntz").add("last_ts", "timestamp_ntz").add("events", "long")
    second = F.unix_seconds

    def carry(rows: DataFrame) -> DataFrame:
        at = F.date_trunc("second", F.col(ts)).cast("timestamp_ntz")
        rows = rows.select(*keys, at.alias("_at")).dropna()
        return (rows.groupBy(*keys, F.floor(second(F.col("_at").cast("timestamp")) / gap_s).alias("_cell"))
                .agg(F.min("_at").alias("first_ts"), F.max("_at").alias("last_ts"), F.count(F.lit(1)).alias("events")).drop("_cell"))

    def settle(pool: DataFrame, mark: Column) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("first_ts")
        reach = F.max("last_ts").over(order.rowsBetween(Window.unboundedPreceding, -1))
        apart = F.when(reach.isNull() | (F.col("first_ts") > reach + F.make_dt_interval(secs=F.lit(gap_s))), 1).otherwise(0)
        marked = pool.withColumn("_starts", apart).withColumn("_no", F.sum("_starts").over(order))
        out = marked.groupBy(*keys, "_no").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("events").alias("events"))
        return out.withColumn("closed", F.col("last_ts") + F.make_dt_interval(secs=F.lit(gap_s)) < mark)

    return ClosingJob(events.sparkSession, folder, ts, carry, settle, schema, delay_s)


def window_job(samples: DataFrame, folder: str, summary: Callable[[DataFrame], DataFrame], ts: str = "ts", window_s: int = 10, delay_s: int = 60) -> ClosingJob:
    """Summaries of closed tumbling windows; the samples of open ones are carried, so a summary is the batch one and exact."""
    def settle(pool: DataFrame, mark: Column) -> DataFrame:
        at = F.unix_seconds(F.col(ts).cast("timestamp"))
        return pool.withColumn("closed", (F.floor(at / window_s) + 1) * window_s <= F.unix_seconds(mark.cast("timestamp")))

    return ClosingJob(samples.sparkSession, folder, ts, lambda rows: rows.where(F.col(ts).isNotNull()), settle, samples.schema, delay_s, summary)


class DistinctJob:
    """Rows whose key was not seen before, from a log of keys by day.

    A batch is compared only with the days it touches.  A row more than ``delay_days`` days older than the latest day seen
    comes too late and goes to the folder ``late``; days that no row may touch any more are dropped from the log.
    Keys may be NULL; NULL equals NULL.  Rows without a time are late.
    """

    def __init__(self, events: DataFrame, folder: str, keys: Sequence[str], ts: str = "event_ts", delay_days: int = 1):
        self.spark, self.folder, self.keys, self.ts, self.delay = events.sparkSession, folder, list(keys), ts, timedelta(days=delay_days)
        self.schema = events.schema
        self.log = Log(self.spark, f"{folder}/marks", "day date, oldest date")

    def _seen(self) -> DataFrame:
        schema = StructType([self.schema[k] for k in self.keys]).add("day", "date").add("batch", "long")
        self.spark.createDataFrame([], StructType([*schema.fields[:-2]])).write.mode("ignore").parquet(f"{self.folder}/seen/day=0001-01-01/batch=-1")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/seen")

    def _batch(self, batch: DataFrame, batch_id: int) -> None:
        _, marks = self.log.last(batch_id)
        latest, first = batch.agg(F.max(F.to_date(self.ts)), F.min(F.to_date(self.ts))).first()
        if latest is None:
            return
        oldest = marks[0].oldest if marks else first
        day = F.to_date(self.ts)
        fine = F.coalesce(day >= F.lit(oldest), F.lit(False))
        batch.where(~fine).write.mode("overwrite").parquet(f"{self.folder}/late/batch={batch_id}")
        rows = batch.where(fine).dropDuplicates(self.keys).withColumn("_day", day)
        days = [r[0] for r in rows.select("_day").distinct().collect()]  # days within the delay of the latest ones
        seen = self._seen().where(F.col("day").isin(days) & (F.col("batch") < batch_id))
        same = [rows[k].eqNullSafe(seen[k]) for k in self.keys] + [rows["_day"] == seen["day"]]
        rows.join(seen, same, "left_anti").drop("_day").write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch_id}")
        new = self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows/batch={batch_id}")
        (new.select(*self.keys, day.alias("day"), F.lit(batch_id).cast("long").alias("batch")).repartition("day").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{self.folder}/seen"))
        newest = max(latest, marks[0].day) if marks else latest
        self.log.commit(batch_id, [(newest, max(oldest, newest - self.delay))])
        self._forget(max(oldest, newest - self.delay))

    def _forget(self, oldest) -> None:
        """Drops the days before ``oldest`` from the log of keys; the files are no longer read in any case."""
        gone = self._seen().where((F.col("day") < F.lit(oldest)) & (F.col("day") > F.lit("0001-01-01").cast("date"))).select("day").distinct().collect()
        files = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = files.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for r in gone:
            system.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/seen/day={r.day}"), True)

    def run(self, stream: DataFrame) -> None:
        run_batches(stream, self._batch, f"{self.folder}/checkpoint")

    def delivered(self) -> DataFrame:
        last, _ = self.log.last()
        if last < 0:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(StructType([*self.schema.fields]).add("batch", "long")).parquet(f"{self.folder}/rows")
        return rows.where(F.col("batch") <= last).select(*self.schema.fieldNames())


class RefreshJob:
    """Scores kept up to date: each batch rescores the entities it touches, from their whole history, and no others.

    ``score(history, touched)`` returns rows of ``schema`` for the touched entities, from all their rows so far.  History and
    scores lie in the same hash buckets, so a batch reads and rewrites only the buckets of its entities.
    """

    def __init__(self, rows: DataFrame, folder: str, key: str, schema: StructType, score: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64):
        self.spark, self.folder, self.key, self.score = rows.sparkSession, folder, key, score
        self.arrived = rows.schema
        self.table = BucketTable(self.spark, f"{folder}/scores", key, schema, buckets)

    def _batch(self, batch: DataFrame, batch_id: int) -> None:
        here = f"{self.folder}/history/batch={batch_id}"
        rows = batch.where(F.col(self.key).isNotNull()).withColumn("bucket", self.table.bucket())
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(here)
        touched = self.spark.read.schema(StructType([*self.arrived.fields]).add("bucket", "integer")).parquet(here).select(self.key, "bucket").distinct()
        hit = [r.bucket for r in touched.select("bucket").distinct().collect()]  # at most one for each bucket
        if not hit:
            return
        schema = StructType([*self.arrived.fields]).add("batch", "long").add("bucket", "integer")
        history = self.spark.read.schema(schema).parquet(f"{self.folder}/history").where(F.col("bucket").isin(hit) & (F.col("batch") <= batch_id))
        touched = touched.select(self.key)
        history = history.join(touched, self.key, "left_semi").select(*self.arrived.fieldNames())
        self.table.replace(touched, self.score(history, touched), batch_id)

    def run(self, stream: DataFrame) -> None:
        run_batches(stream, self._batch, f"{self.folder}/checkpoint")

    def scores(self) -> DataFrame:
        return self.table.read()
