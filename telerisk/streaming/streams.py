"""Structured Streaming forms of the operators.

Event time is cast to ``timestamp`` (session zone UTC), and every job is a one-shot ``availableNow`` run over
new files with a checkpoint in the shared folder.  Jobs that carry state from run to run are in ``jobs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from telerisk.session import shared_folder


def file_stream(spark: SparkSession, folder: str, schema: StructType, name: str = "*", kind: str = "parquet",
                files_per_trigger: int | None = None, **options) -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(folder)


def text_stream(spark: SparkSession, folder: str, schema: StructType, name: str = "*") -> DataFrame:
    """New tab-separated files as they arrive, with their file name."""
    return file_stream(spark, folder, schema, name, "csv", sep="\t", nullValue="\\N", quote="").select(
        "*", F.col("_metadata.file_path").alias("source_file"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is new, exactly once, into a Parquet folder."""
    (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    (stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def collect_stream(stream: DataFrame, purpose: str, mode: str = "append") -> DataFrame:
    """Run once into the shared folder and return what was written."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, purpose)
    run_available(stream, f"{folder}/data", f"{folder}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")


def audit_batches(stream: DataFrame, ts: str, low: str, high: str, purpose: str) -> DataFrame:
    """Per micro-batch counts of rows before, inside and after the rule window."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, purpose)
    first = F.lit(low).cast("date").cast("timestamp_ntz")
    after = F.date_add(F.lit(high).cast("date"), 1).cast("timestamp_ntz")
    t = F.col(ts)

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.agg(F.lit(batch_id).cast("long").alias("batch_id"), F.count(F.lit(1)).alias("rows"),
                   F.count_if(t.isNull()).alias("no_time"), F.count_if(t < first).alias("before_window"),
                   F.count_if((t >= first) & (t < after)).alias("in_window"), F.count_if(t >= after).alias("after_window"))
         .write.mode("overwrite").parquet(f"{folder}/data/batch={batch_id}"))

    run_batches(stream, write, f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/data").drop("batch")
