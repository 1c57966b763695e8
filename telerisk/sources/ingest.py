"""Incremental ingest of a folder of parts: only parts that are new or have changed are read again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG = "path string, modified timestamp, size long, removed boolean, version long"


class Ingest:
    """Parts of ``source`` read by ``read(paths)`` into ``out``, with a log of what was read from which state of each part.

    The rows that ``read`` returns need ``source_file`` as ``_metadata.file_path`` names it.  Rows are written before the log
    names their version, so a run that dies is repeated by the next one under the same version.  A part counts as changed
    if its time or size has; rows of a part that is gone from the folder leave the result.
    """

    def __init__(self, spark: SparkSession, source: str, out: str, read: Callable[[Sequence[str]], DataFrame], pattern: str = "*"):
        self.spark, self.source, self.out, self.read_parts, self.pattern = spark, source, out, read, pattern
        spark.createDataFrame([], StructType(StructType.fromDDL(LOG).fields[:-1])).write.mode("ignore").parquet(f"{out}/log/version=-1")

    def parts(self) -> DataFrame:
        """Path, time and size of every part there is now; their contents are not read."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", self.pattern).option("recursiveFileLookup", "true").load(self.source)
        return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"),
                            F.col("_metadata.file_size").alias("size"))

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.out}/log")

    def latest(self) -> DataFrame:
        """The last entry of each part."""
        last = F.max_by(F.struct("modified", "size", "removed", "version"), "version").alias("_e")
        return self.log().groupBy("path").agg(last).select("path", "_e.*")

    def changes(self) -> DataFrame:
        """Log entries that the present state of the folder calls for."""
        now, known = self.parts(), self.latest().withColumnsRenamed({"modified": "was", "size": "had"}).drop("version")
        both = now.join(known, "path", "full")
        gone = F.col("modified").isNull()
        same = F.col("was").eqNullSafe(F.col("modified")) & F.col("had").eqNullSafe(F.col("size")) & ~F.coalesce("removed", F.lit(False))
        wanted = F.when(gone, ~F.col("removed")).otherwise(~same)
        return both.where(wanted).select("path", F.coalesce("modified", "was").alias("modified"), F.coalesce("size", "had").alias("size"), gone.alias("removed"))

    def run(self) -> int:
        """Reads what is new or changed; returns the number of parts read or dropped."""
        changes = self.changes().toArrow()  # one row for each changed file, as the reader's own file list
        if not changes.num_rows:
            return 0
        version = (self.log().agg(F.max("version")).first()[0] if self.log().limit(1).count() else -1) + 1
        entries = changes.to_pylist()
        paths = [e["path"] for e in entries if not e["removed"]]
        if paths:
            self.read_parts(paths).write.mode("overwrite").parquet(f"{self.out}/rows/version={version}")
        self._commit(changes, version)
        return changes.num_rows

    def _commit(self, changes, version: int) -> None:
        self.spark.createDataFrame(changes).coalesce(1).write.mode("overwrite").parquet(f"{self.out}/log/version={version}")

    def rows(self, schema: StructType) -> DataFrame:
        """The rows of all parts as last read."""
        live = self.latest().where("NOT removed").select(F.col("path").alias("source_file"), "version")
        if not live.limit(1).count():
            return self.spark.createDataFrame([], schema)
        stored = self.spark.read.schema(StructType([*schema.fields]).add("version", "long")).parquet(f"{self.out}/rows")
        return stored.join(live, ["source_file", "version"], "left_semi").select(*schema.fieldNames())
