"""State that streaming jobs keep in a folder between runs: a commit log, and a keyed table in buckets.

Everything is written before the commit that names it, and versions follow the batch numbers of the checkpoint, so a
batch that is run again writes the same version again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Log:
    """A few rows for each committed version, one file each; the version with the largest number counts."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder = spark, folder
        self.empty = spark.createDataFrame([], schema)
        self.empty.coalesce(1).write.mode("ignore").parquet(f"{folder}/version=-1")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.empty.schema.fields]).add("version", "long")).parquet(self.folder)

    def commit(self, version: int, rows: Sequence[tuple]) -> None:
        if not rows:
            raise ValueError("a version needs a row to be seen")
        self.spark.createDataFrame(list(rows), self.empty.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/version={version}")

    def last(self, before: int | None = None) -> tuple[int, list]:
        """The latest version (below ``before``) and its rows; -1 and none where nothing is committed."""
        rows = self._rows() if before is None else self._rows().where(F.col("version") < before)
        version = rows.agg(F.max("version")).first()[0]
        return (-1, []) if version is None else (version, rows.where(F.col("version") == version).drop("version").collect())


class BucketTable:
    """Rows by key in hash buckets; a change writes the buckets of the touched keys anew and leaves the others where they are.

    A version lists where each bucket's rows were last written (at most one entry a bucket).  The number of buckets is
    fixed when the folder is made: a refresh reads and writes whole buckets, so choose it by the size of the table.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: StructType, buckets: int = 64):
        self.spark, self.folder, self.key, self.schema, self.buckets = spark, folder, key, schema, buckets
        layout = spark.createDataFrame([(key, buckets, schema.simpleString())], "key string, buckets int, columns string")
        layout.coalesce(1).write.mode("ignore").parquet(f"{folder}/layout")
        kept = spark.read.schema(layout.schema).parquet(f"{folder}/layout").first()
        if tuple(kept) != (key, buckets, schema.simpleString()):
            raise ValueError(f"the folder holds a table of another layout: {kept}")
        self.log = Log(spark, f"{folder}/versions", "bucket int, written long")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def pointers(self, before: int | None = None) -> dict[int, int]:
        return {r.bucket: r.written for r in self.log.last(before)[1] if r.bucket >= 0}

    def _read(self, pointers: dict[int, int]) -> DataFrame:
        if not pointers:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.folder}/rows/written={w}/bucket={b}" for b, w in sorted(pointers.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        return self._read(self.pointers())

    def replace(self, touched: DataFrame, fresh: DataFrame, version: int) -> None:
        """Version ``version``: all rows of the keys in ``touched`` give way to ``fresh``, other keys stay."""
        keys = touched.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        hit = [r.bucket for r in keys.select(self.bucket().alias("bucket")).distinct().collect()]  # at most one for each bucket
        if not hit:
            return
        known = self.pointers(version)
        kept = self._read({b: known[b] for b in hit if b in known}).join(keys, self.key, "left_anti")
        columns = self.schema.fieldNames()
        rows = kept.select(*columns).unionByName(fresh.join(keys, self.key, "left_semi").select(*columns)).withColumn("bucket", self.bucket())
        target = f"{self.folder}/rows/written={version}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        filled = self.spark.read.schema(StructType([*self.schema.fields]).add("bucket", "integer")).parquet(target).select("bucket").distinct().collect()
        pointers = {b: w for b, w in known.items() if b not in set(hit)} | {r.bucket: version for r in filled}
        self.log.commit(version, [(-1, version), *sorted(pointers.items())])
