"""Session helpers: defaults for local runs and the shared folder for written state."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", name: str = "telerisk", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster, pass your own session instead."""
    parts = str(os.cpu_count() or 8) if cores == "*" else str(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # call-site capture costs milliseconds per column expression on wide plans
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared checkpoint directory named by the session.

    A machine-local folder is used only where the setting is absent and the master is
    local, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="telerisk-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the entities: it is shuffled and never broadcast.

    Sizes are estimated from compressed files, maps as one entry and exploded rows as one row, so such a table can seem to
    be a few megabytes while its rows would fill the driver.
    """
    return df.hint("merge")


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write once to the shared folder and read back: survives executor loss, cuts lineage."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
