"""Session helpers shared by all layers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def ship_by_value() -> None:
    """Make functions of this package travel inside the task, so executors need no copy of it."""
    import lexiflow

    cloudpickle.register_pickle_by_value(lexiflow)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of the test-data layout (a file or a folder of Parquet)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most rows and bytes of an Arrow batch, where the session does not say otherwise: whole files are large rows.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def bounded_batches(spark: SparkSession) -> None:
    """Set BATCHES for what the session has not set itself, so that a Python worker holds little at once."""
    for name, most in BATCHES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, str(most))


def spread(df: DataFrame, *keys: str, each: int = 4) -> DataFrame:
    """df dealt by keys, `each` tasks a core: a table may come in few row groups, and Python works in its tasks."""
    return df.repartition(each * df.sparkSession.sparkContext.defaultParallelism, *keys)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to many tasks without Python, so that what a task sorts and gathers stays small.

    The number is fixed, since adaptive execution joins tasks by their compressed size, and rows may pack well.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, on one machine only (tests), a fresh local one."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="lexiflow-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again; for rows with texts, which a checkpoint keeps uncompressed."""
    path = f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
