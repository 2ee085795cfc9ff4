"""Session settings the library is written for, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# AQE sizes the shuffles and splits skewed join partitions. Image rows are tens of megabytes, so
# Arrow batches are bounded by bytes (about ten decoded pages, a model batch); the record bound
# only matters for narrow rows.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    # Call sites of column expressions are not recorded: wide plans build faster.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(256 * 1024 * 1024),
}


def local_session(cpus: int | str = "*", app: str = "doctables", **extra: str) -> SparkSession:
    """A single-machine session, for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession, fallback: str | None = None) -> str:
    """The folder named by the cluster in ``spark.checkpoint.dir``.

    Where none is named, ``fallback`` becomes it. Without one, a session on a single machine gets a
    temporary folder; on a cluster, whose machines would each write to their own, that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if fallback is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: executors share no folder")
        fallback = tempfile.mkdtemp(prefix="run-")
    spark.sparkContext.setCheckpointDir(fallback)
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, for tables between steps."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
