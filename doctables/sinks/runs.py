"""Several tables of a run that become visible together.

A run's tables are written to a folder of their own attempt. One small commit file, written last and
renamed into place, names that folder; readers only follow commit files. A run that stops before has
written nothing that is read, and one that is repeated is read from its newest commit alone.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMITS = "_commits"


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _commits(spark: SparkSession, out: str) -> list[dict]:
    """The newest commit of every run. There is one small file per commit."""
    fs, where = _folder(spark, f"{out}/{_COMMITS}")
    if not fs.exists(where):
        return []
    newest: dict[str, dict] = {}
    for row in spark.read.text(f"{out}/{_COMMITS}", wholetext=True, pathGlobFilter="*.json").collect():
        commit = json.loads(row["value"])
        if commit["number"] >= newest.get(commit["run_id"], commit)["number"]:
            newest[commit["run_id"]] = commit
    return sorted(newest.values(), key=lambda c: c["run_id"])


def write_run(spark: SparkSession, out: str, run_id: str, tables: dict[str, DataFrame]) -> None:
    """Write the tables of a run and commit them together. One driver writes a run at a time."""
    attempt = uuid.uuid4().hex
    for name, df in tables.items():
        df.withColumn("run_id", F.lit(run_id)).write.parquet(f"{out}/{name}/{attempt}")
    number = 1 + max((c["number"] for c in _commits(spark, out)), default=0)
    commit = json.dumps({"run_id": run_id, "number": number, "attempt": attempt, "tables": sorted(tables)})
    fs, pending = _folder(spark, f"{out}/{_COMMITS}/.{attempt}.pending")
    _, final = _folder(spark, f"{out}/{_COMMITS}/{number:012d}-{attempt}.json")
    stream = fs.create(pending, True)
    try:
        stream.write(bytearray(commit.encode()))
    finally:
        stream.close()
    if not fs.rename(pending, final):
        raise OSError(f"commit of run {run_id} was not written")


def read_runs(spark: SparkSession, out: str, name: str, schema: str) -> DataFrame:
    """A table of all committed runs, with ``run_id``; empty without any. ``schema`` is that of the table."""
    whole = f"{schema}, run_id STRING"
    folders = [f"{out}/{name}/{c['attempt']}" for c in _commits(spark, out) if name in c["tables"]]
    return spark.read.schema(whole).parquet(*folders) if folders else spark.createDataFrame([], whole)


def stale_attempts(spark: SparkSession, out: str, name: str) -> list[str]:
    """Folders of a table that no reader follows: stopped runs and those that a later commit replaced."""
    fs, where = _folder(spark, f"{out}/{name}")
    if not fs.exists(where):
        return []
    followed = {c["attempt"] for c in _commits(spark, out)}
    return sorted(s.getPath().toString() for s in fs.listStatus(where) if s.getPath().getName() not in followed)
