"""Result tables and text exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctables.functions import paths
from doctables.operators.results import as_text


def write_results(results: DataFrame, path: str) -> None:
    """Typed results, replaced on every run."""
    results.write.mode("overwrite").parquet(path)


def write_lookup(results: DataFrame, path: str, key: str = "file_path", group_bytes: int = 8 << 20) -> None:
    """Typed results laid out for lookups by path.

    Rows are in ranges of the path, so the statistics of nearly all row groups exclude a path, and
    Bloom filters exclude paths that lie between those of a group. ``group_bytes`` is the size of a row
    group, the least that a lookup reads. Rows of one path keep the order of ``row_idx``.
    """
    order = [key] + [c for c in ("row_idx",) if c in results.columns]
    (
        results.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("parquet.block.size", group_bytes)
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .parquet(path)
    )


def write_manifest(pages: DataFrame, name: str, path: str, buckets: int, column: str = "image_path") -> DataFrame:
    """Pages as a table whose buckets follow the canonical path (``canonical_path``).

    Two of these with one number of buckets are compared without a shuffle: see ``pending_pages``. The
    rows are dealt once, here, so that a bucket is one file.
    """
    keyed = pages.withColumn("canonical_path", paths.canonical_path(F.col(column), False)).repartition(buckets, "canonical_path")
    writer = keyed.write.mode("overwrite").option("path", path).bucketBy(buckets, "canonical_path").sortBy("canonical_path")
    writer.saveAsTable(name)
    return pages.sparkSession.table(name)


def write_results_csv(results: DataFrame, path: str) -> None:
    as_text(results).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """Add a run's rows to a table. The run is a partition and replaces itself when repeated, so a
    rerun never doubles rows and other runs are untouched."""
    (
        df.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def missing_lines(missing: DataFrame) -> DataFrame:
    """One JSON object per missing catalog row; no gathering, so any size goes."""
    return missing.select(F.to_json(F.struct("publication_id")).alias("value"))


def write_missing_lines(missing: DataFrame, path: str) -> None:
    missing_lines(missing).write.mode("overwrite").text(path)


def write_missing_array(missing: DataFrame, path: str, work: str) -> None:
    """All missing ids as one JSON array, in parts: the files of ``path``, joined in the order of their
    names, are the array.

    The ids are written to ``work`` first, so that the tasks that read them are the same twice. Their
    row counts tell every task whether rows come before and after its own, and with that which of its
    rows open the array, follow a comma, or close it; no task sees the rows of another.
    """
    spark = missing.sparkSession
    missing.select(F.col("publication_id").cast("long").alias("publication_id")).write.mode("overwrite").parquet(work)
    ids = spark.read.schema("publication_id LONG").parquet(work)
    task = F.spark_partition_id()
    counts = {r["task"]: r["count"] for r in ids.groupBy(task.alias("task")).count().collect()}  # one row per task
    if not counts:
        spark.createDataFrame([("[]",)], "value STRING").coalesce(1).write.mode("overwrite").text(path)
        return
    first, last = min(counts), max(counts)
    # The lower 33 bits count the rows of a task.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    opened = F.when((task == first) & (place == 0), "[").otherwise(",")
    closed = F.when((task == last) & (place == counts[last] - 1), "]").otherwise("")
    text = F.concat(opened, F.coalesce(F.col("publication_id").cast("string"), F.lit("null")), closed)
    ids.select(text.alias("value")).write.mode("overwrite").text(path)


def read_missing_array(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the parts that ``write_missing_array`` leaves; a line is an id between its signs."""
    line = F.regexp_replace(F.col("value"), r"[\[\],]", "")
    return spark.read.text(path).filter(line != "").select(line.try_cast("bigint").alias("publication_id"))
