"""Which catalogued publications were obtained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.operators.lookup import lookup_join


def _with_id(files: DataFrame, name: str) -> DataFrame:
    """``publication_id`` from a file name without its last four characters, null if not a number."""
    digits = F.substring(F.col(name), F.lit(1), F.length(name) - 4)
    return files.withColumn("publication_id", digits.try_cast("bigint"))


def obtained_ids(files: DataFrame, name: str = "file_name") -> DataFrame:
    return _with_id(files, name).filter(F.col("publication_id").isNotNull())


def obtained_rejects(files: DataFrame, name: str = "file_name") -> DataFrame:
    return _with_id(files, name).filter(F.col("publication_id").isNull()).drop("publication_id")


def mark_found(catalog: DataFrame, obtained: DataFrame) -> DataFrame:
    """Every catalog row with ``found``. Ids are made unique before they meet the catalog."""
    ids = obtained.select("publication_id").distinct().withColumn("_there", F.lit(True))
    marked = lookup_join(catalog, ids, "publication_id", "left")
    return marked.withColumn("found", F.coalesce(F.col("_there"), F.lit(False))).drop("_there")


def found_rows(catalog: DataFrame, obtained: DataFrame) -> DataFrame:
    return mark_found(catalog, obtained).filter("found").drop("found")


def missing_rows(catalog: DataFrame, obtained: DataFrame) -> DataFrame:
    """Catalog rows without a file; repeated ids stay repeated."""
    return mark_found(catalog, obtained).filter("NOT found").drop("found")


def ratios(catalog: DataFrame, obtained: DataFrame) -> DataFrame:
    """Files per catalog row (can pass 1), and the share of catalog rows that have a file.

    Repeated catalog ids are counted before they meet the files, so both sides of the join are
    unique on the id, and each side then shrinks to one row of counts.
    """
    counted = catalog.groupBy("publication_id").agg(F.count(F.lit(1)).alias("_n"))
    ids = obtained.select("publication_id").distinct().withColumn("_there", F.lit(True))
    rows = counted.join(ids, "publication_id", "left").agg(
        F.sum("_n").alias("n_catalog"),
        F.sum(F.when(F.col("_there"), F.col("_n")).otherwise(0)).alias("n_found"),
        F.lit(0).cast("bigint").alias("n_files"),
    )
    files = obtained.agg(
        F.lit(0).cast("bigint").alias("n_catalog"),
        F.lit(0).cast("bigint").alias("n_found"),
        F.count(F.lit(1)).alias("n_files"),
    )
    both = rows.unionByName(files).agg(*[F.sum(c).alias(c) for c in ("n_catalog", "n_found", "n_files")])
    return both.withColumns(
        {
            "file_ratio": F.try_divide(F.col("n_files"), F.col("n_catalog")),
            "coverage": F.try_divide(F.col("n_found"), F.col("n_catalog")),
        }
    )


def file_counts(files: DataFrame, folder: str = "folder") -> DataFrame:
    return files.groupBy(folder).agg(F.count(F.lit(1)).alias("n_files"))
