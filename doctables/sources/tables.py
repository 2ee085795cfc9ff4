"""Scans. Every schema is declared."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctables import schemas
from doctables.functions import paths
from doctables.functions.batches import batched


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Catalog text as it is; columns are taken by name, other columns are ignored."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    # A quoted title may hold line breaks, so a file is one task; its rows keep their order.
    return reader.csv(path).select(*schemas.CATALOG_CSV.names, F.monotonically_increasing_id().alias("catalog_pos"))


def catalog_rows(raw: DataFrame) -> DataFrame:
    """Rows with a whole-number id and a URL, with their place where the source knows it."""
    return _typed(raw).filter(F.col("publication_id").isNotNull() & F.col("url").isNotNull())


def catalog_rejects(raw: DataFrame) -> DataFrame:
    """Rows whose id is not a whole number, or that have no URL, as read."""
    return raw.filter(F.col("Publication ID").try_cast("bigint").isNull() | F.col("URL").isNull())


def _typed(raw: DataFrame) -> DataFrame:
    place = ["catalog_pos"] if "catalog_pos" in raw.columns else []
    return raw.select(
        F.col("Publication ID").try_cast("bigint").alias("publication_id"), F.col("URL").alias("url"), *place
    )


def seed_urls(spark: SparkSession, urls: list[str]) -> DataFrame:
    """A short list given in code, with its position."""
    return spark.createDataFrame(list(enumerate(urls)), "catalog_pos INT, url STRING")


def list_files(spark: SparkSession, folder: str, suffix: str | None = None, recursive: bool = False) -> DataFrame:
    """Files of a folder. Contents are not read; the suffix is case-sensitive.

    Spark's reader holds the index on the driver and leaves out files without bytes; ``list_tree`` does
    neither.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if suffix is not None:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.load(folder).select(
        "path", paths.file_name(F.col("path")).alias("file_name"), F.col("length").alias("n_bytes")
    )


def list_mounted(folder: str) -> Iterator[tuple[str, bool, int]]:
    """(name, is a folder, size) of the entries of a folder that all executors mount."""
    with os.scandir(folder.removeprefix("file:")) as entries:
        for entry in entries:
            inside = entry.is_dir()
            yield entry.name, inside, 0 if inside else entry.stat().st_size


def _hidden(name: str) -> bool:
    """The names that Spark's own listings leave out."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def list_tree(
    spark: SparkSession,
    folder: str,
    work: str,
    suffix: str | None = None,
    list_folder: Callable[[str], Iterable[tuple[str, bool, int]]] = list_mounted,
    tasks: int | None = None,
) -> DataFrame:
    """``list_files`` of a whole tree, where the driver holds no index.

    Folders are listed by tasks, one level of the tree a round; what a round finds is a table under
    ``work``, whose folders are the next round's. The driver sees one count per round. ``list_folder``
    lists other stores than mounted folders.
    """
    tasks = tasks or spark.sparkContext.defaultParallelism
    schema = T.StructType.fromDDL("path STRING, file_name STRING, n_bytes LONG, folder BOOLEAN")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[tuple]:
            for frame in frames:
                for parent in frame["path"]:
                    for name, inside, size in list_folder(parent):
                        if not _hidden(name) and (inside or suffix is None or name.endswith(suffix)):
                            yield f"{parent.rstrip('/')}/{name}", name, size, inside

        yield from batched(found(), schema.names, lambda row: len(row[0]))

    schemed = re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", folder)
    start = re.sub("^file:/+", "file:/", folder) if schemed else f"file:{os.path.abspath(folder)}"
    frontier, rounds = spark.createDataFrame([(start,)], "path STRING"), []
    while not frontier.isEmpty():
        rounds.append(f"{work}/{len(rounds)}")
        frontier.repartition(tasks, "path").mapInPandas(run, schema).write.mode("overwrite").parquet(rounds[-1])
        frontier = spark.read.schema(schema).parquet(rounds[-1]).filter("folder").select("path")
    return spark.read.schema(schema).parquet(*rounds).filter("NOT folder").drop("folder")


def glob_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return reader.load(folder).select(
        "path", paths.file_name(F.col("path")).alias("file_name"), F.col("length").alias("n_bytes")
    )


def with_suffix(files: DataFrame, suffix: str, name: str = "file_name") -> DataFrame:
    return files.filter(F.col(name).endswith(suffix))


def without_word(files: DataFrame, word: str = "sample", name: str = "file_name") -> DataFrame:
    """Drop names that contain a word in any case."""
    return files.filter(~F.contains(F.lower(F.col(name)), F.lit(word.lower())))


def read_documents(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Documents with their bytes: ``doc_path, content``."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return reader.load(folder).select(F.col("path").alias("doc_path"), "content")


def read_images(spark: SparkSession, folder: str, keep_invalid: bool = True, pattern: str = "*.png") -> DataFrame:
    """Decoded page images with ``file_path``; files that do not decode keep a row of height -1.

    The path comes from the file listing, so frames that drop ``image`` decode nothing.
    The listing of a folder is held by the driver: for very many pages read the table that
    ``jobs.paginate`` leaves in ``<work>/pages`` instead, with ``decode`` where it is used.
    """
    reader = spark.read.format("image").option("dropInvalid", str(not keep_invalid).lower())
    images = reader.option("pathGlobFilter", pattern).load(folder)
    return images.select(paths.canonical_path(F.col("_metadata.file_path"), True).alias("file_path"), "image")


def read_landed_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LANDED_PAGE).parquet(path)


def page_scan(pages: DataFrame) -> DataFrame:
    """The two columns of a fetched page; bodies that never arrived are left out."""
    return pages.select("url", "html").filter(F.col("html").isNotNull())


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """``file_path, score`` text rows; quotes inside quotes are doubled."""
    reader = spark.read.schema("file_path STRING, score STRING").option("header", True)
    return reader.option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def ids_of_json(texts: DataFrame, col: str = "value") -> DataFrame:
    """One row per id of JSON array texts; text that is not such an array is an error."""
    ids = F.from_json(F.col(col), "array<bigint>", {"mode": "FAILFAST"})
    return texts.select(F.explode(ids).alias("publication_id"))


def read_missing_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids from files that each hold one JSON array."""
    return ids_of_json(spark.read.text(path, wholetext=True))


def read_missing_lines(spark: SparkSession, path: str) -> DataFrame:
    """Ids from the line form, which splits at any size."""
    return spark.read.schema("publication_id BIGINT").json(path)
