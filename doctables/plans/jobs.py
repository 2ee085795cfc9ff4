"""The four jobs, end to end.

Stages hand over tables written under a ``work`` folder that all executors share. A lost executor
costs its own tasks; a job started again with ``resume`` reads the stages that finished before.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctables import schemas
from doctables.functions import paths, pixels
from doctables.operators import detect as D
from doctables.operators import fetch as FE
from doctables.operators import images as I
from doctables.operators import links as L
from doctables.operators import pages as P
from doctables.operators import reconcile as R
from doctables.operators import results as RES
from doctables.sinks import files as out_files
from doctables.sinks import runs as out_runs
from doctables.sinks import tables as out_tables
from doctables.sources import tables as sources


def _complete(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def _stored(df: DataFrame, path: str, resume: bool = False) -> DataFrame:
    """Write a stage's table and read it back; with ``resume`` a finished one is only read."""
    spark = df.sparkSession
    if not (resume and _complete(spark, path)):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def acquire(
    catalog: DataFrame,
    landed_pages: DataFrame,
    fetch: Callable[[str], bytes],
    pdf_folder: str,
    work: str,
    tasks: int,
    tasks_per_host: int = 4,
    resume: bool = False,
) -> DataFrame:
    """Catalog to ``<publication id>.pdf`` files; returns the fetch log, one row per attempt.

    The last link of a publication decides; where it fails, the one before it is tried, down to the
    first.
    """
    links = _stored(L.catalog_links(catalog, landed_pages), f"{work}/links", resume)
    candidates = L.candidate_links(links)
    fetched = _stored(FE.fetch_with_fallback(candidates, fetch, tasks, tasks_per_host), f"{work}/fetched", resume)
    # Evaluating the manifest is what writes the files.
    got = fetched.filter("status = 'ok'")
    _stored(out_files.write_files(got, pdf_folder, "file_path", "content"), f"{work}/files", resume)
    return fetched.drop("content")


def verify(spark: SparkSession, catalog: DataFrame, pdf_folder: str, missing_path: str) -> DataFrame:
    """Write the missing ids and return the two ratios."""
    obtained = R.obtained_ids(sources.list_files(spark, pdf_folder))
    out_tables.write_missing_lines(R.missing_rows(catalog, obtained), missing_path)
    return R.ratios(catalog, obtained)


def paginate(
    spark: SparkSession,
    pdf_folder: str,
    image_folder: str,
    count_pages: Callable[[bytes], int],
    render: P.Render,
    read: Callable[[str], bytes],
    tasks: int,
    work: str,
    dpi: int = 300,
    batch_size: int = 10,
    done: DataFrame | None = None,
    catalog: DataFrame | None = None,
    overwrite: bool = False,
    as_files: bool = True,
    resume: bool = False,
) -> DataFrame:
    """Documents to page images; returns the log of pages with status.

    ``done`` (``image_path``: a manifest, or a listing of the image folder) leaves out pages of
    earlier runs; only the others are rendered. ``catalog`` (``publication_id``) takes the files of
    its rows only. The images are the table ``<work>/pages``; ``as_files`` also writes one file per
    page, which beyond millions of pages is better left out.
    """
    docs = sources.read_documents(spark, pdf_folder)
    counted = _stored(P.page_counts(docs, count_pages), f"{work}/documents", resume)
    if catalog is not None:
        wanted = catalog.select(F.concat(F.col("publication_id").cast("string"), F.lit(".pdf")).alias("_name")).distinct()
        counted = counted.join(wanted, paths.file_name(F.col("doc_path")) == F.col("_name"), "left_semi")
    pages = P.with_page_path(P.page_range(counted.filter("status = 'ok'")), image_folder)
    if done is not None:
        pages = P.pending_pages(pages, done, overwrite)
    batch = F.floor((F.col("page_num") - 1) / batch_size)
    batches = pages.groupBy("doc_path", batch.alias("batch")).agg(F.collect_list("page_num").alias("pages"))
    rendered = P.with_page_path(P.render_batches(batches, render, read, tasks, dpi), image_folder)
    made = _stored(rendered, f"{work}/pages", resume)
    if as_files:
        whole = P.drop_empty_pages(made).withColumn("name", paths.file_name(F.col("image_path")))
        _stored(out_files.write_files(whole, image_folder, "name", "image", overwrite), f"{work}/page_files", resume)
    bad = P.quarantine(counted).select(
        "doc_path", F.lit(None).cast("int").alias("page_num"), "status", "reason", F.lit(None).cast("string").alias("image_path")
    )
    return made.drop("image").unionByName(bad)


def detect_tables(
    images: DataFrame,
    make_model: Callable[[], Callable],
    out: str,
    run_id: str,
    labels: dict[int, str] = schemas.DETECTION_LABELS,
    profile: pixels.Profile = pixels.BINARIZED,
    batch_size: int = 8,
    decode: Callable | None = None,
) -> None:
    """Page images (``file_path``, ``image``) to stored results, one partition per run, in one pass.

    Images that do not decode are stored with a null list instead of stopping the run. With
    ``decode`` the column holds encoded files, such as the table that ``paginate`` writes.
    """
    raw = D.run_model(images, make_model, len(labels), profile, batch_size, decode=decode)
    out_tables.write_run(D.page_results(raw, labels), f"{out}/results", run_id)


def annotate(results: DataFrame, folder: str) -> DataFrame:
    """What to draw on which output image."""
    return RES.overlay_rects(RES.with_output_path(RES.annotated_pages(results), folder))


def record_tables(
    images: DataFrame,
    make_model: Callable[[], Callable],
    encode: Callable[[np.ndarray], bytes],
    crop_folder: str,
    out: str,
    run_id: str,
    labels: dict[int, str] = schemas.DETECTION_LABELS,
    profile: pixels.Profile = pixels.BINARIZED,
    min_score: float | None = None,
    resume: bool = False,
) -> None:
    """Detect, crop, and record documents and tables, which are read with ``sinks.runs.read_runs`` and
    become visible together.

    Each image stays in its row from the model to the crop, so pixels are never joined or shuffled.
    ``images`` has ``file_path`` and ``image``; ``encode`` gets the pixels of a crop, in RGB order.
    A score limit is the model's business: there is none unless ``min_score`` is given.
    """
    parts = P.with_page_parts(images, "file_path").withColumn("file_name", F.concat("doc", F.lit(".pdf")))
    raw = D.run_model(parts, make_model, len(labels), profile, keep_image=True)
    found = D.page_results(raw, labels, min_score)
    crops = I.encoded(RES.page_crops(found, crop_folder), encode)
    made = _stored(crops, f"{out}/crops/run_id={run_id}", resume)
    whole = made.withColumn("name", paths.file_name(F.col("image_path")))
    _stored(out_files.write_files(whole, crop_folder, "name", "content"), f"{out}/crop_files/run_id={run_id}", resume)

    # Tables per document come from the stored crops, pages from the image list: no second inference.
    pages = parts.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_pages"))
    tables = made.groupBy("file_name").agg(F.count(F.lit(1)).alias("table_count"))
    documents = pages.join(tables, "file_name", "left").select(
        F.col("file_name").alias("filename"), "n_pages", F.coalesce("table_count", F.lit(0).cast("bigint")).alias("table_count")
    )
    out_runs.write_run(images.sparkSession, out, run_id, {"tables": RES.tables_table(made), "documents": documents})
