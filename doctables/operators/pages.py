"""Page plans, rendering and page bookkeeping.

A document codec is not part of the library: ``count_pages(bytes) -> int`` and
``render(bytes, first, last, dpi) -> iterable of (page_num, png bytes or None)`` are given by the
caller and run inside Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctables.functions import paths
from doctables.functions.batches import batched

Render = Callable[[bytes, int, int, int], Iterable[tuple[int, bytes | None]]]


def page_counts(docs: DataFrame, count_pages: Callable[[bytes], int], content: str = "content") -> DataFrame:
    """Replace the document bytes by ``n_pages``, ``status`` and ``reason``; one bad file is one row."""
    result = T.StructType(
        [T.StructField("n_pages", T.IntegerType()), T.StructField("reason", T.StringType())]
    )

    def one(data: bytes) -> tuple[int | None, str | None]:
        try:
            return int(count_pages(data)), None
        except Exception as e:  # noqa: BLE001 - any codec error becomes a quarantine row
            return None, f"{type(e).__name__}: {e}"

    @F.pandas_udf(result)
    def counted(data: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([one(d) for d in data], columns=["n_pages", "reason"])
        return rows.astype({"n_pages": "Int32", "reason": object})

    keys = [c for c in docs.columns if c != content]
    # Marked so that the optimizer never copies the call into a filter and opens a file twice.
    counted = counted.asNondeterministic()
    rows = docs.select(*keys, counted(F.col(content)).alias("_r"))
    status = F.when(F.col("_r.reason").isNull(), "ok").otherwise("error")
    return rows.select(*keys, "_r.n_pages", status.alias("status"), "_r.reason")


def listed_page_counts(pages: DataFrame, doc: str = "doc") -> DataFrame:
    """Pages per document from a listing of one row per page."""
    return pages.groupBy(doc).agg(F.count(F.lit(1)).alias("n_pages"))


def page_range(docs: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """One row per page to convert. A bound of 0 or None is not given; both bounds are inclusive.

    Pages past the end of the document do not exist and are left out. A start without an end runs
    through the last page.
    """
    first = F.lit(start or 1)
    last = F.least(F.lit(end), F.col("n_pages")) if end else F.col("n_pages")
    return docs.filter(first <= last).withColumn("page_num", F.explode(F.sequence(first, last)))


def page_batches(docs: DataFrame, size: int = 10) -> DataFrame:
    """``first_page`` and ``last_page`` of consecutive batches that cover each page once."""
    starts = F.sequence(F.lit(1), F.col("n_pages"), F.lit(size))
    rows = docs.filter("n_pages >= 1").withColumn("first_page", F.explode(starts))
    return rows.withColumn("last_page", F.least(F.col("first_page") + size - 1, F.col("n_pages")))


def flatten_batches(batches: DataFrame, pages: str) -> DataFrame:
    """One row per page result from rows that hold a batch's list."""
    keys = [c for c in batches.columns if c != pages]
    return batches.select(*keys, F.explode(pages).alias("page"))


def with_page_path(pages: DataFrame, folder: str, doc: str = "doc_path") -> DataFrame:
    return pages.withColumn("image_path", paths.page_image_path(F.lit(folder), F.col(doc), F.col("page_num")))


def with_page_parts(images: DataFrame, path: str = "image_path") -> DataFrame:
    doc, page = paths.page_of(F.col(path))
    return images.withColumns({"file_name": paths.file_name(F.col(path)), "doc": doc, "page_num": page})


_RENDERED = [
    T.StructField("page_num", T.IntegerType()),
    T.StructField("image", T.BinaryType()),
    T.StructField("status", T.StringType()),
    T.StructField("reason", T.StringType()),
]


def _render(render: Render, data: Callable[[], bytes], first: int, last: int, dpi: int) -> Iterator[tuple]:
    """One row per page of the batch. Where the batch breaks off, the rest goes page by page, so that
    only the pages at fault are errors."""
    left = dict.fromkeys(range(first, last + 1))
    try:
        document = data()
    except Exception as e:  # noqa: BLE001 - recorded per page, the job goes on
        yield from ((n, None, "error", f"{type(e).__name__}: {e}") for n in left)
        return
    try:
        for number, image in render(document, first, last, dpi):
            if number in left:
                del left[number]
                yield number, image, "ok" if image else "empty", None
    except Exception:  # noqa: BLE001 - told apart below
        pass
    for n in left:
        try:
            images = [image for number, image in render(document, n, n, dpi) if number == n]
        except Exception as e:  # noqa: BLE001 - recorded, the next page is tried
            yield n, None, "error", f"{type(e).__name__}: {e}"
        else:
            image = images[0] if images else None
            yield n, image, "ok" if image else "empty", None


def _rendered(plan: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], Iterator[tuple]]) -> DataFrame:
    schema = T.StructType([plan.schema[k] for k in keys] + _RENDERED)
    image_at = len(keys) + 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for frame in frames for row in work(frame))
        yield from batched(rows, schema.names, lambda row: len(row[image_at] or b""))

    return plan.mapInPandas(run, schema)


def _runs(pages: list[int]) -> list[tuple[int, int]]:
    """First and last of each run of following numbers."""
    runs: list[tuple[int, int]] = []
    for n in pages:
        if runs and n == runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], n)
        else:
            runs.append((n, n))
    return runs


def render_batches(
    batches: DataFrame, render: Render, read: Callable[[str], bytes], tasks: int, dpi: int = 300
) -> DataFrame:
    """Render page batches whose documents are read by path inside the task.

    Only the plan rows are shuffled, spread by (document, batch), so a long document is many
    tasks. ``tasks`` is explicit: plan rows are tiny and AQE would merge them into one partition.
    Every planned page gives one row: of ``first_page`` to ``last_page``, or of the list ``pages``
    where there is one. A page that fails is an error row, the others of its batch go on.
    """
    listed = F.col("pages") if "pages" in batches.columns else F.sequence("first_page", "last_page")
    plan = batches.select("doc_path", F.array_sort(listed).alias("pages"))
    plan = plan.repartition(tasks, "doc_path", F.col("pages")[0])

    def work(frame: pd.DataFrame) -> Iterator[tuple]:
        for path, pages in frame.itertuples(index=False):
            for first, last in _runs([int(n) for n in pages]):
                for row in _render(render, lambda: read(path), first, last, dpi):
                    yield (path, *row)

    return _rendered(plan, ["doc_path"], work)


def render_documents(
    docs: DataFrame, render: Render, dpi: int = 300, batch_size: int = 10, content: str = "content"
) -> DataFrame:
    """Render documents whose bytes are a column, where they are: no shuffle, no copies of the bytes.

    ``docs`` holds ``doc_path``, ``n_pages`` and the bytes. Pages come batch by batch, so a task
    never holds a whole document's images.
    """
    plan = docs.select("doc_path", "n_pages", content)

    def work(frame: pd.DataFrame) -> Iterator[tuple]:
        for path, n_pages, data in frame.itertuples(index=False):
            for first in range(1, int(n_pages) + 1, batch_size):
                last = min(first + batch_size - 1, int(n_pages))
                for row in _render(render, lambda: data, first, last, dpi):
                    yield (path, *row)

    return _rendered(plan, ["doc_path"], work)


def drop_empty_pages(pages: DataFrame, image: str = "image") -> DataFrame:
    return pages.filter(F.col(image).isNotNull() & F.col("image_path").isNotNull())


def pending_pages(pages: DataFrame, done: DataFrame, overwrite: bool = False) -> DataFrame:
    """Pages still to be made. ``done`` is any frame of ``image_path``: a manifest or a listing, whose
    paths may have a scheme.

    Where both sides are tables of ``sinks.tables.write_manifest``, their buckets meet as they lie: no
    shuffle, and sorted buckets of one file are not sorted again.
    """
    if overwrite:
        return pages
    if "canonical_path" in pages.columns and "canonical_path" in done.columns:
        return pages.join(done.select("canonical_path"), "canonical_path", "left_anti").select(*pages.columns)
    there = done.select(paths.canonical_path(F.col("image_path"), False).alias("_path")).distinct()
    keyed = pages.withColumn("_path", paths.canonical_path(F.col("image_path"), False))
    return keyed.join(there, "_path", "left_anti").drop("_path")


def with_preview_size(images: DataFrame, scale: float = 0.4) -> DataFrame:
    """Scaled size of images or crops, truncated to whole pixels."""

    def side(c: str) -> Column:
        return (F.lit(scale) * F.col(c)).cast("int")

    return images.withColumns({"preview_w": side("width"), "preview_h": side("height")})


def page_preview(pages: DataFrame, num: int = 1, scale: float = 0.25) -> DataFrame:
    """The n-th page (from 1) of every document with its preview size."""
    return with_preview_size(pages.filter(F.col("page_num") == num), scale)


def quarantine(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("status") == "error")


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Keep rendered pages on executor disks while they are used more than once, then free them.

    Lost blocks are rendered again from the plan.
    """
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        yield held
    finally:
        held.unpersist()
