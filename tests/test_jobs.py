"""The four jobs end to end with stand-in client, codec and model."""

import os
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from doctables import schemas
from doctables.functions import pixels
from pngs import encode_png
from doctables.operators import results as RES
from doctables.plans import jobs
from doctables.sinks import runs
from doctables.sources import tables as sources

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINK = '<a class="usa-link Document" href="{}">x</a>'
# Ten bytes of text per page.
BODIES = {"http://s/1.pdf": b"a" * 25, "http://s/2b.pdf": b"b" * 120, "http://s/3.pdf": b"bad"}


def fetch(url: str) -> bytes:
    return BODIES[url]


def count(data: bytes) -> int:
    if data.startswith(b"bad"):
        raise ValueError("broken file")
    return -(-len(data) // 10)


def render(data: bytes, first: int, last: int, dpi: int):
    for n in range(first, last + 1):
        shade = 20 * (n % 10)
        img = np.full((40, 30), 255, np.uint8)
        img[10:20, 5:25] = shade
        yield n, encode_png(img)


def read(path: str) -> bytes:
    with open(path.removeprefix("file:"), "rb") as f:
        return f.read()


def make_model():
    """A table on pages with a block darker than the mean, else nothing."""

    def model(tensors):
        dark = np.array([float(t.min() < 0) for t in tensors])
        logits = np.stack([np.stack([dark * 9, dark * 0, 5 - dark * 5], 1)], 1)
        box = np.array([[15 / 30, 15 / 40, 20 / 30, 10 / 40]])
        return logits, np.tile(box[None], (len(tensors), 1, 1))

    return model


def test_acquire_and_verify(spark, folder):
    pages = spark.createDataFrame(
        [
            ("http://s/p1", LINK.format("/1.pdf")),
            # The last link of this page is dead, so the one before is taken.
            ("http://s/p2", LINK.format("2a.pdf") + LINK.format("2b.pdf") + LINK.format("2c.pdf")),
            ("http://s/p3", LINK.format("dead.pdf")),
        ],
        "url STRING, html STRING",
    )
    catalog = spark.createDataFrame(
        [(1, "http://s/p1"), (2, "http://s/p2"), (3, "http://s/p3"), (4, "http://s/nopage")], "publication_id LONG, url STRING"
    )
    pdfs = f"{folder}/pdfs"
    log = jobs.acquire(catalog, pages, fetch, pdfs, f"{folder}/work", tasks=3)
    assert sorted((r.publication_id, r.status, r.attempt) for r in log.collect()) == [
        (1, "ok", 1), (2, "error", 1), (2, "ok", 2), (3, "error", 1)]
    assert sorted(os.listdir(pdfs)) == ["1.pdf", "2.pdf"]
    assert open(f"{pdfs}/2.pdf", "rb").read() == BODIES["http://s/2b.pdf"]
    (row,) = jobs.verify(spark, catalog, pdfs, f"{folder}/missing").collect()
    assert (row.file_ratio, row.coverage) == (0.5, 0.5)
    assert sorted(r[0] for r in sources.read_missing_lines(spark, f"{folder}/missing").collect()) == [3, 4]


def test_pages_detection_and_tables(spark, folder):
    pdfs, images = f"{folder}/pdfs", f"{folder}/images"
    os.makedirs(pdfs)
    for name, data in {"Doe, 1910.pdf": b"a" * 25, "long.pdf": b"b" * 125, "bad.pdf": b"bad"}.items():
        with open(f"{pdfs}/{name}", "wb") as f:
            f.write(data)

    def paginate(work, done=None):
        return jobs.paginate(spark, pdfs, images, count, render, read, 4, f"{folder}/{work}", done=done)

    log = paginate("w1")
    assert sorted((r.status, r["count"]) for r in log.groupBy("status").count().collect()) == [("error", 1), ("ok", 16)]
    assert len(os.listdir(images)) == 16 and "Doe, 1910_page_3.png" in os.listdir(images)
    # A second run with a manifest of all but two pages makes those two.
    done = log.filter("status = 'ok' AND image_path NOT LIKE '%long_page_1_.png'")
    again = paginate("w2", done.unionByName(log.filter("image_path LIKE '%page_12.png'")))
    assert sorted(r.page_num for r in again.filter("status = 'ok'").collect()) == [10, 11, 13]
    # A listing of the folder is as good as a manifest, and a catalog leaves other files out.
    listed = sources.list_files(spark, images).select(F.col("path").alias("image_path"))
    assert paginate("w3", listed).filter("status = 'ok'").count() == 0
    none = jobs.paginate(spark, pdfs, images, count, render, read, 4, f"{folder}/w4", catalog=spark.range(3).withColumnRenamed("id", "publication_id"))
    assert none.count() == 0

    with open(f"{images}/junk_page_1.png", "wb") as f:
        f.write(b"no image")
    profile = pixels.Profile(binarize=False, max_size=40)
    decoded = sources.read_images(spark, images)
    out = f"{folder}/out"
    for _ in range(2):
        jobs.detect_tables(decoded, make_model, out, "r1", profile=profile)
    results = spark.read.parquet(f"{out}/results")
    assert results.count() == 17
    assert [r.file_path.split("/")[-1] for r in RES.unreadable(results).collect()] == ["junk_page_1.png"]
    found = results.select(F.explode("detections").alias("d")).collect()
    assert len(found) == 13 and np.allclose(found[0].d.bbox, [5.0, 10.0, 25.0, 20.0])

    spec = jobs.annotate(results.filter("file_path LIKE '%Doe%'"), "drawn")
    assert spec.count() == 9 and {r.out_path for r in spec.collect()} == {f"drawn/Doe, 1910_page_{n}.png" for n in (1, 2, 3)}

    crops = f"{folder}/crops"
    for _ in range(2):
        jobs.record_tables(decoded, make_model, encode_png, crops, out, "r1", profile=profile)
    recorded = runs.read_runs(spark, out, "documents", schemas.DOCUMENTS_TABLE)
    documents = {r.filename: (r.n_pages, r.table_count) for r in recorded.collect()}
    assert documents == {"Doe, 1910.pdf": (3, 3), "long.pdf": (13, 10), "junk.pdf": (1, 0)}
    tables = runs.read_runs(spark, out, "tables", schemas.TABLES_TABLE)
    assert tables.count() == 13
    cut = {r.file_path.split("/")[-1]: r.image for r in sources.read_images(spark, crops).collect()}
    img = cut["long.pdf_page_13_table_0.png"]
    assert (img.width, img.height) == (20, 10) and set(bytes(img.data)) == {60}
