"""Page plans, rendering with a stand-in codec, files, sources and bookkeeping."""

import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from doctables.functions import paths
from doctables.operators import pages as P
from doctables.sinks import files, tables
from doctables.sources import tables as sources

# The stand-in codec travels with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def count(data: bytes) -> int:
    if data.startswith(b"bad"):
        raise ValueError("broken file")
    return len(data) // 10


def render(data: bytes, first: int, last: int, dpi: int):
    if data.startswith(b"bad"):
        raise ValueError("broken file")
    for n in range(first, last + 1):
        piece = data[10 * (n - 1) : 10 * n]
        yield n, None if piece == b"-" * 10 else piece + str(dpi).encode()


def test_page_range_modes(spark):
    docs = spark.createDataFrame([("a", 16), ("b", 1), ("c", 0)], "doc STRING, n_pages INT")

    def got(*bounds):
        rows = P.page_range(docs, *bounds).groupBy("doc").agg(F.array_sort(F.collect_list("page_num")).alias("p"))
        return {r.doc: r.p for r in rows.collect()}

    assert got(3, 5) == {"a": [3, 4, 5]}
    assert got(15) == {"a": [15, 16]}
    assert got(None, 2) == {"a": [1, 2], "b": [1]}
    assert got(0, 0) == got() == {"a": list(range(1, 17)), "b": [1]}
    assert got(15, 40) == {"a": [15, 16]}


@pytest.mark.parametrize("size", [1, 3, 10, 100])
def test_batches_cover_every_page_once(spark, size):
    docs = spark.createDataFrame([(n,) for n in range(0, 35)], "n_pages INT")
    rows = P.page_batches(docs, size).collect()
    for n in range(0, 35):
        covered = [p for r in rows if r.n_pages == n for p in range(r.first_page, r.last_page + 1)]
        assert sorted(covered) == list(range(1, n + 1))
        assert all(r.last_page - r.first_page < size for r in rows)


@pytest.mark.parametrize("path", [
    "in/a.pdf", "a.b.pdf", "in/.pdf", "x/no_ext", "Doe, 1910.pdf", "in.d/..pdf", "a_page_2.pdf", "in/a.", "ä b+%20.pdf",
])
def test_page_paths(spark, path):
    base = os.path.splitext(os.path.basename(path))[0]
    df = spark.createDataFrame([(path, 12)], "doc_path STRING, page_num INT")
    for folder in ("out", "out/", ""):
        (row,) = P.with_page_path(df, folder).collect()
        assert row.image_path == os.path.join(folder, f"{base}_page_12.png")
        (back,) = P.with_page_parts(spark.createDataFrame([row]).select("image_path")).collect()
        assert (back.doc, back.page_num) == (base, 12)


def test_names_that_are_no_pages(spark):
    df = spark.createDataFrame([("a.png",), ("a_page_x.png",), ("a_page_1.jpg",)], "image_path STRING")
    assert all(r.doc is None and r.page_num is None for r in P.with_page_parts(df).collect())


def test_counting_and_rendering(spark, folder):
    docs = {"a.pdf": b"x" * 250, "b.pdf": b"y" * 20 + b"-" * 10 + b"z" * 10, "bad.pdf": b"bad file"}
    for name, data in docs.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    read = sources.read_documents(spark, folder)
    counted = P.page_counts(read, count)
    got = {r.doc_path.split("/")[-1]: (r.n_pages, r.status, r.reason) for r in counted.collect()}
    assert got == {"a.pdf": (25, "ok", None), "b.pdf": (4, "ok", None), "bad.pdf": (None, "error", "ValueError: broken file")}
    assert P.quarantine(counted).count() == 1

    plan = P.page_batches(counted.filter("status = 'ok'"))
    rendered = P.render_batches(plan, render, lambda path: open(path.removeprefix("file:"), "rb").read(), tasks=3, dpi=200)
    pages = P.with_page_path(rendered, "out")
    here = {(r.image_path, bytes(r.image) if r.image else None, r.status) for r in pages.collect()}
    assert len(here) == 29
    assert ("out/b_page_3.png", None, "empty") in here and ("out/a_page_25.png", b"x" * 10 + b"200", "ok") in here
    assert P.drop_empty_pages(pages).count() == 28

    with_bytes = read.join(counted.filter("status = 'ok'"), "doc_path").select("doc_path", "n_pages", "content")
    again = P.with_page_path(P.render_documents(with_bytes, render, dpi=200), "out")
    assert {(r.image_path, bytes(r.image) if r.image else None, r.status) for r in again.collect()} == here

    all_docs = P.page_batches(read.select("doc_path", F.lit(1).alias("n_pages")))
    failed = P.render_batches(all_docs, render, lambda path: open(path.removeprefix("file:"), "rb").read(), tasks=2)
    assert [(r.doc_path.split("/")[-1], r.reason) for r in P.quarantine(failed).collect()] == [("bad.pdf", "ValueError: broken file")]


def test_a_page_that_fails_is_its_own_error_row(spark):
    def faulty(data, first, last, dpi):
        for n in range(first, last + 1):
            if n in (4, 7):
                raise ValueError("broken page")
            yield n, b"x"

    plan = spark.createDataFrame([("d", 1, 10)], "doc_path STRING, first_page INT, last_page INT")
    rows = P.render_batches(plan, faulty, lambda p: b"", tasks=1).collect()
    assert sorted((r.page_num, r.status) for r in rows) == [(n, "error" if n in (4, 7) else "ok") for n in range(1, 11)]
    some = spark.createDataFrame([("d", [9, 2, 3, 7])], "doc_path STRING, pages ARRAY<INT>")
    rows = P.render_batches(some, faulty, lambda p: b"", tasks=1).collect()
    assert sorted((r.page_num, r.status) for r in rows) == [(2, "ok"), (3, "ok"), (7, "error"), (9, "ok")]
    assert P._runs([2, 3, 5, 6, 7, 9]) == [(2, 3), (5, 7), (9, 9)]


def test_a_reader_that_fails_is_an_error_row_per_page(spark):
    plan = spark.createDataFrame([("/no/such", 1, 3)], "doc_path STRING, first_page INT, last_page INT")
    rows = P.render_batches(plan, render, lambda p: open(p, "rb").read(), tasks=1).collect()
    assert sorted(r.page_num for r in rows) == [1, 2, 3]
    assert all(r.status == "error" and r.reason.startswith("FileNotFoundError") for r in rows)


def test_pending_and_preview(spark):
    pages = spark.createDataFrame([("a", 1, 333, 100), ("b", 2, 7, 9)], "image_path STRING, page_num INT, width INT, height INT")
    done = spark.createDataFrame([("a",), ("z",)], "image_path STRING")
    assert [r.image_path for r in P.pending_pages(pages, done).collect()] == ["b"]
    assert P.pending_pages(pages, done, overwrite=True).count() == 2
    schemed = spark.createDataFrame([("file:///d/a",), ("file:/d/z",)], "image_path STRING")
    there = spark.createDataFrame([("/d/a",), ("file:/d/b",)], "image_path STRING")
    assert [r.image_path for r in P.pending_pages(there, schemed).collect()] == ["file:/d/b"]
    (row,) = P.page_preview(pages).collect()
    assert (row.preview_w, row.preview_h) == (83, 25)
    (row,) = P.page_preview(pages, 2, 0.4).collect()
    assert (row.preview_w, row.preview_h) == (2, 3)
    assert [(r.preview_w, r.preview_h) for r in P.with_preview_size(pages).orderBy("image_path").collect()] == [(133, 40), (2, 3)]


def test_kept_pages_are_freed(spark):
    df = spark.range(5)
    with P.kept(df) as held:
        assert held.count() == 5 and held.storageLevel.useDisk and not held.storageLevel.useMemory
    assert not df.storageLevel.useDisk


def test_listing(spark, folder):
    os.makedirs(f"{folder}/deep")
    for name in ("1.pdf", "2.PDF", "Sample 3.pdf", "sample_4.pdf", "a b,c%41+.pdf", "p.png", "deep/5.pdf"):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(b"abc")
    flat = sources.list_files(spark, folder, ".pdf")
    assert sorted(r.file_name for r in flat.collect()) == ["1.pdf", "Sample 3.pdf", "a b,c%41+.pdf", "sample_4.pdf"]
    assert {r.n_bytes for r in flat.collect()} == {3}
    assert sources.list_files(spark, folder, recursive=True).count() == 7
    assert sorted(r.file_name for r in sources.without_word(flat).collect()) == ["1.pdf", "a b,c%41+.pdf"]
    assert [r.file_name for r in sources.glob_files(spark, folder, "sample*.pdf").collect()] == ["sample_4.pdf"]
    assert sources.with_suffix(sources.list_files(spark, folder), ".PDF").count() == 1
    assert "content" not in flat._jdf.queryExecution().executedPlan().toString()


def test_canonical_paths_agree(spark):
    df = spark.createDataFrame([("file:/d/a b+c%41,é.png", "file:///d/a%20b+c%2541,%C3%A9.png")], "plain STRING, escaped STRING")
    (row,) = df.select(paths.canonical_path(F.col("plain"), False), paths.canonical_path(F.col("escaped"), True)).collect()
    assert row[0] == row[1] == "/d/a b+c%41,é.png"


def test_catalog_and_seed_sources(spark, folder):
    with open(f"{folder}/catalog.csv", "w") as f:
        f.write('Title,Publication ID,URL\n"A, b",12,http://s/1\n"x ""q""",n/a,http://s/2\nz,,http://s/3\n"two\nlines",13,http://s/4\nw,14,\n')
    raw = sources.read_catalog_csv(spark, f"{folder}/catalog.csv")
    assert [tuple(r) for r in sources.catalog_rows(raw).collect()] == [(12, "http://s/1", 0), (13, "http://s/4", 3)]
    assert sorted(r.URL or "" for r in sources.catalog_rejects(raw).collect()) == ["", "http://s/2", "http://s/3"]
    assert [tuple(r) for r in sources.seed_urls(spark, ["u", "v"]).collect()] == [(0, "u"), (1, "v")]


def test_landed_pages(spark, folder):
    df = spark.createDataFrame([("u", "<p>"), ("v", None)], "url STRING, html STRING")
    df.write.parquet(f"{folder}/pages")
    assert [r.url for r in sources.page_scan(sources.read_landed_pages(spark, f"{folder}/pages")).collect()] == ["u"]


def test_missing_ids_round_trips(spark, folder):
    missing = spark.createDataFrame([(88,), (7,), (70247399,), (7,)], "publication_id LONG")
    want = [7, 7, 88, 70247399]
    tables.write_missing_lines(missing, f"{folder}/lines")
    assert sorted(r[0] for r in sources.read_missing_lines(spark, f"{folder}/lines").collect()) == want
    with open(f"{folder}/own.json", "w") as f:
        f.write("[\n  88,\n  70247399\n]")
    assert sorted(r[0] for r in sources.read_missing_ids(spark, f"{folder}/own.json").collect()) == [88, 70247399]


def test_runs_replace_themselves(spark, folder):
    for run, rows in (("a", 2), ("b", 3), ("a", 1)):
        tables.write_run(spark.range(rows), f"{folder}/t", run)
    got = {r.run_id: r["count"] for r in spark.read.parquet(f"{folder}/t").groupBy("run_id").count().collect()}
    assert got == {"a": 1, "b": 3}


def test_files_are_written_once_and_stay_inside(spark, folder):
    rows = spark.createDataFrame([("d/1.pdf", b"one"), ("2.pdf", b"two"), ("../up.pdf", b"x"), ("none.pdf", None)], "p STRING, c BINARY")
    target = f"{folder}/files"
    done = {r.p: (r.n_bytes, r.status) for r in files.write_files(rows, target, "p", "c").collect()}
    assert done == {"d/1.pdf": (3, "written"), "2.pdf": (3, "written"), "../up.pdf": (1, "refused")}
    with open(f"{target}/2.pdf", "wb") as f:
        f.write(b"old")
    kept = {r.p: r.status for r in files.write_files(rows, target, "p", "c", overwrite=False).collect()}
    assert kept["2.pdf"] == "exists" and open(f"{target}/2.pdf", "rb").read() == b"old"
    files.write_files(rows, target, "p", "c").collect()
    assert open(f"{target}/2.pdf", "rb").read() == b"two"
    assert sorted(os.listdir(target)) == ["2.pdf", "d"]
    with pytest.raises(ValueError, match="mounted"):
        files.write_files(rows, "s3a://bucket/x", "p", "c")
    with pytest.raises(ValueError, match="mounted"):
        files.store_file("s3a://bucket/x/1.pdf", b"x", True)
