"""Reconciliation and lookups, with keys that hold most rows."""

import pytest
from pyspark.sql import functions as F

from doctables.operators import fetch as FE
from doctables.operators import links as L
from doctables.operators import reconcile as R
from doctables.operators.lookup import MAX_HOT, hot_keys, lookup_join


@pytest.fixture
def skewed(spark):
    """A third of all rows under one key, another key with copies of one row, some null keys."""
    i = F.col("id")
    key = F.when(i % 3 == 0, 7).when(i % 10 == 1, 8).when(i % 97 == 2, None).otherwise(i)
    return spark.range(9000).select(key.cast("long").alias("k"), F.when(i % 10 == 1, 0).otherwise(i).alias("v"))


def test_hot_keys_are_bounded(skewed):
    assert set(hot_keys(skewed, "k", 1)) == {7, 8}
    assert hot_keys(skewed, "k", 10_000) == []
    even = skewed.sparkSession.range(1000).select((F.col("id") % 5).alias("k"))
    assert sorted(hot_keys(even, "k", 1)) == [0, 1, 2, 3, 4] and len(hot_keys(even, "k", 1)) <= MAX_HOT
    names = even.select(F.when(F.col("k") > 1, F.concat(F.lit("n"), "k")).alias("a b"))
    assert sorted(hot_keys(names, "a b", 1), key=str) == [None, "n2", "n3", "n4"]
    assert hot_keys(names.limit(0), "a b", 1) == []


def test_no_hot_key_is_missed(spark):
    """One key just above the share, among many distinct ones."""
    i = F.col("id")
    df = spark.range(0, 300_000, 1, 8).select(F.when(i % 120 == 0, -1).otherwise(i).alias("k"))
    assert hot_keys(df, "k", 1) == [-1]
    assert hot_keys(df.repartition(50), "k", 1) == [-1]


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_lookup_join_equals_the_plain_join(spark, skewed, how, threshold):
    right = spark.range(0, 9000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("r"))
    right = right.unionByName(spark.createDataFrame([(7, 70)], "k LONG, r LONG"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = lookup_join(skewed, right, "k", how, min_rows=1, skew=True)
        want = skewed.join(right, "k", how)
        cols = want.columns
        assert got.select(cols).exceptAll(want).isEmpty() and want.exceptAll(got.select(cols)).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


def test_hot_rows_spread_over_partitions(spark, skewed):
    right = spark.createDataFrame([(7, 70)], "k LONG, r LONG")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = lookup_join(skewed, right, "k", "inner", min_rows=1, skew=True)
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 3001 and len(sizes) > 1 and max(sizes) < 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_copies_of_one_row_spread(spark):
    copies = spark.range(0, 3000, 1, 6).select(F.lit(7).cast("long").alias("k"), F.lit("same").alias("v"))
    right = spark.createDataFrame([(7, 70)], "k LONG, r LONG")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = lookup_join(copies, right, "k", "inner", min_rows=1, skew=True)
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 3000 and len(sizes) > 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_building_a_plan_runs_no_job(spark):
    catalog = spark.range(10).select(F.col("id").alias("publication_id"), F.concat(F.lit("http://s/"), "id").alias("url"))
    pages = catalog.select("url", F.lit("<a class='usa-link Document' href='/a'>").alias("html"))
    spark.sparkContext.setJobGroup("building", "plans")
    try:
        links = L.catalog_links(catalog, pages)
        L.download_plan_by_id(links), L.overwritten_links(links), L.download_plan_by_path(links)
        R.missing_rows(catalog, catalog.select("publication_id"))
        L.expected_files(catalog, catalog.select(F.col("url").alias("file_name")), "f")
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_reconciliation(spark):
    catalog = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d"), (3, "d")], "publication_id LONG, url STRING")
    files = spark.createDataFrame([("1.pdf",), ("3.pdf",), ("003.pdf",), ("9.pdf",), ("x.pdf",), (".pdf",), ("12",)], "file_name STRING")
    obtained = R.obtained_ids(files)
    assert sorted(r.publication_id for r in obtained.collect()) == [1, 3, 3, 9]
    assert sorted(r.file_name for r in R.obtained_rejects(files).collect()) == [".pdf", "12", "x.pdf"]
    found, missing = R.found_rows(catalog, obtained), R.missing_rows(catalog, obtained)
    assert sorted(r.url for r in found.collect()) == ["a", "d", "d"]
    assert sorted(r.url for r in missing.collect()) == ["b", "c"]
    assert found.unionAll(missing).exceptAll(catalog).isEmpty() and found.count() + missing.count() == 5
    (row,) = R.ratios(catalog, obtained).collect()
    assert (row.n_catalog, row.n_files, row.n_found) == (5, 4, 3)
    assert (row.file_ratio, row.coverage) == (0.8, 0.6)


def test_ratio_can_pass_one_and_survives_an_empty_catalog(spark):
    catalog = spark.createDataFrame([(1, "a")], "publication_id LONG, url STRING")
    obtained = spark.createDataFrame([(1,), (2,)], "publication_id LONG")
    assert R.ratios(catalog, obtained).first().file_ratio == 2.0
    assert R.ratios(catalog.limit(0), obtained).first().file_ratio is None


def test_fetching(spark):
    bodies = {"http://h/a": b"AA", "http://h/b": b""}

    def fetch(url):
        return bodies[url]

    plan = spark.createDataFrame([(1, "http://h/a"), (2, "http://h/b"), (3, "http://o/missing")], "publication_id LONG, link_url STRING")
    got = {r.publication_id: (r.content and bytes(r.content), r.n_bytes, r.status, r.reason) for r in FE.fetch_documents(plan, fetch, 4).collect()}
    assert got[1] == (b"AA", 2, "ok", None)
    assert got[2][1:] == (0, "ok", None)
    assert got[3] == (None, None, "error", "KeyError: 'http://o/missing'")


def test_one_host_is_spread_over_a_few_tasks(spark):
    plan = spark.range(400).select(F.concat(F.lit("http://one/"), "id").alias("link_url"))
    rows = FE.fetch_documents(plan, lambda u: b"x", tasks=16, tasks_per_host=4)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 400 and 2 <= len(sizes) <= 4


def test_fallback_gathers_no_links(spark):
    def fetch(url):
        raise OSError("404")

    links = spark.range(30_000).select((F.col("id") % 3 % 2).alias("publication_id"), F.col("id").cast("int").alias("link_pos"), F.concat(F.lit("http://h/"), F.col("id")).alias("link_url"))
    log = FE.fetch_with_fallback(L.candidate_links(links), fetch, tasks=2)
    assert "collect_list" not in log._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in log.select("publication_id", "attempt", "link_pos").collect():
        got.setdefault(r.publication_id, []).append((r.attempt, r.link_pos))
    for publication, tried in got.items():
        want = sorted((n for n in range(30_000) if n % 3 % 2 == publication), reverse=True)
        assert sorted(tried) == list(enumerate(want, 1))


def test_all_links_are_tried_from_the_last_on(spark):
    def fetch(url):
        if url.endswith("dead"):
            raise OSError("404")
        return url.encode()

    rows = [(1, n, f"http://h/{n}{'' if n == 0 else 'dead'}") for n in range(6)] + [(2, 0, "http://h/x"), (2, 1, "http://h/y"), (3, 0, "http://h/dead")]
    links = spark.createDataFrame(rows, "publication_id LONG, link_pos INT, link_url STRING")
    log = FE.fetch_with_fallback(L.download_candidates(links), fetch, tasks=2).collect()
    got = {}
    for r in sorted(log, key=lambda r: (r.publication_id, r.attempt)):
        got.setdefault(r.publication_id, []).append((r.attempt, r.link_pos, r.status, r.content and bytes(r.content)))
    assert got[1] == [(i + 1, 5 - i, "error", None) for i in range(5)] + [(6, 0, "ok", b"http://h/0")]
    assert got[2] == [(1, 1, "ok", b"http://h/y")] and got[3] == [(1, 0, "error", None)]
    assert {r.file_path for r in log} == {"1.pdf", "2.pdf", "3.pdf"}
