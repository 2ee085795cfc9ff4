"""Polite requests, listings by tasks, and stored tables: layout, buckets, commits, the array file."""

import json
import os
import random
import threading
import time
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from doctables import schemas
from doctables.functions.polite import Politeness, in_order
from doctables.operators import fetch as FE
from doctables.operators import pages as P
from doctables.operators import results as RES
from doctables.session import checkpoint_folder
from doctables.sinks import runs
from doctables.sinks import tables as sinks
from doctables.sources import tables as sources


class Host:
    """Counts requests that are under way at once."""

    def __init__(self, seconds=0.005):
        self.now, self.most, self.starts, self.lock, self.seconds = Counter(), Counter(), {}, threading.Lock(), seconds

    def __call__(self, row):
        host = row[0]
        with self.lock:
            for k in (host, "all"):
                self.now[k] += 1
                self.most[k] = max(self.most[k], self.now[k])
            self.starts.setdefault(host, []).append(time.monotonic())
        time.sleep(self.seconds * random.Random(row[1]).random() * 2)
        with self.lock:
            for k in (host, "all"):
                self.now[k] -= 1
        return row[1], row[1] % 3 == 0


def test_requests_overlap_within_their_bounds_and_keep_their_order():
    rows = [(f"h{i % 5 if i % 2 else 0}", i) for i in range(300)]
    work = Host()
    out = list(in_order(rows, lambda r: r[0], work, Politeness(in_flight=6, per_host=2, window=24)))
    assert [r for r, _ in out] == rows and [v for _, (v, _) in out] == list(range(300))
    assert 3 <= work.most["all"] <= 6 and max(n for h, n in work.most.items() if h != "all") == 2


def test_one_at_a_time_and_pauses():
    work = Host()
    assert len(list(in_order([("h", i) for i in range(20)], lambda r: r[0], work, Politeness(in_flight=1)))) == 20
    assert work.most["all"] == 1
    work = Host(0)
    list(in_order([("h", i) for i in range(5)] + [("o", 9)], lambda r: r[0], work, Politeness(pause=0.05)))
    gaps = [b - a for a, b in zip(work.starts["h"], work.starts["h"][1:])]
    assert min(gaps) >= 0.045 and work.starts["o"][0] - work.starts["h"][0] < 0.045


@pytest.mark.parametrize("polite", [Politeness(1), Politeness(8, 8, 0, 7), Politeness(3, 1, 0, 500)])
def test_chains_stop_at_their_first_success(polite):
    rng = random.Random(polite.window)
    rows = [(f"h{c % 3}", c * 100 + i, c) for c in range(60) for i in range(rng.randint(1, 12))]
    started = []

    def work(row):
        started.append(row[1])
        time.sleep(0.0005)
        return (row[1] * 7919 % 4 == 0,)

    want, over = [], set()
    for row in rows:
        if row[2] not in over:
            want.append(row)
            if row[1] * 7919 % 4 == 0:
                over.add(row[2])
    out = list(in_order(rows, lambda r: r[0], work, polite, lambda r: r[2], lambda r: r[0]))
    # Nothing beyond a success is ever requested.
    assert [r for r, _ in out] == want and sorted(started) == sorted(r[1] for r in want)


def test_fetching_side_by_side_gives_the_same_rows(spark):
    plan = spark.range(500).select(F.concat(F.lit("http://h"), F.col("id") % 7, F.lit("/"), "id").alias("link_url"), "id")

    def fetch(url):
        if url.endswith("3"):
            raise OSError("404")
        return url.encode()

    one, many = (sorted(FE.fetch_documents(plan, fetch, 3, polite=Politeness(n)).collect()) if n == 1 else
                 sorted(FE.fetch_documents(plan, fetch, 3).collect()) for n in (1, 8))
    assert one == many and len(one) == 500


def test_tree_listing_equals_sparks(spark, folder):
    rng = random.Random(4)
    for i in range(120):
        path = f"{folder}/top/" + "/".join(f"d {rng.randint(0, 3)}" for _ in range(rng.randint(0, 5)))
        os.makedirs(path, exist_ok=True)
        for name in (f"Doe, {i}.pdf", f"n{i}.txt", f".hidden{i}", f"_part{i}", f"a%20b+{i}.pdf"):
            with open(f"{path}/{name}", "w") as f:
                f.write("x" * rng.randint(1, 9))
    os.makedirs(f"{folder}/top/_temporary")
    with open(f"{folder}/top/_temporary/in.pdf", "w") as f:
        f.write("x")
    for k, suffix in enumerate((None, ".pdf")):
        listed = sources.list_tree(spark, f"{folder}/top", f"{folder}/work{k}", suffix)
        want = sources.list_files(spark, f"{folder}/top", suffix, recursive=True)
        assert sorted(listed.collect()) == sorted(want.collect()) and listed.count() > 200
    os.makedirs(f"{folder}/empty")
    assert sources.list_tree(spark, f"{folder}/empty", f"{folder}/work9").count() == 0
    # Files without bytes are files.
    open(f"{folder}/empty/z.pdf", "w").close()
    assert [r.n_bytes for r in sources.list_tree(spark, f"{folder}/empty", f"{folder}/work10").collect()] == [0]


def test_lookup_reads_few_row_groups(spark, folder):
    rows = spark.range(60_000).select(
        F.concat(F.lit("out/Doc, "), F.xxhash64("id").cast("string"), F.lit("_page_1.png")).alias("file_path"),
        F.col("id").alias("row_idx"), F.expr(f"cast(array() AS {schemas.DETECTIONS})").alias("detections"),
        F.sha2(F.col("id").cast("string"), 512).alias("more"),
    )
    twice = rows.unionByName(rows.filter("row_idx = 777").withColumn("row_idx", F.lit(70_000).cast("long")))
    sinks.write_lookup(twice.repartition(4), f"{folder}/t", group_bytes=256 * 1024)
    stored = spark.read.parquet(f"{folder}/t")
    path = rows.filter("row_idx = 777").first().file_path
    (found,) = RES.lookup_by_path(stored, path).collect()
    assert (found.row_idx, found.file_path) == (777, path)
    groups = hit = 0
    for name in os.listdir(f"{folder}/t"):
        if name.endswith(".parquet"):
            meta = pq.ParquetFile(f"{folder}/t/{name}").metadata
            at = meta.schema.names.index("file_path")
            for g in range(meta.num_row_groups):
                stats = meta.row_group(g).column(at).statistics
                groups += 1
                hit += stats.min <= path <= stats.max
    assert groups >= 16 and hit <= 2
    # A path between those of a group is excluded by its Bloom filter: no row leaves the scan.
    def scanned(p):
        df = stored.filter(F.col("file_path") == p)
        df.collect()
        nodes = [df._jdf.queryExecution().executedPlan()]
        while nodes:
            node = nodes.pop()
            if "Scan" in node.nodeName():
                return node.metrics().apply("numOutputRows").value()
            if "AdaptiveSparkPlan" in node.nodeName():
                nodes.append(node.executedPlan())
            nodes += [node.children().apply(i) for i in range(node.children().size())]

    assert 0 < scanned(path) <= 60_001 / 8
    assert scanned(path[:-6] + "9.png") == 0


def test_manifests_meet_without_a_shuffle(spark, folder):
    pages = spark.range(3_000).select(F.concat(F.lit("/out/a b_page_"), "id", F.lit(".png")).alias("image_path"), "id")
    done = pages.filter("id % 4 = 0").select(F.concat(F.lit("file://"), "image_path").alias("image_path"))
    done = done.unionByName(done)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sinks.write_manifest(pages, "plan_of_pages", f"{folder}/plan", 5)
        there = sinks.write_manifest(done, "done_pages", f"{folder}/done", 5)
        left = P.pending_pages(plan, there)
        shown = left._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in shown and "SortMergeJoin" in shown
        want = P.pending_pages(pages, done)
        assert "Exchange" in want._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.id for r in left.collect()) == sorted(r.id for r in want.collect()) == [i for i in range(3_000) if i % 4]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.sql("DROP TABLE IF EXISTS plan_of_pages")
        spark.sql("DROP TABLE IF EXISTS done_pages")


def test_tables_of_a_run_become_visible_together(spark, folder):
    one, two = (spark.createDataFrame([(n, n)], "a INT, b INT") for n in (1, 2))
    broken = spark.range(1).select(F.raise_error(F.lit("stopped")).cast("int").alias("a"))

    def read(name):
        return sorted((r.run_id, r.a, r.b) for r in runs.read_runs(spark, folder, name, "a INT, b INT").collect())

    assert read("documents") == []
    with pytest.raises(Exception, match="stopped"):
        runs.write_run(spark, folder, "r1", {"documents": one, "tables": broken})
    assert read("documents") == read("tables") == [] and len(runs.stale_attempts(spark, folder, "documents")) == 1
    runs.write_run(spark, folder, "r1", {"documents": one, "tables": one})
    runs.write_run(spark, folder, "r2", {"documents": one, "tables": one})
    with pytest.raises(Exception, match="stopped"):
        runs.write_run(spark, folder, "r1", {"documents": two, "tables": broken})
    assert read("documents") == read("tables") == [("r1", 1, 1), ("r2", 1, 1)]
    runs.write_run(spark, folder, "r1", {"documents": two, "tables": two})
    assert read("documents") == read("tables") == [("r1", 2, 2), ("r2", 1, 1)]
    assert len(runs.stale_attempts(spark, folder, "documents")) == 3


@pytest.mark.parametrize("n", [0, 1, 7, 4_000])
def test_parts_are_one_array(spark, folder, n):
    ids = spark.range(n).select(F.col("id").alias("publication_id"))
    # Rows in few of the tasks, a repeated id, and more tasks than rows.
    sinks.write_missing_array(ids.union(ids.filter("publication_id = 0")).repartition(9), f"{folder}/a", f"{folder}/w")
    parts = sorted(p for p in os.listdir(f"{folder}/a") if p.startswith("part-"))
    text = "".join(open(f"{folder}/a/{p}").read() for p in parts)
    want = sorted(list(range(n)) + [0] * (n > 0))
    assert sorted(json.loads(text)) == want
    os.makedirs(f"{folder}/whole")
    with open(f"{folder}/whole/file.json", "w") as f:
        f.write(text)
    back = [sources.read_missing_ids(spark, f"{folder}/whole"), sinks.read_missing_array(spark, f"{folder}/a")]
    assert [sorted(r.publication_id for r in b.collect()) for b in back] == [want, want]
    assert n < 4_000 or len([p for p in parts if os.path.getsize(f"{folder}/a/{p}")]) > 1


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_folder(Session())
    assert checkpoint_folder(spark)
