"""Post-processing edge cases, the model call, and stored results."""

import math
import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from doctables import schemas
from doctables.functions import pixels
from pngs import encode_png
from doctables.operators import detect as D
from doctables.operators import pages as P
from doctables.operators import results as RES
from doctables.sinks import tables as sinks
from doctables.sources import tables as sources

# The stand-in model and decoder travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RAW = "file_path STRING, logits ARRAY<ARRAY<DOUBLE>>, boxes ARRAY<ARRAY<DOUBLE>>, img_w INT, img_h INT"
BOX = [0.5, 0.5, 0.2, 0.4]


def raw(spark, *logits):
    return spark.createDataFrame([("p", [list(x) for x in logits], [BOX] * len(logits), 100, 200)], RAW)


def test_tie_goes_to_the_first_class_and_boxes_are_not_clipped(spark):
    df = spark.createDataFrame([("p", [[2.0, 2.0, 0.0]], [[0.0, 1.0, 0.5, 0.5]], 100, 200)], RAW)
    (row,) = D.detect_objects(df).collect()
    assert row.label == "table"
    assert row.score == pytest.approx(1 / (2 + math.exp(-2)))
    assert (row.x0, row.y0, row.x1, row.y1) == (-25.0, 150.0, 25.0, 250.0)


def test_large_logits_do_not_overflow(spark):
    (row,) = D.detect_objects(raw(spark, [1e4, -1e4, 0.0])).collect()
    assert row.score == 1.0


def test_softmax_sums_to_one(spark):
    rng = random.Random(1)
    many = [[rng.uniform(-30, 30) for _ in range(3)] for _ in range(200)]
    for r in D.softmax_scores(raw(spark, *many), 3).collect():
        assert sum(r.probs) == pytest.approx(1)
        assert max(r.probs) == pytest.approx(1 / sum(math.exp(x - max(r.logits)) for x in r.logits))


def test_pages_without_detections_keep_an_empty_list(spark):
    (row,) = D.page_results(raw(spark, [0.0, 0.0, 9.0])).collect()
    assert row.detections == []
    (row,) = D.page_results(spark.createDataFrame([("p", [], [], 1, 1)], RAW)).collect()
    assert row.detections == []
    assert D.detect_objects(raw(spark, [0.0, 0.0, 9.0])).count() == 0


def test_list_and_row_forms_agree(spark):
    rng = random.Random(2)
    rows = [
        (f"p{i}", [[rng.gauss(0, 3) for _ in range(3)] for _ in range(5)], [[rng.random() for _ in range(4)] for _ in range(5)], 170, 260)
        for i in range(50)
    ]
    df = spark.createDataFrame(rows, RAW)
    lists = D.flatten_detections(D.page_results(df)).select("file_path", "label", "score", "bbox").collect()
    flat = D.detect_objects(df).select("file_path", "label", "score", F.array("x0", "y0", "x1", "y1").alias("bbox")).collect()
    assert sorted(lists) == sorted(flat)


def test_unknown_class_id_is_an_error_row(spark):
    labels = {0: "table", 1: "table rotated"}
    df = raw(spark, [0.0, 0.0, 9.0], [5.0, 0.0, 0.0]).unionByName(raw(spark, [5.0, 0.0, 0.0]).withColumn("file_path", F.lit("q")))
    reason = "no label for class id 2"
    flat = D.detect_objects(df, labels).orderBy("file_path", "query_idx").collect()
    assert [(r.file_path, r.label, r.status, r.reason) for r in flat] == [
        ("p", None, "error", reason), ("p", "table", "ok", None), ("q", "table", "ok", None)]
    named = D.with_labels(D.best_classes(df, 2), labels)
    assert sorted((r.status, r.reason or "") for r in D.drop_no_object(named).collect()) == [("error", reason), ("ok", ""), ("ok", "")]
    pages = {r.file_path: r for r in D.page_results(df, labels).collect()}
    assert pages["p"].detections is None and (pages["p"].status, pages["p"].reason) == ("error", reason)
    assert len(pages["q"].detections) == 1 and pages["q"].status == "ok"
    assert [r.file_path for r in P.quarantine(D.page_results(df, labels)).collect()] == ["p"]


def test_no_object_is_appended_after_the_last_id():
    assert schemas.with_no_object({0: "table", 1: "table rotated"}) == schemas.DETECTION_LABELS


def _counting_model(calls):
    def make():
        def model(tensors):
            calls.add(len(tensors))
            mean = np.array([t.mean(dtype=np.float64) for t in tensors])
            logits = np.stack([np.stack([mean, -mean, mean * 0], 1)], 1)
            return logits, np.tile(np.array([[BOX]]), (len(tensors), 1, 1))

        return model

    return make


def images_folder(folder):
    rng = np.random.default_rng(5)
    made = {}
    for name, shape in (("Doe, 1910_page_1.png", (30, 20)), ("Doe, 1910_page_2.png", (12, 40, 3)), ("a+b%20c_page_1.png", (9, 9))):
        made[name] = rng.integers(0, 256, shape, dtype=np.uint8)
        with open(f"{folder}/{name}", "wb") as f:
            f.write(encode_png(made[name]))
    with open(f"{folder}/bad_page_1.png", "wb") as f:
        f.write(b"not an image")
    with open(f"{folder}/notes.txt", "w") as f:
        f.write("x")
    return made


def test_model_over_decoded_images(spark, folder):
    made = images_folder(folder)
    images = sources.read_images(spark, folder)
    assert images.count() == 4
    assert "ReadSchema: struct<>" in images.groupBy("file_path").count()._jdf.queryExecution().executedPlan().toString()
    profile = pixels.Profile(binarize=True, max_size=16)
    raw_rows = D.run_model(images, _counting_model(set()), 3, profile, batch_size=2)
    got = {r.file_path.split("/")[-1]: r for r in raw_rows.collect()}
    assert set(got) == {*made, "bad_page_1.png"} and got["bad_page_1.png"].logits is None
    results = {r.file_path.split("/")[-1]: r.detections for r in D.page_results(raw_rows).collect()}
    assert results["bad_page_1.png"] is None and all(results[name] is not None for name in made)
    for name, img in made.items():
        tensor = pixels.prepare(img, pixels.Profile(binarize=True, max_size=16, bgr=False))
        assert got[name].logits[0][0] == pytest.approx(float(tensor.mean(dtype=np.float64)))
        assert got[name].boxes == [BOX]
        assert (got[name].img_h, got[name].img_w) == img.shape[:2]


def _decode(data: bytes):
    """Enough of a PNG reader for files this library wrote."""
    import struct
    import zlib

    if not data.startswith(b"\x89PNG"):
        raise ValueError("not an image")
    width, height = struct.unpack(">II", data[16:24])
    size = struct.unpack(">I", data[33:37])[0]
    lines = np.frombuffer(zlib.decompress(data[41 : 41 + size]), np.uint8).reshape(height, -1)[:, 1:]
    return lines if data[25] == 0 else lines.reshape(height, width, 3)


def _images(spark, n):
    """Gray images of 4 x 4, the shade of each its number."""
    rows = [(i, ("", 4, 4, 1, 0, bytes([i]) * 16)) for i in range(n)]
    return spark.createDataFrame(rows, f"id INT, image {schemas.IMAGE.simpleString()}").coalesce(1)


PLAIN = pixels.Profile(binarize=False, max_size=4, mean=(0, 0, 0), std=(1, 1, 1))


def _shape_model(n_classes=3, n_queries=1, bad=()):
    def make():
        sizes = []

        def model(tensors):
            sizes.append(len(tensors))
            shades = [round(float(t.max()) * 255) for t in tensors]
            if set(shades) & set(bad):
                raise RuntimeError(f"call {len(sizes)}")
            return np.ones((len(tensors), n_queries, n_classes)), np.ones((len(tensors), n_queries, 4))

        return model

    return make


@pytest.mark.parametrize("bad", [(), (3,), (0, 1, 15), tuple(range(16))])
def test_a_failing_batch_is_halved_down_to_the_images_at_fault(spark, bad):
    rows = D.run_model(_images(spark, 16), _shape_model(bad=bad), 3, PLAIN, batch_size=16).collect()
    assert {r.id for r in rows if r.status == "error"} == set(bad) and len(rows) == 16
    for r in rows:
        assert (r.img_w, r.img_h) == (4, 4)
        assert (r.logits is None) == (r.reason is not None) == (r.id in bad) == (r.boxes is None)
    if bad == (3,):  # 0-15, 0-7, 0-3, 0-1, 2-3, 2, 3
        assert [r.reason for r in rows if r.reason] == ["RuntimeError: call 7"]


def test_wrong_class_count_ends_the_run(spark):
    with pytest.raises(Exception, match=r"model output of shape \(2, 1, 5\), not \(2, 1, 3\)"):
        D.run_model(_images(spark, 2), _shape_model(n_classes=5), 3, PLAIN).collect()


def test_images_without_queries(spark):
    rows = D.run_model(_images(spark, 2), _shape_model(n_queries=0), 3, PLAIN)
    assert [(r.logits, r.boxes, r.status) for r in rows.collect()] == [([], [], "ok")] * 2
    assert D.detect_objects(rows).count() == 0 and [r.detections for r in D.page_results(rows).collect()] == [[], []]


def test_crops_of_both_forms(spark):
    boxes = [[0.0, 0.0, 2.0, 2.0], [-5.0, 1.2, 99.0, 2.5], [3.0, 3.0, 3.0, 3.0]]
    pages = _images(spark, 5).withColumns({
        "img_w": F.lit(4), "img_h": F.lit(4), "page_num": F.lit(1), "file_name": F.concat(F.col("id").cast("string"), F.lit(".pdf")),
        "detections": F.expr(f"""CASE WHEN id = 0 THEN cast(null AS {schemas.DETECTIONS}) WHEN id = 1 THEN cast(array() AS {schemas.DETECTIONS})
            ELSE array({", ".join(f"struct('table' AS label, 0.5D AS score, array({', '.join(f'{v}D' for v in b)}) AS bbox)" for b in boxes)}) END"""),
    })
    for mode in ("cover", "nearest"):
        lists, rows = (sorted(map(repr, f(pages, "c", mode).collect())) for f in (RES.page_crops, RES.lateral_crops))
        assert lists == rows and len(rows) == 9
    got = {(r.id, r.table_idx): r for r in RES.lateral_crops(pages, "c").collect()}
    assert (got[2, 1].left, got[2, 1].top, got[2, 1].right, got[2, 1].bottom) == (0, 1, 4, 3)
    assert bytes(got[2, 1].image.data) == bytes([2]) * 8 and got[2, 2].image.data == b""
    # One image is in a row at a time: the plan joins a table function, it does not explode a list.
    plan = RES.lateral_crops(pages, "c")._jdf.queryExecution().optimizedPlan().toString()
    assert "UDTF" in plan and "posexplode" not in plan


def test_encoded_images_give_the_same_output(spark, folder):
    images_folder(folder)
    model = _counting_model(set())
    for profile in (pixels.Profile(binarize=True, max_size=16), pixels.Profile(binarize=False, max_size=16)):
        decoded = D.run_model(sources.read_images(spark, folder), model, 3, profile)
        files = sources.read_documents(spark, folder, "*.png").select(
            F.regexp_replace("doc_path", "^file:/+", "/").alias("file_path"), F.col("content").alias("image"))
        encoded = D.run_model(files, model, 3, profile, decode=_decode, batch_size=3)
        # Why an image was not read is the decoder's to say.
        told = [sorted(df.drop("reason").collect()) for df in (encoded, decoded)]
        assert told[0] == told[1] and encoded.count() == 4
        assert [df.filter("reason IS NOT NULL").count() for df in (encoded, decoded)] == [1, 1]


def test_layout_labels_and_their_threshold(spark):
    best = lambda i, top: [top if j == i else 0.0 for j in range(5)]
    rows = D.page_results(raw(spark, best(3, 9.0), best(4, 1.0), best(0, 5.0)), schemas.LAYOUT_LABELS, min_score=0.8)
    assert [d.label for d in rows.first().detections] == ["Table", "Text"]


def test_the_model_runs_once_below_a_filter(spark, folder):
    images_folder(folder)
    raw_rows = D.run_model(sources.read_images(spark, folder), _counting_model(set()), 3, pixels.PLAIN)
    for df in (
        RES.annotated_pages(D.page_results(raw_rows)),
        D.score_threshold(D.detect_objects(raw_rows)),
        D.flatten_detections(D.page_results(raw_rows)),
    ):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


def test_results_round_trip_through_csv(spark, folder):
    rows = [
        ("out/Doe, 1910_page_1.png", [("table", 0.91, [10.5, 20.0, 300.25, 400.0])]),
        ("out/Doe, 1910_page_2.png", []),
        ('out/q"uote_page_3.png', [("table rotated", 0.6, [0.0, 1.0, 2.0, 3.0]), ("table", 0.8, [5.0, 5.0, 9.0, 9.0])]),
    ]
    df = spark.createDataFrame(rows, f"file_path STRING, detections {schemas.DETECTIONS}")
    sinks.write_results_csv(df, f"{folder}/csv")
    back = RES.parse_detections(sources.read_results_csv(spark, f"{folder}/csv"))
    assert sorted(back.collect()) == sorted(df.collect())
    sinks.write_results(df, f"{folder}/typed")
    sinks.write_results(df, f"{folder}/typed")
    assert spark.read.parquet(f"{folder}/typed").count() == 3


def test_literal_text_is_parsed(spark):
    text = "[{'label': 'table', 'score': 0.5, 'bbox': [1.0, 2.5, 3.0, 4e2]}, {'label': 'table rotated', 'score': 1, 'bbox': []}]"
    df = spark.createDataFrame([("a", text), ("b", "[]"), ("c", "[{broken")], "file_path STRING, score STRING")
    parsed = RES.parse_detections(df)
    got = {r.file_path: r.detections for r in parsed.collect()}
    assert got["a"][0].bbox == [1.0, 2.5, 3.0, 400.0] and got["a"][1].label == "table rotated"
    assert got["b"] == [] and got["c"] is None
    assert [r.file_path for r in RES.unreadable(parsed).collect()] == ["c"]


def test_shape_of_a_real_run(spark):
    """Invented rows with the counts of a real run: 126 pages, 124 detections, 27 pages empty."""
    sizes = [0] * 27 + [1] * 84 + [2] * 10 + [3] * 2 + [4] * 2 + [6]
    rows, n = [], 0
    for i, size in enumerate(sizes):
        doc, page = ("A", i + 1) if i < 110 else ("B, 2", i - 109)
        found = []
        for _ in range(size):
            found.append(("table rotated" if n < 5 else "table", 0.85 if n < 66 else 0.6, [1.0, 2.0, 3.0 + n, 4.0 + n]))
            n += 1
        rows.append((f"out/{doc}_page_{page}.png", found))
    df = spark.createDataFrame(rows, f"file_path STRING, detections {schemas.DETECTIONS}")
    assert (df.count(), D.flatten_detections(df).count()) == (126, 124)
    assert RES.annotated_pages(df).count() == 99
    assert D.score_threshold(D.flatten_detections(df)).count() == 66
    counts = {r.doc: (r.n_pages, r.table_count) for r in D.doc_table_counts(P.with_page_parts(df, "file_path")).collect()}
    assert counts["A"][0] == 110 and counts["B, 2"][0] == 16 and sum(c for _, c in counts.values()) == 124
    assert RES.overlay_rects(df).count() == 124 * 3


def test_lookup_takes_the_first_of_repeated_paths(spark):
    rows = [("a", 3, [("table", 0.5, [0.0] * 4)]), ("a", 1, []), ("b", 2, [])]
    df = spark.createDataFrame(rows, f"file_path STRING, row_idx LONG, detections {schemas.DETECTIONS}")
    assert [r.row_idx for r in RES.lookup_by_path(df, "a").collect()] == [1]
    assert [r.file_path for r in RES.lookup_by_index(df, 2).collect()] == ["b"]
    images = spark.createDataFrame([("file:///a", 5)], "image_path STRING, width INT")
    df = df.withColumn("file_path", F.concat(F.lit("/"), "file_path"))
    got = {r.file_path: (r.row_idx, r.width) for r in RES.pair_with_images(df, images).collect()}
    assert got == {"/a": (1, 5), "/b": (2, None)}


def test_overlay_skips_other_labels_but_the_page_counts(spark):
    df = spark.createDataFrame([("a", [("figure", 0.9, [0.0, 0.0, 1.0, 1.0])])], f"file_path STRING, detections {schemas.DETECTIONS}")
    assert RES.overlay_rects(df).count() == 0 and RES.annotated_pages(df).count() == 1


def test_crop_rectangles(spark):
    boxes = [[-3.5, 2.5, 10.2, 30.0], [0.5, 1.5, 2.5, 3.5], [50.0, 50.0, 60.0, 60.0]]
    df = spark.createDataFrame(
        [("d.pdf", 4, 20, 25, [("table", 0.9, b) for b in boxes])],
        f"file_name STRING, page_num INT, img_w INT, img_h INT, detections {schemas.DETECTIONS}")
    cover = [(r.left, r.top, r.right, r.bottom) for r in RES.crop_spec(df, "out/").orderBy("table_idx").collect()]
    assert cover == [(0, 2, 11, 25), (0, 1, 3, 4), (20, 25, 20, 25)]
    near = RES.crop_spec(df, "out", "nearest").orderBy("table_idx").collect()
    assert [(r.left, r.top, r.right, r.bottom) for r in near] == [(-4, 2, 10, 30), (0, 2, 2, 4), (50, 50, 60, 60)]
    assert near[1].image_path == "out/d.pdf_page_4_table_1.png"
