"""From raw model output to labelled pixel boxes.

``raw`` frames hold one row per page image: any key columns, ``logits`` ARRAY<ARRAY<DOUBLE>>,
``boxes`` ARRAY<ARRAY<DOUBLE>> (cx, cy, w, h in 0..1), ``img_w`` and ``img_h``. All work stays
inside the row, so nothing here shuffles except the per-document count.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctables import schemas
from doctables.functions import boxes as B
from doctables.functions import pixels, scores
from doctables.functions.rows import explode_list

NOTHING = np.zeros(0)


def zip_outputs(raw: DataFrame) -> DataFrame:
    """One row per query, keeping its position; scores and boxes are paired by position."""
    keys = [c for c in raw.columns if c not in ("logits", "boxes")]
    zipped = explode_list(raw, F.arrays_zip("logits", "boxes"), "query_idx", "q", keys)
    return zipped.select(*keys, "query_idx", F.col("q.logits").alias("logits"), F.col("q.boxes").alias("box"))


_OUTCOME = ("status", "reason")


def _reason(raw: DataFrame) -> Column:
    """Why an image was not examined, where the frame knows it."""
    return F.col("reason") if "reason" in raw.columns else F.lit(None).cast("string")


def _status(reason: Column) -> Column:
    return F.when(reason.isNull(), "ok").otherwise("error")


def _fields(logits: Column, box: Column, w: Column, h: Column, labels: dict[int, str]) -> tuple[Column, Column, list[Column]]:
    label = scores.label_of(scores.best_class(logits), labels)
    return label, scores.best_score(logits, len(labels)), B.pixel_corners(box, w, h)


def softmax_scores(raw: DataFrame, n_classes: int) -> DataFrame:
    return zip_outputs(raw).withColumn("probs", scores.softmax(F.col("logits"), n_classes))


def best_classes(raw: DataFrame, n_classes: int) -> DataFrame:
    logits = F.col("logits")
    return zip_outputs(raw).withColumns(
        {"class_id": scores.best_class(logits), "score": scores.best_score(logits, n_classes)}
    )


def with_labels(classes: DataFrame, labels: dict[int, str]) -> DataFrame:
    """Add ``label``, ``status`` and ``reason``; a class id outside the map is an error row without a
    label, and the others go on."""
    label = scores.label_of(F.col("class_id"), labels)
    reason = F.when(label.isNull(), scores.no_label(F.col("class_id")))
    return classes.withColumns({"label": label, "reason": reason, "status": _status(reason)})


def corner_boxes(raw: DataFrame) -> DataFrame:
    return _with_corners(zip_outputs(raw), B.corners(F.col("box")))


def rescaled_boxes(raw: DataFrame) -> DataFrame:
    return _with_corners(
        zip_outputs(raw), B.pixel_corners(F.col("box"), F.col("img_w"), F.col("img_h"))
    )


def _with_corners(df: DataFrame, values: list[Column]) -> DataFrame:
    return df.withColumns(dict(zip(("x0", "y0", "x1", "y1"), values)))


def drop_no_object(labelled: DataFrame) -> DataFrame:
    """Rows without a label stay: they are errors, not nothing."""
    return labelled.filter(~F.col("label").eqNullSafe(F.lit(schemas.NO_OBJECT)))


def detect_objects(raw: DataFrame, labels: dict[int, str] = schemas.DETECTION_LABELS) -> DataFrame:
    """One row per kept detection, and one for each query of a class without a label (``status`` is
    then 'error'). Exploding first keeps the arithmetic in compiled code."""
    keys = [c for c in raw.columns if c not in ("logits", "boxes", *_OUTCOME)]
    label, score, corners = _fields(
        F.col("logits"), F.col("box"), F.col("img_w"), F.col("img_h"), labels
    )
    unknown = F.when(label.isNull(), scores.no_label(scores.best_class(F.col("logits"))))
    rows = zip_outputs(raw).select(*keys, "query_idx", label.alias("label"), score.alias("score"), "box", unknown.alias("reason"))
    kept = drop_no_object(rows).withColumn("status", _status(F.col("reason")))
    return _with_corners(kept, corners).drop("box")


def score_threshold(detections: DataFrame, minimum: float = 0.8) -> DataFrame:
    return detections.filter(F.col("score") > minimum)


def page_results(
    raw: DataFrame,
    labels: dict[int, str] = schemas.DETECTION_LABELS,
    min_score: float | None = None,
) -> DataFrame:
    """One row per image with its list of detections in query order, ``status`` and ``reason``; empty
    lists are kept. Images that were not examined (null ``logits``) or with a query whose class has no
    label have a null list and the status 'error'.

    Stays within the row: grouping exploded queries back per image would shuffle every
    detection for nothing.
    """
    keys = [c for c in raw.columns if c not in ("logits", "boxes", *_OUTCOME)]

    def one(q: Column) -> Column:
        label, score, corners = _fields(q["logits"], q["boxes"], F.col("img_w"), F.col("img_h"), labels)
        return F.struct(label.alias("label"), score.alias("score"), F.array(*corners).alias("bbox"))

    empty = [i for i, name in labels.items() if name == schemas.NO_OBJECT]

    def keep(q: Column) -> Column:
        wanted = ~scores.best_class(q["logits"]).isin(empty)
        return wanted if min_score is None else wanted & (scores.best_score(q["logits"], len(labels)) > min_score)

    # Most queries of a page are empty, so they go before labels and boxes are worked out.
    found = F.transform(F.filter(F.arrays_zip("logits", "boxes"), keep), one)
    # A class without a label is told by its detection, so only what was found is looked through.
    lost = F.filter("_found", lambda d: d["label"].isNull())
    ids = F.filter(F.transform("logits", scores.best_class), lambda c: ~c.isin(list(labels)))
    reasons = F.coalesce(
        F.col("_reason"),
        F.when(F.col("logits").isNull(), "not examined"),
        F.when(F.size(lost) > 0, scores.no_label(F.get(ids, F.lit(0)))),
    )
    rows = raw.select(*keys, "logits", found.alias("_found"), _reason(raw).alias("_reason"))
    told = rows.select(*keys, "_found", reasons.alias("reason"))
    return told.select(*keys, F.when(F.col("reason").isNull(), F.col("_found")).alias("detections"), _status(F.col("reason")).alias("status"), "reason")


def flatten_detections(results: DataFrame) -> DataFrame:
    """One row per detection with its index in the page; pages without any give no row."""
    keys = [c for c in results.columns if c != "detections"]
    rows = explode_list(results, F.col("detections"), "table_idx", "d", keys)
    return rows.select(*keys, "table_idx", "d.label", "d.score", "d.bbox")


def table_total() -> Column:
    """Aggregate: detections of all pages; pages that were not examined count as none."""
    return F.coalesce(F.sum(F.array_size("detections").cast("bigint")), F.lit(0).cast("bigint"))


def doc_table_counts(results: DataFrame, doc: str = "doc") -> DataFrame:
    """Pages and tables per document, from rows of one page each (combined map-side)."""
    return results.groupBy(doc).agg(
        F.count(F.lit(1)).alias("n_pages"),
        table_total().alias("table_count"),
    )


def run_model(
    images: DataFrame,
    make_model: Callable[[], Callable],
    n_classes: int,
    profile: pixels.Profile,
    batch_size: int = 8,
    col: str = "image",
    keep_image: bool = False,
    decode: Callable[[bytes], np.ndarray] | None = None,
) -> DataFrame:
    """Add ``logits``, ``boxes``, ``img_w`` and ``img_h`` by batched inference over page images.

    ``make_model`` runs once per Python worker and returns ``model(list of CHW float arrays) ->
    (logits [n, q, classes], boxes [n, q, 4])``. Preparing the tensors happens in the same Arrow
    step, so an image crosses to Python once and its tensor never goes back to the JVM.

    The column holds Spark's image struct or, with ``decode(bytes) -> RGB array``, the encoded file:
    a twentieth of the bytes to move. Model batches do not cross Arrow batches, which are bounded by
    bytes (see ``session.SETTINGS``).

    Every image gives one row, with ``status`` and ``reason``. One that does not decode has height -1,
    null ``logits`` and ``boxes``, and the status 'error'. Where the model fails on a batch, its halves
    are tried, down to the image at fault, which becomes such a row with its own height; the others go
    on. A model whose output does not have ``n_classes`` classes ends the run: no image is at fault.
    An image may have no query.
    """
    steps = profile if decode is None else replace(profile, bgr=False)

    def pixels_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
        if decode is not None:
            return decode(data)
        if height <= 0:
            raise ValueError("no image")
        return pixels.as_array(data, height, width, channels)

    def make_predict():
        model = make_model()

        def outputs_of(tensors: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray] | str]:
            """Logits and boxes of every tensor, or why there are none."""
            try:
                logits, boxes = (np.asarray(v, np.float64) for v in model(tensors))
            except Exception as e:  # noqa: BLE001 - told apart by halves, recorded per image
                if len(tensors) == 1:
                    return [f"{type(e).__name__}: {e}"]
                half = len(tensors) // 2
                return outputs_of(tensors[:half]) + outputs_of(tensors[half:])
            n_queries = logits.shape[1] if logits.ndim > 1 else 0
            for values, last in ((logits, n_classes), (boxes, 4)):
                if values.shape != (len(tensors), n_queries, last):
                    raise ValueError(f"model output of shape {values.shape}, not {(len(tensors), n_queries, last)}")
            return [(a.ravel(), b.ravel()) for a, b in zip(logits, boxes)]

        def predict(data, height, width, channels):
            rows: list[dict] = []
            tensors: list[np.ndarray] = []
            for d, h, w, c in zip(data, height, width, channels):
                row = {"logits": NOTHING, "boxes": NOTHING, "height": np.int32(-1), "width": np.int32(-1), "reason": ""}
                rows.append(row)
                try:
                    img = pixels_of(d, int(h), int(w), int(c))
                    tensors.append(pixels.prepare(img, steps))
                except Exception as e:  # noqa: BLE001 - an unreadable image is a row without detections
                    row["reason"] = f"{type(e).__name__}: {e}"
                else:
                    row["height"], row["width"] = np.int32(img.shape[0]), np.int32(img.shape[1])
            good = [row for row in rows if not row["reason"]]
            for row, out in zip(good, outputs_of(tensors) if tensors else []):
                if isinstance(out, str):
                    row["reason"] = out
                else:
                    row["logits"], row["boxes"] = out
            return rows

        return predict

    outputs = T.StructType(
        [
            T.StructField("logits", T.ArrayType(T.DoubleType())),
            T.StructField("boxes", T.ArrayType(T.DoubleType())),
            T.StructField("height", T.IntegerType()),
            T.StructField("width", T.IntegerType()),
            T.StructField("reason", T.StringType()),
        ]
    )
    # Marked so that the optimizer never copies the call into a filter and infers twice.
    infer = predict_batch_udf(make_predict, return_type=outputs, batch_size=batch_size).asNondeterministic()
    if decode is None:
        image = F.struct(*[F.col(f"{col}.{f}") for f in ("data", "height", "width", "nChannels")])
    else:
        none = F.lit(0)
        image = F.struct(F.col(col).alias("data"), none.alias("height"), none.alias("width"), none.alias("nChannels"))
    called = images.withColumn("_out", infer(image))
    examined = F.col("_out.reason") == ""

    def rows_of(flat: Column, width: int) -> Column:
        n = (F.size(flat) / width).cast("int")
        rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(flat, i * width + 1, F.lit(width)))
        return F.when(n > 0, rows).otherwise(F.array().cast("array<array<double>>"))

    return called.select(
        *[c for c in images.columns if (keep_image or c != col) and c not in _OUTCOME],
        F.when(examined, rows_of(F.col("_out.logits"), n_classes)).alias("logits"),
        F.when(examined, rows_of(F.col("_out.boxes"), 4)).alias("boxes"),
        F.col("_out.width").alias("img_w"),
        F.col("_out.height").alias("img_h"),
        F.when(examined, "ok").otherwise("error").alias("status"),
        F.when(~examined, F.col("_out.reason")).alias("reason"),
    )
