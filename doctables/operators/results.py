"""Using stored detections: parsing, lookup, pairing with images, overlays and crops.

``results`` frames hold ``file_path`` and ``detections`` (label, score, bbox), one row per page.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctables import schemas
from doctables.functions import boxes as B
from doctables.functions import paths, pixels
from doctables.functions.rows import explode_list
from doctables.operators.detect import table_total
from doctables.operators.images import MODES, image_udf


def parse_detections(rows: DataFrame, text: str = "score") -> DataFrame:
    """Typed detections from literal text; unreadable text gives null (see ``unreadable``)."""
    parsed = F.from_json(F.col(text), schemas.DETECTIONS, {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    return rows.withColumn("detections", parsed).drop(text)


def unreadable(results: DataFrame) -> DataFrame:
    """Pages without a list: text that did not parse, or images that did not decode."""
    return results.filter(F.col("detections").isNull())


def lookup_by_path(results: DataFrame, path: str) -> DataFrame:
    """First row with a path, by ``row_idx``. The filter reaches the scan of a stored table."""
    return results.filter(F.col("file_path") == path).orderBy("row_idx").limit(1)


def lookup_by_index(results: DataFrame, index: int) -> DataFrame:
    """Row by its stored position; frames themselves have no order."""
    return results.filter(F.col("row_idx") == index)


def first_per_path(results: DataFrame) -> DataFrame:
    """The first row of every path, with the canonical path in ``_path``.

    Grouped on the key of the join that follows, so one shuffle serves both. Repeated paths
    combine map-side.
    """
    keyed = results.withColumn("_path", paths.canonical_path(F.col("file_path"), False))
    first = F.min_by(F.struct(*results.columns), "row_idx").alias("_first")
    return keyed.groupBy("_path").agg(first).select("_path", "_first.*")


def pair_with_images(results: DataFrame, images: DataFrame, escaped: bool = False) -> DataFrame:
    """Every stored path with its image row, as one join on the canonical path.

    ``images`` is a listing (``image_path`` and sizes), unique per path; pixels have no place in
    this join.
    """
    right = images.withColumn("_path", paths.canonical_path(F.col("image_path"), escaped))
    return first_per_path(results).join(right, "_path", "left").drop("_path")


def overlay_styles(spark: SparkSession) -> DataFrame:
    """Two styles of three layers each. Colours, widths, hatch and opacities."""
    return spark.sql(
        """
        SELECT label, layer, layer_no, color, line_width, hatch, alpha
        FROM VALUES
          ('table', 'fill', 1, '1,0,0.45', 2, NULL, 0.1D),
          ('table', 'edge', 2, '1,0,0.45', 2, NULL, 0.3D),
          ('table', 'hatch', 3, '1,0,0.45', 0, '//////', 0.2D),
          ('table rotated', 'fill', 1, '0.95,0.6,0.1', 2, NULL, 0.1D),
          ('table rotated', 'edge', 2, '0.95,0.6,0.1', 2, NULL, 0.3D),
          ('table rotated', 'hatch', 3, '0.95,0.6,0.1', 0, '//////', 0.2D)
          AS styles(label, layer, layer_no, color, line_width, hatch, alpha)
        """
    )


def overlay_rects(results: DataFrame) -> DataFrame:
    """Rectangles to draw, three layers per detection; labels without a style are skipped."""
    keys = [c for c in results.columns if c != "detections"]
    rows = explode_list(results, F.col("detections"), "table_idx", "d", keys)
    x0, y0, x1, y1 = (B.part(F.col("d.bbox"), i) for i in range(4))
    rects = rows.select(
        *keys, "table_idx", "d.label",
        x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"),
    )
    # Six fixed rows.
    return rects.join(F.broadcast(overlay_styles(results.sparkSession)), "label")


def annotated_pages(results: DataFrame, always: bool = False) -> DataFrame:
    """Pages that get an annotated image: those with any detection, whatever its label."""
    return results if always else results.filter(F.size("detections") > 0)


def with_output_path(results: DataFrame, folder: str, path: str = "file_path") -> DataFrame:
    return results.withColumn("out_path", paths.join_path(F.lit(folder), paths.file_name(F.col(path))))


def _rectangle(box: Column, mode: str) -> list[Column]:
    x0, y0, x1, y1 = (B.part(box, i) for i in range(4))
    if mode == "cover":
        left, top = (_within(F.floor(v), s) for v, s in ((x0, "img_w"), (y0, "img_h")))
        right, bottom = (_within(F.ceil(v), s) for v, s in ((x1, "img_w"), (y1, "img_h")))
    else:
        left, top, right, bottom = (F.rint(v) for v in (x0, y0, x1, y1))
    return [v.cast("int").alias(n) for v, n in ((left, "left"), (top, "top"), (right, "right"), (bottom, "bottom"))]


def _crop_name(folder: str) -> Column:
    name = F.concat(
        F.col("file_name"), F.lit("_page_"), F.col("page_num").cast("string"),
        F.lit("_table_"), F.col("table_idx").cast("string"), F.lit(".png"),
    )
    return paths.join_path(F.lit(folder), name).alias("image_path")


def crop_spec(results: DataFrame, folder: str, mode: str = "cover") -> DataFrame:
    """Whole-pixel crop rectangle and file name of every detection.

    ``cover`` takes every touched pixel and clips to the image; ``nearest`` rounds the corners
    (halves to even) and may pass the edge, where a crop is black. Needs ``file_name``,
    ``page_num``, ``img_w`` and ``img_h``. An image column is left behind: see ``page_crops``.
    """
    keys = [c for c in results.columns if c not in ("detections", "image")]
    rows = explode_list(results, F.col("detections"), "table_idx", "d", keys)
    return rows.select(
        *keys, "table_idx", F.col("d.label").alias("label"), F.col("d.bbox").alias("bbox"),
        *_rectangle(F.col("d.bbox"), mode), _crop_name(folder),
    )


def _within(value: Column, side: str) -> Column:
    return F.least(F.greatest(value, F.lit(0)), F.col(side))


def _cut(image: tuple, x0: int, y0: int, x1: int, y1: int) -> tuple:
    """A rectangle of an image as an image; what lies outside is black."""
    origin, h, w, channels, _, data = image
    img = pixels.as_array(data, h, w, channels)
    out = np.zeros((max(y1 - y0, 0), max(x1 - x0, 0)) + img.shape[2:], np.uint8)
    a, b, c, d = max(x0, 0), max(y0, 0), min(x1, w), min(y1, h)
    if a < c and b < d:
        out[b - y0 : d - y0, a - x0 : c - x0] = img[b:d, a:c]
    return origin, *out.shape[:2], channels, MODES[channels], out.tobytes()


def cut_rectangles(pages: DataFrame, rectangles: str, col: str = "image") -> DataFrame:
    """Replace each image by the array of its crops, one per entry of ``rectangles`` (structs of
    ``left``, ``top``, ``right``, ``bottom``). An image goes to Python once, however many crops."""

    @image_udf(T.ArrayType(schemas.IMAGE))
    def cut(frame: pd.DataFrame, lists: pd.Series) -> pd.Series:
        rows = []
        for image, boxes in zip(frame.itertuples(index=False, name=None), lists):
            found = [] if boxes is None else [_cut(image, *(int(r[k]) for k in ("left", "top", "right", "bottom"))) for r in boxes]
            rows.append([dict(zip(schemas.IMAGE.names, crop)) for crop in found])
        return pd.Series(rows, dtype=object)

    return pages.withColumn(col, cut(col, rectangles))


_SIDES = ("left", "top", "right", "bottom")


class _Crops:
    """Table function: the crops of an image one by one, so a page with many tables is never a row
    with all of them."""

    def eval(self, image, boxes):
        for i, box in enumerate(boxes or ()):
            sides = tuple(box[k] for k in _SIDES)
            yield i, *sides, _cut(tuple(image), *sides)


def lateral_crops(results: DataFrame, folder: str, mode: str = "cover") -> DataFrame:
    """``page_crops`` as a lateral join with a table function: the same rows, cut as they leave.

    For pages with many or large crops; ``page_crops`` moves whole Arrow batches instead.
    """
    crops = F.udtf(_Crops, returnType=f"table_idx int, {', '.join(f'`{s}` int' for s in _SIDES)}, image {schemas.IMAGE.simpleString()}")
    keys = [c for c in results.columns if c not in ("detections", "image")]
    boxes = F.transform("detections", lambda d: F.struct(*_rectangle(d["bbox"], mode)))
    some = results.filter(F.size("detections") > 0).withColumnsRenamed({"image": "_page"}).withColumn("_boxes", boxes)
    rows = some.lateralJoin(crops(F.col("_page").outer(), F.col("_boxes").outer()))
    found = F.col("detections")[F.col("table_idx")]
    return rows.select(
        *keys, "table_idx", found["label"].alias("label"), found["bbox"].alias("bbox"), *_SIDES, "image", _crop_name(folder)
    )


def page_crops(results: DataFrame, folder: str, mode: str = "cover") -> DataFrame:
    """``crop_spec`` with the pixels: one row per detection of pages that carry their ``image``.

    The rectangles stay a list in the page's row until its crops are cut, so pages are not copied.
    """
    keys = [c for c in results.columns if c not in ("detections", "image")]
    boxes = F.transform("detections", lambda d: F.struct(*_rectangle(d["bbox"], mode)))
    some = results.filter(F.size("detections") > 0).withColumn("_boxes", boxes)
    cut = cut_rectangles(some, "_boxes")
    zipped = F.arrays_zip(F.col("detections").alias("d"), F.col("_boxes").alias("b"), F.col("image").alias("i"))
    rows = cut.select(*keys, F.posexplode(zipped).alias("table_idx", "_z"))
    return rows.select(
        *keys, "table_idx", F.col("_z.d.label").alias("label"), F.col("_z.d.bbox").alias("bbox"),
        *[F.col(f"_z.b.{n}").alias(n) for n in ("left", "top", "right", "bottom")],
        F.col("_z.i").alias("image"), _crop_name(folder),
    )


def crop_pixels(crops: DataFrame, col: str = "image") -> DataFrame:
    """Cut the rectangle of each row out of its image; what lies outside the image is black."""
    one = F.array(F.struct("left", "top", "right", "bottom"))
    return cut_rectangles(crops.withColumn("_boxes", one), "_boxes", col).withColumn(col, F.col(col)[0]).drop("_boxes")


def documents_table(results: DataFrame) -> DataFrame:
    """(filename, n_pages, table_count) per document; needs ``file_name``."""
    return results.groupBy(F.col("file_name").alias("filename")).agg(
        F.count(F.lit(1)).alias("n_pages"),
        table_total().alias("table_count"),
    )


def tables_table(crops: DataFrame) -> DataFrame:
    return crops.select(F.col("file_name").alias("filename"), "page_num", "table_idx", "bbox", "image_path")


def as_text(results: DataFrame) -> DataFrame:
    """``file_path, score`` rows with the detections as JSON text."""
    return results.select("file_path", F.to_json("detections").alias("score"))
