"""Image preparation over Spark's image struct (origin, height, width, nChannels, mode, data).

Pixels stay in one binary value per image and go to numpy through Arrow; they are never exploded
to rows and never shuffled. Rows that failed to decode (height -1) pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctables import schemas
from doctables.functions import pixels

# OpenCV type codes of 8-bit images by channel count.
MODES = {1: 0, 3: 16, 4: 24}

TENSOR = T.StructType(
    [
        T.StructField("c", T.IntegerType()),
        T.StructField("h", T.IntegerType()),
        T.StructField("w", T.IntegerType()),
        T.StructField("data", T.ArrayType(T.FloatType())),
    ]
)


def image_udf(result: T.DataType):
    """Arrow function over images, marked so that the optimizer never copies the call into a filter
    and does the pixel work twice."""

    def wrap(fn: Callable):
        return F.pandas_udf(fn, result).asNondeterministic()

    return wrap


def _pixels(frame: pd.DataFrame):
    for h, w, c, data in zip(frame["height"], frame["width"], frame["nChannels"], frame["data"]):
        yield pixels.as_array(data, h, w, c) if h > 0 else None


Step = Callable[[np.ndarray], np.ndarray]


def map_images(df: DataFrame, steps: Step | Sequence[Step], col: str = "image") -> DataFrame:
    """Apply numpy steps to the images of a column, one after the other in a single pass."""
    chain = [steps] if callable(steps) else list(steps)

    @image_udf(schemas.IMAGE)
    def mapped(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for old, img in zip(frame.itertuples(index=False), _pixels(frame)):
            if img is None:
                rows.append(tuple(old))
                continue
            for step in chain:
                img = step(img)
            new = np.ascontiguousarray(img)
            channels = 1 if new.ndim == 2 else new.shape[2]
            rows.append((old[0], *new.shape[:2], channels, MODES[channels], new.tobytes()))
        return pd.DataFrame(rows, columns=schemas.IMAGE.names)

    return df.withColumn(col, mapped(F.col(col)))


def bgr_to_rgb(df: DataFrame, col: str = "image") -> DataFrame:
    return map_images(df, pixels.swap_channels, col)


def grayscale(df: DataFrame, col: str = "image") -> DataFrame:
    """One gray channel from RGB images."""
    return map_images(df, pixels.to_gray, col)


def otsu_levels(df: DataFrame, col: str = "image") -> DataFrame:
    @image_udf(T.IntegerType())
    def level(frame: pd.DataFrame) -> pd.Series:
        found = [None if img is None else pixels.otsu_level(img) for img in _pixels(frame)]
        return pd.Series(found, dtype="Int32")

    return df.withColumn("level", level(F.col(col)))


def binarized(df: DataFrame, col: str = "image") -> DataFrame:
    return map_images(df, pixels.binarize, col)


def three_channels(df: DataFrame, col: str = "image") -> DataFrame:
    return map_images(df, pixels.three_channels, col)


def dilated(df: DataFrame, size: int = 3, col: str = "image") -> DataFrame:
    return map_images(df, lambda img: pixels.dilate(img, size), col)


def resized(df: DataFrame, max_size: int = 800, col: str = "image") -> DataFrame:
    return map_images(df, lambda img: pixels.resize(img, max_size), col)


def resized_sides(width: Column, height: Column, max_size: int = 800) -> tuple[Column, Column]:
    """Sides after the longest becomes ``max_size``; small images grow, halves go to even."""
    scale = F.lit(float(max_size)) / F.greatest(width, height)
    return F.rint(scale * width).cast("int"), F.rint(scale * height).cast("int")


def _tensors(df: DataFrame, make: Callable[[np.ndarray], np.ndarray], col: str) -> DataFrame:
    @image_udf(TENSOR)
    def made(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for img in _pixels(frame):
            t = None if img is None else make(img)
            rows.append((None, None, None, None) if t is None else (*t.shape, t.ravel()))
        return pd.DataFrame(rows, columns=TENSOR.names).astype({"c": "Int32", "h": "Int32", "w": "Int32"})

    return df.withColumn("tensor", made(F.col(col))).drop(col)


def normalized(df: DataFrame, mean=pixels.BINARIZED.mean, std=pixels.BINARIZED.std, col: str = "image") -> DataFrame:
    """Channel-first tensor in place of the image, scaled to 0..1 and standardised."""
    return _tensors(df, lambda img: pixels.normalize(img, mean, std), col)


def prepared(df: DataFrame, profile: pixels.Profile = pixels.BINARIZED, col: str = "image") -> DataFrame:
    """All steps of a profile in one pass over the pixels."""
    return _tensors(df, lambda img: pixels.prepare(img, profile), col)


def encoded(df: DataFrame, encode: Callable[[np.ndarray], bytes], bgr: bool = True, col: str = "image") -> DataFrame:
    """Bytes of the caller's codec in ``content`` in place of the image; images without pixels give null."""

    @image_udf(T.BinaryType())
    def coded(frame: pd.DataFrame) -> pd.Series:
        found = []
        for img in _pixels(frame):
            if img is None or img.size == 0:
                found.append(None)
            else:
                found.append(encode(pixels.swap_channels(img) if bgr else img))
        return pd.Series(found, dtype=object)

    return df.withColumn("content", coded(F.col(col))).drop(col)
