"""Declared schemas at every stage boundary; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

CATALOG_CSV = T.StructType(
    [T.StructField("Publication ID", T.StringType()), T.StructField("URL", T.StringType())]
)
CATALOG = "publication_id BIGINT, url STRING"
LANDED_PAGE = "url STRING, html STRING"
LINK = "publication_id BIGINT, link_pos INT, link_url STRING"

DETECTION = "STRUCT<label: STRING, score: DOUBLE, bbox: ARRAY<DOUBLE>>"
DETECTIONS = f"ARRAY<{DETECTION}>"

# Same fields as Spark's image source, so its rows go straight into the image operators.
IMAGE = T.StructType(
    [
        T.StructField("origin", T.StringType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("nChannels", T.IntegerType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ]
)

DOCUMENTS_TABLE = "filename STRING, n_pages BIGINT, table_count BIGINT"
TABLES_TABLE = "filename STRING, page_num INT, table_idx INT, bbox ARRAY<DOUBLE>, image_path STRING"

# Class ids of the two models.
DETECTION_LABELS = {0: "table", 1: "table rotated", 2: "no object"}
LAYOUT_LABELS = {0: "Text", 1: "Title", 2: "List", 3: "Table", 4: "Figure"}
NO_OBJECT = "no object"


def with_no_object(labels: dict[int, str]) -> dict[int, str]:
    """A model's own label map with the extra class after its last id."""
    return {**labels, len(labels): NO_OBJECT}
