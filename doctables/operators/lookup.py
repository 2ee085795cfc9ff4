"""Joins of a frame with a side that is unique on the key, safe when one key holds most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot above 1/MAX_HOT of all rows, so there are never more than MAX_HOT of them.
MAX_HOT = 128
# Entries of the counting sketch. Its error is below 4/TRACKED of all rows, far under 1/MAX_HOT,
# so no hot key is missed.
TRACKED = 2048
# First-level merges of the tasks' sketches.
MERGES = 256
SALTS = 32
MIN_HOT_ROWS = 200_000


def hot_keys(df: DataFrame, key: str, min_rows: int = MIN_HOT_ROWS) -> list:
    """Keys above 1/MAX_HOT of all rows and above ``min_rows``; None stands for rows without a key.

    Runs one job over the key column. Every task sends one sketch of bounded size, merged in two
    levels, so the keys themselves are not shuffled, and at most MAX_HOT + 1 values come back.
    """
    merge = F.spark_partition_id() % MERGES
    sketch = F.expr(f"approx_top_k_accumulate(_key, {TRACKED}) FILTER (WHERE _key IS NOT NULL)")
    parts = df.select(F.col(f"`{key}`").alias("_key"), merge.alias("_merge")).groupBy("_merge").agg(
        F.count(F.lit(1)).alias("_rows"), F.count("_key").alias("_keys"), sketch.alias("_sketch")
    )
    # Grouped by a constant, so that an empty frame gives no row instead of an empty sketch.
    whole = parts.groupBy(F.lit(1)).agg(
        F.sum("_rows").alias("_rows"),
        F.sum("_keys").alias("_keys"),
        F.expr(f"approx_top_k_combine(_sketch, {TRACKED})").alias("_sketch"),
    )
    row = whole.select("_rows", "_keys", F.expr(f"approx_top_k_estimate(_sketch, {MAX_HOT})").alias("_top")).first()
    if row is None:
        return []
    least = max(min_rows, row["_rows"] / MAX_HOT)
    hot = [item["item"] for item in row["_top"] if item["count"] >= least]
    return hot + ([None] if row["_rows"] - row["_keys"] >= least else [])


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    min_rows: int = MIN_HOT_ROWS,
    skew: bool = False,
) -> DataFrame:
    """Join ``left`` (any number of rows per key) with ``right`` (at most one row per key).

    This is the plain join: the planner picks its kind by the sizes, AQE splits skewed partitions, and
    no job runs while the plan is built. With ``skew`` one job over the key column looks for hot keys;
    rows of those get a salt, and the right rows of these few keys are repeated per salt. The salt
    comes from the row and the task that read it, so a task that runs again puts every row where it
    was, and copies of one row spread with the tasks that hold them.
    """
    hot = hot_keys(left, key, min_rows) if skew else []
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin([k for k in hot if k is not None])
    spread = F.pmod(F.xxhash64(*left.columns) + F.spark_partition_id(), F.lit(SALTS)).cast("int")
    salted = left.withColumn("_salt", F.when(is_hot | F.col(key).isNull(), spread).otherwise(0))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.withColumn("_salt", F.explode(salts))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
