"""Lists to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_list(df: DataFrame, values: Column, pos: str, value: str, keep: list[str] | None = None) -> DataFrame:
    """One row per list element with its position; empty and null lists give no row.

    The outer form with a filter behind it, because for the plain form the optimizer adds a size
    test that it pushes below the projection, and the list is then computed twice.
    """
    keys = df.columns if keep is None else keep
    rows = df.select(*keys, F.posexplode_outer(values).alias(pos, value))
    return rows.filter(F.col(pos).isNotNull())
