"""Connected components of links, by alternating star contractions.

Each round replaces links by links to smaller nodes. Only minima are grouped, so a node with very
many neighbours combines map-side, and its join partition can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.llm.common import stored


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the smallest node around it."""
    around = _both_ways(links)
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = around.filter("v > u").join(least, "u")
    return moved.select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node itself, move to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    own = least.select(F.col("m").alias("a"), F.col("u").alias("b"))
    return moved.unionByName(own).filter("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected(links: DataFrame) -> DataFrame:
    """(``node``, ``label``) for every node of ``links`` (``a``, ``b``) but the smallest of each
    component, which is the label of the others.

    Goes on until a round changes nothing; the rounds grow with the logarithm of the number of
    nodes. Each round is a table in the shared folder. Repeated links, links of a node with itself
    and either order of ``a`` and ``b`` are allowed.
    """
    now = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    while state[0]:
        now = stored(_small_star(_large_star(now)), "links")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("label"))
