"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

The centre of a large star is a hot key; its edges are joined where they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsense.llm import _common


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang each node's smaller neighbours, and the node, on the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _common.hot_join(edges, low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on its smallest neighbour, or on itself if it is smaller."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _common.hot_join(both.filter(F.col("v") > F.col("u")), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Return (node, root) for every node of ``edges`` (u, v: bigint) that isn't the smallest of its component.

    Loops and repeated edges are allowed; no edges give no rows.  Each round is
    written to the shared folder; the rounds grow as the logarithm of the nodes.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v")).distinct()
    edges, print_before = _common.written(edges, "edges"), None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if mark == print_before or not mark[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        print_before = mark
        wide = _common.written(_large_star(edges), "edges")
        after = _common.written(_small_star(wide), "edges")
        _common.discard(edges, wide)
        edges = after
