"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.lineage import materialize


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (u, v) pairs."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.filter("u != v").distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (its component's least node) of every linked node.

    ``edges`` has bigint columns u and v; order and repeats do not matter. The
    rounds end when the edges are stars around the least nodes; only counts
    return to the driver.
    """
    now = materialize(
        edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    while True:
        # Stars: every u has one v, and no v is a u.
        n, nodes, inner = _shape(now)
        if n == nodes and not inner:
            break
        now = materialize(_stars(now), "edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _shape(edges: DataFrame) -> tuple[int, int, int]:
    """(edges, nodes with a smaller neighbour, edges whose v has one itself)."""
    by = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    n, nodes = by.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    inner = edges.select(F.col("v").alias("u")).distinct().join(by.select("u"), "u", "left_semi").count()
    return int(n), int(nodes), int(inner)
