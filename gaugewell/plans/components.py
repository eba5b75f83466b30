"""Connected components as alternating large-star and small-star steps.

Each step is a grouping and a join on vertices; what a step leaves is written to the
shared folder, which cuts the lineage, and what it read is deleted. The number of rounds
grows with the logarithm of the graph's size. No links or components come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.sources.shared import discard, materialise


def _toward_least(edges: DataFrame) -> DataFrame:
    """One round on edges (u, v), u > v."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
    large = both.where("v > u").join(least, F.col("u") == F.col("k")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    small = large.join(least, F.col("u") == F.col("k"))
    moved = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) of every vertex that has a link; component is its least vertex."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    seen = before = None
    while True:
        edges = materialise(edges, "components")
        if before is not None:
            discard(before)
        state = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, before = state, edges
        edges = _toward_least(edges)
    # stars now: each u has one edge, to its component's least vertex
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
