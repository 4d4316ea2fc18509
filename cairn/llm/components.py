"""Connected components by alternating large-star and small-star steps, as Spark joins.

Labels never reach the driver. Each step works on the edges that are left; a hub's least neighbour is found with a
partial aggregate and written, and its edges meet that one row by a broadcast of counted size or, beyond that, in a
join of two plain shuffles, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import cut, small


def _star(edges: DataFrame, large: bool) -> DataFrame:
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    near = edges.unionByName(turned) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = cut(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    out = near.join(small(least), "a")
    linked = out.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return linked.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of each node of ``edges`` (a, b); a component is named by its least id."""
    edges = cut(edges.filter("a <> b").distinct())
    seen = None
    while True:
        edges = cut(_star(cut(_star(edges, True)), False))
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
