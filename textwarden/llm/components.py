"""Connected components of a links table, by alternating large-star and small-star steps.

Each round's links are written to the shared folder, so lineage stays short and no links reach the
driver. A star's centre may have any number of neighbours: minima are aggregated before the shuffle,
and the joins back have a small side that the planner replicates where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each neighbour of a node to the least of the node and its neighbours.

    Large star: neighbours above the node, from links seen both ways. Small star: neighbours below
    it and the node itself. edges has u > v.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
    return out.filter("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has a link; the component is its least node."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, "links")
    mark = None
    while True:
        before, edges = edges, materialize(_star(_star(edges, True), False), "stars")
        discard(before)
        new = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == mark:
            break
        mark = new
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
