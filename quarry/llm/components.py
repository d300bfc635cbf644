"""Connected components of an edge table, by alternating star contractions.

Large-star links every larger neighbour of a node to the node's smallest
neighbour, small-star links the smaller ones (Kiveris et al., 2014). Both are
joins of the edges with one minimum per node; the minimum is aggregated before
the shuffle, so a node with very many links is no hot group. The number of
rounds grows with the logarithm of the largest component; each round is
checkpointed, and nothing is collected but one changed-or-not flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut_lineage


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """edges (u, v) with u > v, each once."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    pairs = both.join(least, "u")
    if larger:
        out = pairs.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of ``edges`` (columns u, v; any
    order, repeats and loops allowed) the smallest node that its links reach.
    No edges: an empty table."""
    edges = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .where("u > v").distinct())
    seen = _state(edges)
    while True:
        edges = cut_lineage(_star(_star(edges, True), False))
        if seen == (seen := _state(edges)):
            break
    nodes = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
