"""Connected components of a link table, distributed, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.session import materialise


def _state(edges: DataFrame) -> tuple:
    """Count and order-free checksum of a table of different links; neither can overflow, however many they are."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, root) for every linked node; root is the smallest node reachable, itself included.

    ``links`` holds undirected links between integer nodes ``a`` and ``b``; loops, repeats and links with a null end
    add nothing. Nodes without a link to another node are absent from the result; no links give an empty table.
    Each round points the larger neighbours of a node, then the smaller ones, to the smallest neighbour. Rounds end
    when no link changes; their number grows with the logarithm of the longest path. A round is two aggregates with
    map-side combine and two equi joins, which adaptive execution can split at a hot node, and is written to the
    shared folder, so lineage stays short and a lost executor costs a part of one round.
    """
    x, y = F.col(a), F.col(b)
    edges = materialise(
        links.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "links")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        moved = large.join(low, "u").filter(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = materialise(moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct(), "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
