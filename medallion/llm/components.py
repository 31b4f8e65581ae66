"""Connected components by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b); component is its smallest node.

    Each round hangs every node's larger neighbours on its smallest one, then every node and its
    smaller neighbours on the smallest of them, until nothing changes: O(log^2 n) rounds. A hub
    is aggregated to one row before it is joined, and its links are dealt by Spark's skew join.
    Null ends are ignored, loops and repeated links do no harm, an empty table gives no rows.
    """
    edges = checkpointed(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter("a < b").distinct())
    state = _summary(edges)
    while state[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(lowest, "u").filter("v > u")
                 .select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())
        parent = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(parent, "b").filter("a > m")
            .select(F.col("m").alias("a"), F.col("a").alias("b"))
            .unionByName(parent.select(F.col("m").alias("a"), "b")).distinct()
        )
        edges = checkpointed(small)
        before, state = state, _summary(edges)
        if state == before:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
