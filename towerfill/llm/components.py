"""Connected components of an edge table (``a`` long, ``b`` long) by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towerfill.llm.common import cut_lineage


def _least(edges: DataFrame, up: bool) -> DataFrame:
    """Each node's least neighbour or itself, joined to its edges; ``up``: to larger neighbours, else to smaller ones."""
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if up:
        both = both.union(both.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    j = both.join(low, "u")
    if up:
        return j.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    return (j.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``label``): every node of an edge and the smallest node of its component.

    Each round's edges are written to the shared folder; rounds grow with the
    logarithm of the longest path. A hub's edges are split by Spark's skew join,
    and its least neighbour is a partial aggregate. Loops and repeated edges are
    allowed; no edges give no nodes.
    """
    e = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        e = cut_lineage(_least(_least(e, True), False), "edges")
        # all edges are stars when no node is both a centre and a leaf
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    leaves = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    return leaves.union(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
