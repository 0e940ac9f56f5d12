"""Connected components of a graph given as edges, by rounds of large-star and small-star.

Every round is two joins-free aggregations over the edges; the number of rounds grows with the
logarithm of the longest path. No neighbourhood is gathered: a node only learns its smallest
neighbour, which is added up before the shuffle, and edges meet it in a join that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biascomp.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with a > b. Links neighbours of a node to the smallest of them and the node."""
    if large:  # every node looks at all neighbours
        both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(
            edges.select(F.col("b").alias("x"), F.col("a").alias("y"))
        )
    else:  # only at the smaller ones
        both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    linked = both.join(least, "x")
    if large:  # larger neighbours move to the smallest
        moved = linked.where("y > x").select(F.col("y").alias("a"), F.col("m").alias("b"))
    else:
        moved = linked.select(F.col("y").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("x").alias("a"), F.col("m").alias("b"))
        )
    return moved.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge in (a, b); the component is its smallest node."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges, before = written(edges, "edges"), None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        edges = written(_star(_star(edges, large=True), large=False), "edges")
    member = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return member.unionByName(roots)
