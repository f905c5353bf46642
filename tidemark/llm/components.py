"""Connected components by alternating large and small stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import written


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node reachable.

    A large star links each node's larger neighbours to its smallest one, a small star the smaller
    ones. Repeated until every component is a star around its smallest node, after a number of rounds
    that grows with the logarithm of its size. A round's edges are written to the shared folder. Edges
    with a null and loops are ignored. The smallest neighbour is a map-side minimum, and where it meets
    the edges again the side of the minima is unique, so Spark can split a hub.
    """
    ends = edges.select(F.greatest(a, b).alias("_u"), F.least(a, b).alias("_v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    current = written(ends.distinct(), "components")
    while not _stars(current):
        current = written(_small_star(_large_star(current)), "components")
    # Every edge leads to a root, and the roots are their own.
    return current.select(F.col("_u").alias("node"), F.col("_v").alias("root")).union(
        current.select("_v", "_v").distinct()
    )


def _stars(edges: DataFrame) -> bool:
    """Whether each node is a root, or has one edge that leads to a root.

    An edge leads from its larger end to its smaller one, so the middle of such a star is its smallest
    node.
    """
    ends = F.array(
        F.struct(F.col("_u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")),
        F.struct(F.col("_v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")),
    )
    nodes = edges.select(F.inline(ends)).groupBy("node")
    counts = nodes.agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    wrong = (F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))
    return not counts.agg(F.coalesce(F.max(wrong), F.lit(False))).first()[0]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("_u", "_v").union(edges.select(F.col("_v"), F.col("_u")))
    least = both.groupBy(F.col("_u").alias("_c")).agg(F.min("_v").alias("_m"))
    least = least.select("_c", F.least("_c", "_m").alias("_m"))
    larger = both.where(F.col("_v") > F.col("_u"))
    return larger.join(least, larger["_u"] == least["_c"]).select(
        F.col("_v").alias("_u"), F.col("_m").alias("_v")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("_u").alias("_c")).agg(F.min("_v").alias("_m"))
    moved = edges.join(least, edges["_u"] == least["_c"]).where(F.col("_v") != F.col("_m"))
    return moved.select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).union(least).distinct()
