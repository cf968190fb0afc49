"""Connected components without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, settings

#: Nodes whose least neighbours are sent to every task at most (32 MB).
MAX_SENT = 2_000_000


def components(edges: DataFrame, temp: Scratch, name: str = "components") -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node that it reaches.

    Large and small stars take turns: each node's larger, then smaller
    neighbours are hung on the smallest one, until nothing moves. Every turn is
    two aggregations with partial sums and two joins, and is written, so that
    lineage stays short; turns grow with the logarithm of the longest path. A node
    with very many neighbours would be one large key of the joins: up to MAX_SENT
    nodes are sent to every task with their least neighbour, and beyond that adaptive
    execution is told to split such a key even where that costs another shuffle.
    The result reads a table of temp.
    """
    spark = edges.sparkSession
    edges = temp.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), name)
    edges_left, before = edges.count(), None
    while True:
        # No edge has more than two nodes, and no turn adds edges between others.
        sent = F.broadcast if 2 * edges_left <= MAX_SENT else lambda x: x
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(sent(least), "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(sent(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        with settings(spark, {"spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}):
            edges = temp.written(small, name)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        edges_left, before = state[0], state
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")))
    return nodes.groupBy("node").agg(F.min("component").alias("component"))
