"""Iterative graph plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import frozen


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as rows (a, b): returns (node, root), root the smallest node.

    Alternates large-star and small-star steps, so that no task ever holds a component; each round's edges are
    written to the shared folder. Only nodes with an edge to another node are returned. Loops, repeated edges and
    rows with a null are dropped, as they join nothing; an empty graph gives an empty result.
    """
    spark = edges.sparkSession
    e = frozen(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _mark(e)
    if not before[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the smallest of a node and its neighbours; dealt anew so that adaptive execution can split a hot node's rows
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).repartition(width)
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m")).repartition(width)
        small = down.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        e = frozen(small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct(), "edges")
        after = _mark(e)
        if after == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an undirected graph (a, b), the roots themselves and nodes that only meet themselves included."""
    found = connected_components(edges)
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).where("node is not null").distinct()
    return nodes.join(found.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", F.coalesce("root", "node").alias("root"))
