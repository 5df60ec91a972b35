"""Typed relations: upserts, neighbours, paths and inference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("source_id", "target_id", "relation_type")
HOP_LOSS = 0.9


def upserted(edges: DataFrame) -> DataFrame:
    """One row per (source, target, type) of a log of writes (…, confidence, is_inferred, metadata map, ord).

    The last confidence and confirmation, the first is_inferred and creation, and the metadata of all writes merged, later keys over earlier ones.
    """
    merged = F.aggregate(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", F.map_entries("metadata").alias("m")))), lambda x: F.coalesce(F.map_from_entries(x["m"]), F.create_map().cast("map<string,string>"))),
        F.create_map().cast("map<string,string>"),
        lambda old, new: F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new),
    )
    return edges.groupBy(*KEY).agg(
        F.max_by("confidence", "ord").alias("confidence"), F.min_by("is_inferred", "ord").alias("is_inferred"),
        F.min("ord").alias("created_ord"), F.max("ord").alias("confirmed_ord"), F.count(F.lit(1)).alias("writes"), merged.alias("metadata"),
    )


def relations(edges: DataFrame, nodes: DataFrame, direction: str = "both") -> DataFrame:
    """(node, neighbor, direction, relation_type, confidence) for rows (node): outgoing, incoming or both.

    Two equi-joins instead of one disjunction, which would be a nested loop; an edge from a node to itself counts once.
    """
    out = nodes.join(edges, nodes["node"] == edges["source_id"]).select("node", F.col("target_id").alias("neighbor"), F.lit("out").alias("direction"), "relation_type", "confidence")
    into = nodes.join(edges, nodes["node"] == edges["target_id"]).where("source_id <> target_id").select("node", F.col("source_id").alias("neighbor"), F.lit("in").alias("direction"), "relation_type", "confidence")
    return {"out": out, "in": into}.get(direction) or out.unionByName(into)


def without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select(*KEY).distinct(), list(KEY), "left_anti")


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 3) -> DataFrame:
    """(start, goal, hops, path) for rows (start, goal): a shortest path over outgoing edges, the first by node names.

    Searches level by level; a node is entered once per start, on its first path, so that dense graphs don't blow up.
    start = goal is a path of no hops. Goals out of reach give no row.
    """
    step = edges.select(F.col("source_id").alias("_s"), F.col("target_id").alias("_t")).distinct()
    starts = pairs.select("start").distinct()
    seen = frontier = starts.select("start", F.col("start").alias("node"), F.array(F.col("start")).alias("path"))
    for _ in range(max_hops):
        reach = frontier.join(step, F.col("node") == F.col("_s")).select("start", F.col("_t").alias("node"), F.array_append("path", F.col("_t")).alias("path"))
        frontier = reach.groupBy("start", "node").agg(F.min("path").alias("path")).join(seen.select("start", "node"), ["start", "node"], "left_anti")
        seen = seen.unionByName(frontier)
    found = pairs.join(seen.withColumnRenamed("node", "goal"), ["start", "goal"])
    return found.select("start", "goal", (F.size("path") - 1).alias("hops"), F.array_join("path", ">").alias("path"))


def common_neighbors(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, neighbor) for rows (a, b): what both point at, by any relation."""
    out = edges.select("source_id", "target_id").distinct()
    left = pairs.join(out.toDF("a", "neighbor"), "a")
    return left.join(out.toDF("b", "neighbor"), ["b", "neighbor"], "left_semi").select("a", "b", "neighbor").distinct()


def transitive(edges: DataFrame, kind: str = "part_of", loss: float = HOP_LOSS) -> DataFrame:
    """Edges A-C of a kind that two edges A-B and B-C imply; confidence is their product times the loss, the best way counts."""
    own = edges.where(F.col("relation_type") == kind)
    second = own.select(F.col("source_id").alias("_m"), F.col("target_id").alias("_to"), F.col("confidence").alias("_c"))
    two = own.join(second, F.col("target_id") == F.col("_m")).select("source_id", F.col("_to").alias("target_id"), "relation_type", (F.col("confidence") * F.col("_c") * loss).alias("confidence"))
    g = two.groupBy(*KEY).agg(F.max("confidence").alias("confidence"))
    return g.withColumn("is_inferred", F.lit(True)).withColumn("metadata", F.create_map(F.lit("rule"), F.lit("transitivity")))


def with_transitive(edges: DataFrame, kind: str = "part_of", loss: float = HOP_LOSS) -> DataFrame:
    """edges with the inferred ones written after them: an explicit edge keeps that it is explicit, but takes the inferred confidence."""
    log = edges.select(*KEY, "confidence", F.lit(False).alias("is_inferred"), F.create_map().cast("map<string,string>").alias("metadata"), F.lit(0).alias("ord"))
    return upserted(log.unionByName(transitive(edges, kind, loss).withColumn("ord", F.lit(1))))


def path_confidence(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """paths (start, goal, hops, path joined by >) with confidence, the product over the path's edges, of each the most confident relation."""
    best = edges.groupBy("source_id", "target_id").agg(F.max("confidence").alias("_c"))
    nodes = F.split("path", ">")
    steps = paths.where("hops > 0").select("start", "goal", F.explode(F.transform(F.sequence(F.lit(0), F.col("hops").cast("int") - 1), lambda i: F.struct(F.get(nodes, i).alias("a"), F.get(nodes, i + 1).alias("b")))).alias("s"))
    product = steps.join(best, (F.col("s.a") == F.col("source_id")) & (F.col("s.b") == F.col("target_id"))).groupBy("start", "goal").agg(F.product("_c").alias("_p"))
    return paths.join(product, ["start", "goal"], "left").withColumn("confidence", F.coalesce("_p", F.lit(1.0))).drop("_p")


def symmetric(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """The reverse of edges whose kind holds both ways, where it isn't there yet."""
    back = edges.where(F.col("relation_type").isin(kinds)).select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "relation_type", "confidence")
    return back.join(edges.select(*KEY), list(KEY), "left_anti").withColumn("is_inferred", F.lit(True))


def inverse(edges: DataFrame, names: dict[str, str]) -> DataFrame:
    """Reverse edges under the inverse kind's name."""
    name = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return edges.where(F.col("relation_type").isin(list(names))).select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), name[F.col("relation_type")].alias("relation_type"), "confidence", F.lit(True).alias("is_inferred"))


def single_valued(edges: DataFrame, kind: str) -> DataFrame:
    """Sources with more than one target of a kind that allows one: (source_id, n_targets, kept), kept the most confident."""
    g = edges.where(F.col("relation_type") == kind).groupBy("source_id").agg(F.count_distinct("target_id").alias("n_targets"), F.max_by("target_id", F.struct("confidence", "target_id")).alias("kept"))
    return g.where("n_targets > 1")


def pruned(edges: DataFrame, least: float = 0.5) -> DataFrame:
    return edges.where(F.col("confidence") >= least)
