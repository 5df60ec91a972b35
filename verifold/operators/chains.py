"""Chains of causes and of times: what follows from a relation that carries over, by a recursive query with a guard against cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import frozen

#: What a chain of two or more steps of a kind says of its ends.
IMPLIED = {"caused": "may_have_caused", "happened_before": "happened_before"}


def steps(edges: DataFrame, kind: str) -> DataFrame:
    """(s, t, c) of a kind's edges, of repeated ones the most confident; loops and edges without an end or a confidence lead nowhere."""
    own = edges.where((F.col("relation_type") == kind) & (F.col("source_id") != F.col("target_id")) & F.col("confidence").isNotNull())
    return own.groupBy(F.col("source_id").alias("s"), F.col("target_id").alias("t")).agg(F.max("confidence").alias("c"))


def walks(step: DataFrame, max_hops: int = 4, least: float = 0.0) -> DataFrame:
    """(start, goal, path, confidence): every way of 1 to max_hops steps (s, t, c) that enters no node twice.

    Confidence is the product over the way. As it never grows, ways that fall below `least` are left at once, so that
    `least` bounds the search and not only its result. A level is one join with the steps; the session's limit of rows
    in a recursion is lifted for this query alone.
    """
    laid = frozen(step, "steps")
    return laid.sparkSession.sql(
        f"""WITH RECURSIVE way(start, goal, path, confidence) AS (
              SELECT s, t, array(s, t), c FROM {{laid}} WHERE c >= {least!r}D
              UNION ALL
              SELECT w.start, e.t, array_append(w.path, e.t), w.confidence * e.c FROM way w JOIN {{laid}} e ON w.goal = e.s
              WHERE NOT array_contains(w.path, e.t) AND size(w.path) <= {int(max_hops)} AND w.confidence * e.c >= {least!r}D)
            SELECT * FROM way LIMIT ALL""",
        laid=laid,
    )


def chains(edges: DataFrame, kind: str = "caused", max_hops: int = 4, least: float = 0.0) -> DataFrame:
    """(source_id, target_id, relation_type, hops, path, confidence, is_inferred): of each two ends the most confident chain.

    Of equal ones the shorter counts, then the first by its nodes. One step keeps its kind, more imply IMPLIED[kind].
    A node that a cycle leads back to itself implies nothing of itself; order_conflicts() lists those.
    """
    rank = F.struct((-F.round("confidence", 12)).alias("c"), F.size("path").alias("n"), F.col("path").alias("p"))
    best = walks(steps(edges, kind), max_hops, least).groupBy("start", "goal").agg(F.min_by(F.struct("path", "confidence"), rank).alias("_b"))
    hops = F.size("_b.path") - 1
    return best.select(
        F.col("start").alias("source_id"), F.col("goal").alias("target_id"), F.when(hops == 1, kind).otherwise(IMPLIED.get(kind, kind)).alias("relation_type"),
        hops.cast("long").alias("hops"), F.col("_b.path").alias("path"), F.col("_b.confidence").alias("confidence"), (hops > 1).alias("is_inferred"),
    )


def order_conflicts(edges: DataFrame, kind: str = "happened_before", max_hops: int = 4) -> DataFrame:
    """(node, path): nodes that come before themselves by at most max_hops + 1 steps, and the shortest way, of equal ones the first."""
    step = frozen(steps(edges, kind), "steps")
    back = step.select(F.col("s").alias("goal"), F.col("t").alias("start"))
    round_trips = walks(step, max_hops).join(back, ["start", "goal"]).select(F.col("start").alias("node"), F.array_append("path", F.col("start")).alias("path"))
    return round_trips.groupBy("node").agg(F.min_by("path", F.struct(F.size("path"), "path")).alias("path"))


def follows(events: DataFrame, seconds: int, of: list[str], kind: str = "happened_before") -> DataFrame:
    """Edges of a kind from each event (id, timestamp, confidence, ...) to the later ones of the same `of`, at most so many seconds after it.

    An event meets the events of its own stretch of time and of the next, so that a busy entity is many small keys and not
    one. Of one time, the smaller id comes first. An edge has the confidence of its earlier event.
    """
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    rows = events.select(*of, "id", "confidence", at.alias("us"), F.floor(at / F.lit(seconds * 1_000_000)).alias("stretch"))
    first = rows.withColumn("stretch", F.explode(F.array("stretch", F.col("stretch") + 1)))
    later = rows.select(*of, "stretch", F.col("id").alias("next_id"), F.col("us").alias("next_us"))
    met = first.join(later, [*of, "stretch"]).where(F.struct("us", "id") < F.struct("next_us", "next_id")).where(F.col("next_us") - F.col("us") <= seconds * 1_000_000)
    return met.select(F.col("id").alias("source_id"), F.col("next_id").alias("target_id"), F.lit(kind).alias("relation_type"), "confidence")
