"""What recall rests on: the events behind a hit, and recall by what is true of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.order import numbered

#: Ids in a row of evidence at most.
CHUNK = 4096


def grounded(hits: DataFrame, events: DataFrame, facets: dict[str, Column], least: int = 1) -> DataFrame:
    """hits (query_id, id, score, …) whose entity has at least `least` events of every facet, ranked anew, with what they rest on.

    facets are conditions on events, which different events may meet; a condition that is null isn't met. Added are
    n_events, n_<facet> for each of them, first_id and last_id in time order. Events are counted by entity before they
    meet the hits, so that a busy entity is one row by then. Hits without any event go, and so do those with a null id.
    """
    order = F.struct("timestamp", "id")
    counts = events.where("object_id IS NOT NULL").groupBy(F.col("object_id").alias("_of")).agg(
        F.count(F.lit(1)).alias("n_events"), *[F.count_if(c).alias(f"n_{name}") for name, c in facets.items()],
        F.min_by("id", order).alias("first_id"), F.max_by("id", order).alias("last_id"),
    )
    for name in facets:
        counts = counts.where(F.col(f"n_{name}") >= least)
    kept = hits.drop("rank").join(counts, F.col("id") == F.col("_of")).drop("_of")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return kept.withColumn("rank", F.row_number().over(w).cast("long"))


def evidence(events: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(object_id, part, n, first_at, last_at, ids): the ids of an entity's events in time order, at most `chunk` of them a row.

    Events stand in one order and are cut where a chunk is full, so that no task or row holds all that a busy entity has;
    part counts an entity's rows from 0. Events without an entity are nobody's; repeated events come as often as they do.
    """
    own = events.where("object_id IS NOT NULL").select("object_id", "timestamp", "id")
    placed = numbered(own, [F.col("object_id"), F.col("timestamp"), F.col("id")]).withColumn("_run", F.floor(F.col("position") / chunk))
    g = placed.groupBy("object_id", "_run").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), F.array_sort(F.collect_list(F.struct("position", "id"))).alias("_ids"))
    part = F.row_number().over(Window.partitionBy("object_id").orderBy("_run")).cast("long") - 1
    return g.select("object_id", part.alias("part"), "n", "first_at", "last_at", F.transform("_ids", lambda x: x["id"]).alias("ids"))


def cited(hits: DataFrame, events: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The evidence of the entities that hits name, once for each entity however many hits it has: hits meet it by id."""
    named = hits.select(F.col("id").alias("object_id")).distinct()
    return evidence(events.join(named, "object_id", "left_semi"), chunk)
