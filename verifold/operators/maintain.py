"""Decay, pruning, consolidation and their schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import truth
from ..sources.shared import frozen
from . import identity, state

RECENCY_DAYS, LEAST_SCORE = 90.0, 0.3


def decay(states: DataFrame, entities: DataFrame, at: Column, least_days: float = 1.0, least_change: float = 0.01, stale: float = 0.1) -> DataFrame:
    """Active states whose freshness moved: (id, days, old_freshness, new_freshness, stale). Only entities on record decay."""
    joined = states.where("status = 'active'").join(entities.select("id", "memory_type"), "id")
    days = truth.days_between(at, F.col("updated_at"))
    new = truth.freshness(F.col("freshness"), F.col("days"), F.col("memory_type"))
    moved = joined.withColumn("days", days).withColumn("_new", new).where((F.col("days") >= least_days) & (F.abs(F.col("_new") - F.coalesce("freshness", F.lit(1.0))) >= least_change))
    return moved.select("id", "memory_type", "days", F.coalesce("freshness", F.lit(1.0)).alias("old_freshness"), F.round("_new", 4).alias("new_freshness"), (F.col("_new") < stale).alias("stale"))


def decay_totals(moved: DataFrame) -> DataFrame:
    return moved.agg(F.count(F.lit(1)).alias("updated"), F.count_if("stale").alias("stale"))


def pruning_score(at: Column, last_accessed: Column, authority: Column, access_count: Column) -> Column:
    """Half recency (whole days idle, of 90), 0.3 authority, 0.2 accesses on a log scale. Null access means now, null authority 0.5."""
    idle = F.floor(truth.days_between(at, F.coalesce(last_accessed, at)))
    recency = F.greatest(F.lit(0.0), 1 - idle / F.lit(RECENCY_DAYS))
    used = F.least(F.lit(1.0), F.log(F.coalesce(access_count, F.lit(0)) + 1.0) / F.log(F.lit(100.0)))
    return 0.5 * recency + 0.3 * F.coalesce(authority, F.lit(0.5)) + 0.2 * used


def prunable(states: DataFrame, at: Column, threshold: float = LEAST_SCORE, keep_important: bool = False) -> DataFrame:
    """Active states that score below the threshold; keep_important spares authority above 0.8 and the last 30 days."""
    scored = states.where("status = 'active'").withColumn("prune_score", pruning_score(at, F.col("last_accessed"), F.col("authority"), F.col("access_count")))
    found = scored.where(F.col("prune_score") < threshold)
    if keep_important:
        found = found.where(~((F.coalesce("authority", F.lit(0.5)) > 0.8) | (truth.days_between(at, F.col("last_accessed")) < 30)))
    return found


def with_status(states: DataFrame, ids: DataFrame, status: str, accessed: Column | None = None) -> DataFrame:
    """states with a new status where the id is among ids (rows id); no ids change nothing."""
    marked = states.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    out = marked.withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status")))
    if accessed is not None:
        out = out.withColumn("last_accessed", F.when(F.col("_hit"), accessed).otherwise(F.col("last_accessed")))
    return out.drop("_hit")


def prune(states: DataFrame, ids: DataFrame) -> DataFrame:
    return with_status(states, ids, "inactive")


def recover(states: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    return with_status(states, ids, "active", at)


def drop_untrue(states: DataFrame, threshold: float = LEAST_SCORE) -> DataFrame:
    """Without states whose truth score is below the threshold: another criterion than prunable()."""
    return states.where(truth.score() >= threshold)


def islands(events: DataFrame, at: Column, days: int = 30, keys: str = "keys") -> DataFrame:
    """Fresh, unconsolidated events with island, the number of their run of equal actor, action and key set within the entity.

    keys is an array or text column that names a delta's keys. One exchange on the entity serves both windows.
    """
    fresh = events.where((F.col("timestamp") > at - F.expr(f"INTERVAL {days} DAYS")) & F.col("consolidated_into").isNull())
    w = Window.partitionBy("object_id").orderBy("timestamp", "id")
    now = F.struct("actor", "action", keys)
    changed = F.coalesce((F.lag(now).over(w) != now).cast("long"), F.lit(1))
    return fresh.withColumn("_c", changed).withColumn("island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def runs(marked: DataFrame, least: int = 2) -> DataFrame:
    """(object_id, island, actor, action, n, first_id, last_id, first_ts, last_ts) of runs of at least so many events."""
    order = F.struct("timestamp", "id")
    g = marked.groupBy("object_id", "island").agg(
        F.first("actor").alias("actor"), F.first("action").alias("action"), F.count(F.lit(1)).alias("n"),
        F.min_by("id", order).alias("first_id"), F.max_by("id", order).alias("last_id"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
    )
    return g.where(F.col("n") >= least)


def consolidatable(events: DataFrame, at: Column, days: int = 7, most: float = 0.9) -> DataFrame:
    """Policy: without events of the last days and without those more important than `most` (a null importance is a half)."""
    keep = F.col("timestamp") <= at - F.expr(f"INTERVAL {days} DAYS")
    return events.where(keep & (truth.importance(F.col("importance")) <= most)) if "importance" in events.columns else events.where(keep)


def summaries(marked: DataFrame, least: int = 2, replay_safe: bool = False) -> DataFrame:
    """One SYSTEM event per run of marked events (…, delta as JSON): per key of the delta the sum where all its values are
    numbers, else the last; antecedents in order, namespace and truth vector of the first event, the time of the last.

    replay_safe keeps the last value of actions that replace, instead of the sum, so that a replay of the summary gives
    what a replay of its sources gave. values is the delta as a map of JSON texts, delta the same as one JSON text.
    """
    order = F.struct("timestamp", "id")
    firsts = [c for c in ("namespace", *truth.PARTS) if c in marked.columns]
    # single events are most of a log, and go before any delta is read; the count needs no exchange beyond that of islands()
    size = F.count(F.lit(1)).over(Window.partitionBy("object_id", "island"))
    marked = marked.withColumn("_size", size).where(F.col("_size") >= least).drop("_size")
    runs_ = marked.groupBy("object_id", "island").agg(
        F.count(F.lit(1)).alias("n"), F.first("action").alias("action"), F.max("timestamp").alias("timestamp"),
        F.transform(F.array_sort(F.collect_list(order)), lambda x: x["id"].cast("string")).alias("antecedents"),
        *[F.min_by(c, order).alias(c) for c in firsts],
    )
    rows = state.long_form(marked.select("object_id", "island", "timestamp", "id", "action", "delta"))
    total = F.when(F.count(F.lit(1)) == F.count("num"), F.sum("num"))
    if replay_safe:
        total = F.when(F.first("action").isin(*state.REPLACES), F.when(F.count(F.lit(1)) == F.count("num"), F.max_by("num", order))).otherwise(total)
    keys = rows.groupBy("object_id", "island", "key").agg(F.coalesce(total.cast("string"), F.max_by("raw", order)).alias("v"))
    values = keys.groupBy("object_id", "island").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "v")))).alias("values"))
    delta = F.to_json(F.transform_values("values", lambda _, v: F.parse_json(v)))
    named = runs_.join(values, ["object_id", "island"], "left").withColumn("actor", F.lit("SYSTEM")).withColumn("delta", delta)
    return named.withColumn("summary_id", F.concat(F.lit("summary-"), F.element_at("antecedents", 1)))


def consolidate(events: DataFrame, marked: DataFrame, least: int = 2, replay_safe: bool = False) -> DataFrame:
    """All events, sources of a run pointing at its summary by consolidated_into, and the summaries as events of their own.

    Columns: id (as text), object_id, timestamp, actor, action, delta, antecedents, consolidated_into and, where events
    have them, namespace and the truth vector.
    """
    made = frozen(summaries(marked, least, replay_safe), "summaries")
    more = [c for c in ("namespace", *truth.PARTS) if c in events.columns]
    into = marked.select("id", "object_id", "island").join(made.select("object_id", "island", "summary_id"), ["object_id", "island"]).select("id", F.col("summary_id").alias("_into"))
    old = events.join(into, "id", "left").select(
        F.col("id").cast("string").alias("id"), "object_id", "timestamp", "actor", "action", "delta",
        (F.col("antecedents") if "antecedents" in events.columns else F.array().cast("array<string>")).alias("antecedents"),
        F.coalesce("_into", "consolidated_into").alias("consolidated_into"), *more,
    )
    return old.unionByName(made.select(F.col("summary_id").alias("id"), "object_id", "timestamp", "actor", "action", "delta", "antecedents", F.lit(None).cast("string").alias("consolidated_into"), *more))


def consolidated_count(marked: DataFrame, least: int = 2) -> DataFrame:
    """One row: how many events summaries stand for."""
    return runs(marked, least).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("consolidated"))


def reinforced(states: DataFrame, accesses: DataFrame) -> DataFrame:
    """states after accesses (id, at): fresh again, accessed last when they were, and counted; the rest as they were."""
    hits = accesses.groupBy("id").agg(F.max("at").alias("_at"), F.count(F.lit(1)).alias("_n"))
    joined = states.join(hits, "id", "left")
    fresh = {"freshness": F.when(F.col("_n").isNotNull(), 1.0).otherwise(F.col("freshness"))} if "freshness" in states.columns else {}
    return joined.withColumns({**fresh, "last_accessed": F.greatest("last_accessed", "_at"), "access_count": F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0))}).drop("_at", "_n")


def weekly_merges(entities: DataFrame, kinds: tuple = ("person", "organization", "place"), threshold: float = 0.98) -> DataFrame:
    """Proposals of the greedy scan over entities (id, kind, name, created_at, vec) of some kinds, those above the threshold."""
    pairs = frozen(identity.duplicate_pairs(entities.where(F.col("kind").isin(*kinds)), threshold), "weekly-pairs")
    return identity.greedy(pairs).where(F.col("similarity") > threshold)


def merged_weekly(entities: DataFrame, proposals: DataFrame, at: Column) -> DataFrame:
    """entities after the weekly run: sources of its proposals point at their targets, all others stay as they are."""
    lacking = {c: F.lit(None).cast(t) for c, t in (("merged_into", entities.schema["id"].dataType), ("updated_at", "timestamp")) if c not in entities.columns}
    return identity.merge(entities.withColumns(lacking), proposals, at)


def reduction(run_rows: DataFrame) -> DataFrame:
    """How many events consolidation saves."""
    return run_rows.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("saved"))


def schedule(states: DataFrame, entities: DataFrame, at: Column, task: str = "all", vectors: DataFrame | None = None, alike: float = 0.98) -> dict[str, DataFrame]:
    """What a maintenance run does, as frames to act on: daily decay, monthly pruning and, where vectors are given (entities
    as weekly_merges() takes them), weekly proposals above `alike` and merged, the entities after them."""
    out = {}
    if task in ("daily", "all"):
        out["daily"] = decay(states, entities, at)
    if task in ("weekly", "all") and vectors is not None:
        out["weekly"] = frozen(weekly_merges(vectors, threshold=alike), "weekly")
        out["merged"] = merged_weekly(vectors, out["weekly"], at)
    if task in ("monthly", "all"):
        out["monthly"] = prunable(states, at)
    return out
