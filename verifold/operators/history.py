"""Snapshots, traces, ancestry and transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import frozen
from . import state


def take_snapshots(states: DataFrame) -> DataFrame:
    """states with state_hash: SHA-256 over entity, key and value, which no clock enters."""
    text = F.concat_ws("|", F.col("object_id").cast("string"), "key", F.coalesce("raw", F.format_string("%.6f", "num")))
    return states.withColumn("state_hash", F.sha2(text, 256))


def latest_snapshot(snapshots: DataFrame, before: Column | None = None) -> DataFrame:
    """Each entity's newest snapshot strictly before a time."""
    rows = snapshots if before is None else snapshots.where(F.col("timestamp") < before)
    rest = [c for c in snapshots.columns if c != "object_id"]
    best = rows.groupBy("object_id").agg(F.max_by(F.struct(*rest), F.struct("timestamp", "id")).alias("_s"))
    return best.select("object_id", *[F.col(f"_s.{c}").alias(c) for c in rest])


def with_namespace(snapshots: DataFrame, entities: DataFrame, default: str = "user") -> DataFrame:
    """snapshots with their entity's namespace, or the default."""
    names = entities.select(F.col("id").alias("_id"), F.col("namespace").alias("_ns"))
    return snapshots.join(names, F.col("object_id") == F.col("_id"), "left").withColumn("namespace", F.coalesce("_ns", F.lit(default))).drop("_id", "_ns")


def compact(snapshots: DataFrame, at: Column, days: int = 30) -> DataFrame:
    """Without snapshots older than so many days."""
    return snapshots.where(F.col("timestamp") >= at - F.expr(f"INTERVAL {days} DAYS"))


def retained(snapshots: DataFrame, at: Column) -> DataFrame:
    """Tiered retention: of the last day all, then the last of each day for 7 days, of each week for 30, then of each month."""
    age = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("timestamp").cast("timestamp"))) / F.lit(8.64e10)
    tier = F.when(age <= 1, "all").when(age <= 7, "day").when(age <= 30, "week").otherwise("month")
    slot = F.when(age <= 1, F.col("timestamp").cast("string")).when(age <= 7, F.date_trunc("day", "timestamp").cast("string")).when(age <= 30, F.date_trunc("week", "timestamp").cast("string")).otherwise(F.date_trunc("month", "timestamp").cast("string"))
    w = Window.partitionBy("object_id", "tier", "_slot").orderBy(F.desc("timestamp"), F.desc("id"))
    return snapshots.withColumn("tier", tier).withColumn("_slot", slot).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_slot")


def traces(events: DataFrame, states: DataFrame) -> DataFrame:
    """A golden trace per entity: final_state and its events in order. Entities without a state have none."""
    own = events.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "id", "actor", "action", "delta"))).alias("events"))
    return states.join(own, "object_id").select(F.col("object_id").alias("entity_id"), F.col("current_value").alias("final_state"), "events")


def ancestry(events: DataFrame) -> DataFrame:
    """(object_id, n_events, chain, fingerprint): an entity's event ids in time order, and SHA-256 of the sorted ids, comma-joined."""
    ids = F.array_sort(F.collect_list(F.struct("timestamp", "id")))
    g = events.groupBy("object_id").agg(F.count(F.lit(1)).alias("n_events"), ids.alias("_e"))
    chain = F.transform("_e", lambda x: x["id"].cast("string"))
    return g.select("object_id", "n_events", F.array_join(chain, ",").alias("chain"), F.sha2(F.array_join(F.array_sort(chain), ","), 256).alias("fingerprint"))


def running_ancestry(events: DataFrame) -> DataFrame:
    """events with chain_length, how long the entity's chain is with each of them."""
    w = Window.partitionBy("object_id").orderBy("timestamp", "id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("chain_length", F.count(F.lit(1)).over(w))


def causes(events: DataFrame) -> DataFrame:
    """(id, cause, depth): every event that an event's antecedents lead to, by the shortest way.

    Each round doubles the depth covered: what lies further than `reach` begins with a way of just that length.
    """
    step = events.select("id", F.explode("antecedents").alias("cause")).distinct()
    found, reach = frozen(step.withColumn("depth", F.lit(1)), "causes"), 1
    while True:
        far = found.where(F.col("depth") == reach).select("id", F.col("cause").alias("_m"))
        on = far.join(found.select(F.col("id").alias("_m"), "cause", F.col("depth").alias("_more")), "_m")
        after = on.groupBy("id", "cause").agg((F.min("_more") + F.lit(reach)).alias("depth"))
        after = frozen(after.join(found.select("id", "cause"), ["id", "cause"], "left_anti"), "causes")
        if after.isEmpty():
            return found
        found, reach = frozen(found.unionByName(after), "causes"), 2 * reach


def transfers(roots: DataFrame, known: DataFrame) -> DataFrame:
    """Long-form rows of transfers (id, timestamp, object_id, transfer_to, qty): a REMOVE at the source, an ADD at the target, each only for entities known."""
    q = F.coalesce("qty", F.lit(0.0))
    pair = F.array(F.struct(F.col("object_id").alias("object_id"), F.lit("REMOVE").alias("action"), q.alias("num")), F.struct(F.col("transfer_to").alias("object_id"), F.lit("ADD").alias("action"), q.alias("num")))
    each = roots.select("id", "timestamp", F.explode(pair).alias("p")).select("p.object_id", F.lit("inventory").alias("key"), "timestamp", "id", "p.action", "p.num", F.col("p.num").cast("string").alias("raw"))
    return each.join(known.select("object_id").distinct(), "object_id", "left_semi")


def transactions(roots: DataFrame, known: DataFrame) -> DataFrame:
    """Long-form rows of root events (id, timestamp, object_id, action, delta, transfer_to, qty): an UPDATE that names a
    transfer moves the quantity, any other event applies to its own entity alone, if that is known."""
    moves = (F.col("action") == "UPDATE") & F.col("transfer_to").isNotNull()
    moved = transfers(roots.where(moves), known)
    alone = roots.where(~F.coalesce(moves, F.lit(False))).join(known.select("object_id").distinct(), "object_id", "left_semi")
    rows = state.long_form(alone.select("id", "timestamp", "object_id", "action", "delta"))
    return moved.unionByName(rows.select(*moved.columns))


def transacted(roots: DataFrame, known: DataFrame) -> DataFrame:
    """(object_id, key, num, raw, version, last_event_id, updated_at and the truth vector): the states that root events leave.

    Both sides of a transfer take the id, time and truth vector of their root, and so does the entity of any other event.
    An entity of which events say nothing has a row with a null key.
    """
    moves = F.coalesce((F.col("action") == "UPDATE") & F.col("transfer_to").isNotNull(), F.lit(False))
    sides = F.when(moves, F.array_distinct(F.array("object_id", "transfer_to"))).otherwise(F.array("object_id"))
    vector = [c for c in state.VECTOR if c in roots.columns]
    touched = roots.select("id", "timestamp", *vector, F.explode(sides).alias("object_id")).join(known.select("object_id").distinct(), "object_id", "left_semi")
    return state.heads(touched).join(state.fold(transactions(roots, known)), "object_id", "left")


def provenance(events: DataFrame, ids: DataFrame) -> DataFrame:
    """(object_id, chain) of the entities asked for (rows object_id): the ids of their events in time order."""
    return ancestry(events.join(ids.select("object_id").distinct(), "object_id", "left_semi")).select("object_id", "chain")


#: Two lanes of 60 bits of an id's MD5; a set's hash is the sum of its ids' lanes, so that it doesn't depend on order and parts can be added.
LANES = ((1, 15), (16, 15))
LANE_SIZE = 1 << 60


def set_hash(events: DataFrame) -> DataFrame:
    """(object_id, n_events, low, high): a fingerprint of an entity's event ids that needs no list of them.

    Works on batches and streams; of two disjoint parts of a log, added() gives that of both. An id that comes twice counts
    twice, so streams that repeat events drop the repeats first. Null ids take no part.
    """
    digest = F.md5(F.col("id").cast("string").cast("binary"))
    lane = lambda i, n: F.sum(F.conv(F.substring(digest, i, n), 16, 10).cast("decimal(20,0)"))
    (a, an), (b, bn) = LANES
    g = events.where("id is not null").groupBy("object_id").agg(F.count(F.lit(1)).alias("n_events"), lane(a, an).alias("low"), lane(b, bn).alias("high"))
    return _wrapped(g)


def _wrapped(g: DataFrame) -> DataFrame:
    size = F.lit(LANE_SIZE).cast("decimal(20,0)")
    return g.select("object_id", "n_events", F.pmod("low", size).cast("long").alias("low"), F.pmod("high", size).cast("long").alias("high"))


def added(parts: DataFrame) -> DataFrame:
    """The set hashes of entities from those of parts of their events, in any order."""
    big = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    return _wrapped(parts.groupBy("object_id").agg(F.sum("n_events").alias("n_events"), big("low"), big("high")))
