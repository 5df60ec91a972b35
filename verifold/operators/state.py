"""Derived state: the fold of an entity's events in closed form, and what builds on it.

Events in long form are rows (object_id, key, timestamp, id, action, num, raw): one per key of an event's delta, num the
value as a double where it is a number or boolean, raw its JSON text. In an entity's and key's order, a row is a reset if
its value or the one before is no number, or its action replaces; between resets values add up, REMOVE subtracts. The
first row is a reset whatever its action, so a first REMOVE stores its value as it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPLACES = ("UPDATE", "OBSERVE", "INFER")
VECTOR = ("confidence", "authority", "freshness", "corroboration")


def long_form(events: DataFrame, delta: str = "delta") -> DataFrame:
    """One row per key of a JSON delta; a null or malformed delta, or one that is no object, has no rows."""
    items = events.select("*", F.explode(F.from_json(F.col(delta), "map<string,variant>")).alias("key", "_v")).drop(delta)
    kind, raw = F.schema_of_variant("_v"), F.to_json("_v")
    number = F.when(kind == "BOOLEAN", (raw == "true").cast("double")).when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), raw.try_cast("double"))
    return items.withColumn("num", number).withColumn("raw", raw).drop("_v")


def segments(rows: DataFrame) -> DataFrame:
    """rows with seg, the number of resets so far, reset and part, what a row adds to its segment."""
    w = Window.partitionBy("object_id", "key").orderBy("timestamp", "id")
    reset = F.col("num").isNull() | F.lag("num").over(w).isNull() | F.col("action").isin(*REPLACES)
    marked = rows.withColumn("reset", reset).withColumn("seg", F.sum(F.col("reset").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.when(F.col("reset"), F.col("num")).when(F.col("action") == "REMOVE", -F.col("num")).otherwise(F.col("num"))
    return marked.withColumn("part", part)


def timeline(rows: DataFrame) -> DataFrame:
    """rows with state, the number that the key holds after each of them; null where it holds no number."""
    w = Window.partitionBy("object_id", "key", "seg").orderBy("timestamp", "id").rowsBetween(Window.unboundedPreceding, 0)
    return segments(rows).withColumn("state", F.when(F.col("num").isNotNull(), F.sum("part").over(w)))


def fold(rows: DataFrame) -> DataFrame:
    """(object_id, key, num, raw): each key's last state. raw is the JSON text of a state that one event set, else null.

    The last segment is found by a window maximum on the same partitioning, so that the fold has one exchange.
    """
    w = Window.partitionBy("object_id", "key")
    last = segments(rows).withColumn("_last", F.max("seg").over(w)).where("seg = _last")
    g = last.groupBy("object_id", "key").agg(F.sum("part").alias("num"), F.when(F.count(F.lit(1)) == 1, F.max("raw")).alias("raw"))
    return g


def heads(events: DataFrame) -> DataFrame:
    """(object_id, version, last_event_id, updated_at and the last event's truth vector) of each entity."""
    vector = [c for c in VECTOR if c in events.columns]
    last = F.max_by(F.struct("id", "timestamp", *vector), F.struct("timestamp", "id"))
    g = events.groupBy("object_id").agg(F.count(F.lit(1)).alias("version"), last.alias("_l"))
    return g.select("object_id", "version", F.col("_l.id").alias("last_event_id"), F.col("_l.timestamp").alias("updated_at"), *[F.col(f"_l.{c}").alias(c) for c in vector])


def active(events: DataFrame, include_consolidated: bool = False) -> DataFrame:
    """Events that count in a replay: those that no summary stands for."""
    if include_consolidated or "consolidated_into" not in events.columns:
        return events
    return events.where("consolidated_into IS NULL")


def replay(events: DataFrame, rows: DataFrame) -> DataFrame:
    """State per entity and key with the entity's head; entities without events have none."""
    return fold(rows).join(heads(events), "object_id")


def packed(state: DataFrame) -> DataFrame:
    """(object_id, current_value): an entity's keys as one map, in key order."""
    value = F.coalesce("raw", F.col("num").cast("string"))
    return state.groupBy("object_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", value.alias("value"))))).alias("current_value"))


def as_of(rows: DataFrame, at: Column) -> DataFrame:
    """Rows up to and including a time."""
    return rows.where(F.col("timestamp") <= at)


def compare(expected: DataFrame, actual: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Keys whose stored state differs from the replayed one, or that only one side has: (object_id, key, expected, actual, expected_raw, actual_raw).

    Numbers may differ by the tolerance; any other values are compared by their JSON text, nulls alike.
    """
    side = lambda df, name: df.select("object_id", "key", F.col("num").alias(name), F.when(F.col("num").isNull(), F.col("raw")).alias(name + "_raw"), F.lit(True).alias("_" + name))
    both = side(expected, "expected").join(side(actual, "actual"), ["object_id", "key"], "full")
    e, a = F.col("expected"), F.col("actual")
    same = F.when(e.isNotNull() & a.isNotNull(), F.abs(e - a) <= tolerance).otherwise(e.isNull() & a.isNull() & F.col("expected_raw").eqNullSafe(F.col("actual_raw")))
    return both.where(F.col("_expected").isNull() | F.col("_actual").isNull() | ~same).drop("_expected", "_actual")


def compare_vectors(expected: DataFrame, actual: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """(object_id, part, expected, actual): parts of the truth vectors of heads() that differ by more than the tolerance, or that one side lacks."""
    side = lambda df, name: df.select("object_id", F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("v")) for c in VECTOR])).alias("p")).select("object_id", "p.part", F.col("p.v").alias(name))
    both = side(expected, "expected").join(side(actual, "actual"), ["object_id", "part"], "full")
    return both.where(F.col("expected").isNull() | F.col("actual").isNull() | (F.abs(F.col("expected") - F.col("actual")) > tolerance))


def repair(log: DataFrame, late: DataFrame, states: DataFrame) -> DataFrame:
    """States after late rows: only the entities they touch are folded anew, the rest stay as they are."""
    touched = late.select("object_id").distinct()
    again = fold(log.unionByName(late).join(touched, "object_id", "left_semi"))
    kept = states.join(touched, "object_id", "left_anti")
    return kept.select("object_id", "key", "num", "raw", F.lit("kept").alias("status")).unionByName(again.select("object_id", "key", "num", "raw", F.lit("repaired").alias("status")))


def tail_replay(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """Fold of a snapshot (object_id, key, timestamp, num, raw) and the rows after it: the snapshot is a row that replaces."""
    seed = snapshot.select("object_id", "key", "timestamp", F.lit(-1).cast("long").alias("id"), F.lit("UPDATE").alias("action"), "num", "raw")
    return fold(seed.unionByName(tail.select("object_id", "key", "timestamp", F.col("id").cast("long").alias("id"), "action", "num", "raw")))


def upsert(old: DataFrame, new: DataFrame, key: str = "object_id", order: str = "updated_at") -> DataFrame:
    """The newest row per key of both; at one time, the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def deleted(states: DataFrame, gone: DataFrame, key: str = "object_id") -> DataFrame:
    """states without those of the keys in gone; a null key deletes nothing."""
    return states.join(gone.select(key).distinct(), key, "left_anti")


def counted(states: DataFrame, by: str = "namespace") -> DataFrame:
    """(namespace, n): how many states each namespace holds, and under a null namespace with is_total how many there are in all."""
    return states.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.grouping(by).cast("boolean").alias("is_total"))


def intervals(timeline: DataFrame) -> DataFrame:
    """(object_id, key, value, valid_from, valid_to): each state of a timeline from its event to the next, the last without an end.

    Of events at one time the last by id counts, so that no two intervals of an entity's key hold one instant.
    """
    last = timeline.groupBy("object_id", "key", "timestamp").agg(F.max_by("state", "id").alias("value"))
    w = Window.partitionBy("object_id", "key").orderBy("timestamp")
    return last.select("object_id", "key", "value", F.col("timestamp").alias("valid_from"), F.lead("timestamp").over(w).alias("valid_to"))
