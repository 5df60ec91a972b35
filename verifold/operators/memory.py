"""What a memory is told and asked: texts become events, states, entities and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, truth

# The labels of entities that become memories of their own, and the confidence of one that names none.
ENTITY_LABELS = ("PERSON", "ORG", "GPE", "PRODUCT")
ENTITY_CONFIDENCE, DERIVED_AUTHORITY = 0.9, 0.9


def remembered(rows: DataFrame, seen: DataFrame | None = None, namespace: str = "default") -> DataFrame:
    """Events of rows (ord, timestamp, entity_id, content, source, confidence, authority, memory_type).

    The first event of an entity that isn't among seen (rows entity_id) is an ADD, any other an UPDATE; a user's word has
    an authority of at least 0.9. Rows without an entity are entities of their own, named by a hash of row and text.
    """
    entity = F.coalesce(F.col("entity_id").cast("string"), F.sha2(F.concat_ws("\x1f", F.col("ord").cast("string"), F.coalesce("content", F.lit(""))), 256))
    named = rows.withColumn("entity_id", entity)
    w = Window.partitionBy("entity_id").orderBy("timestamp", "ord")
    first = F.row_number().over(w) == 1
    if seen is not None:
        known = seen.select(F.col("entity_id").cast("string").alias("_e")).distinct().withColumn("_seen", F.lit(True))
        named = named.join(known, F.col("entity_id") == F.col("_e"), "left").drop("_e")
        first = first & F.col("_seen").isNull()
    return named.select(
        F.sha2(F.concat_ws("\x1f", F.col("ord").cast("string"), "entity_id"), 256).alias("id"), F.lit(namespace).alias("namespace"), "timestamp", "ord",
        truth.actor_of(F.col("source")).alias("actor"), F.when(first, "ADD").otherwise("UPDATE").alias("action"), F.col("entity_id").alias("object_id"),
        F.to_json(F.struct(F.col("content"), F.col("memory_type").alias("type"), F.lit(namespace).alias("namespace"))).alias("delta"), "content", "memory_type", "source",
        "confidence", truth.source_authority(F.col("authority"), F.col("source")).alias("authority"), F.lit(1.0).alias("freshness"), F.lit(0.0).alias("corroboration"),
    )


def states(events: DataFrame) -> DataFrame:
    """(object_id, content, memory_type, version, last_event_id and the truth vector): what each entity's last event said."""
    last = F.max_by(F.struct("id", "content", "memory_type", *truth.PARTS), F.struct("timestamp", "ord"))
    g = events.groupBy("object_id").agg(last.alias("_l"), F.count(F.lit(1)).alias("version"))
    return g.select("object_id", F.col("_l.content").alias("content"), F.col("_l.memory_type").alias("memory_type"), "version", F.col("_l.id").alias("last_event_id"), *[F.col(f"_l.{c}").alias(c) for c in truth.PARTS])


def derived(events: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Memories that a user's texts give rise to: (object_id, kind, content, relation, target, confidence, authority).

    named: entities (id, label, value[, confidence]) of the events, from patterns or a model. Entities of ENTITY_LABELS
    become memories of their value, relations memories of what they state; object_id is the entity that was spoken of.
    """
    said = events.where("source = 'user'").select("id", "object_id", F.col("content").alias("text"))
    found = text.relation_patterns(said, None if named is None else named.select("id", "label", "value"))
    facts = found.select("id", F.lit("relation").alias("kind"), F.concat(F.lit("USER "), "relation", F.lit(" "), "object").alias("content"), "relation", F.col("object").alias("target"), "confidence")
    if named is not None:
        sure = F.coalesce("confidence", F.lit(ENTITY_CONFIDENCE)) if "confidence" in named.columns else F.lit(ENTITY_CONFIDENCE)
        own = named.where(F.col("label").isin(*ENTITY_LABELS) & (F.col("value") != "")).select("id", F.lit("entity").alias("kind"), F.col("value").alias("content"), F.col("label").alias("relation"), F.col("value").alias("target"), sure.alias("confidence"))
        facts = facts.unionByName(own)
    return facts.join(said.select("id", "object_id"), "id").select("object_id", "kind", "content", "relation", "target", "confidence", F.lit(DERIVED_AUTHORITY).alias("authority"))


def loaded(all_states: DataFrame, namespace: str) -> DataFrame:
    """The states of one namespace."""
    return all_states.where(F.col("namespace") == namespace)


def truth_scores(all_states: DataFrame, ids: DataFrame) -> DataFrame:
    """(object_id, score) of the entities asked for (rows object_id); unknown ones give no row."""
    return all_states.join(ids.select("object_id").distinct(), "object_id", "left_semi").select("object_id", truth.score().alias("score"))


def cleared(all_states: DataFrame, namespace: Column) -> DataFrame:
    """The states without those of a namespace."""
    return all_states.where(~F.col("namespace").eqNullSafe(namespace))
