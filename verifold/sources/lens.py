"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log: one row per event, its delta both as columns (d_value, d_k) and as JSON (delta)."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    turn = F.col("event_id") % 3
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.lit("user").alias("namespace"), F.col("ts").alias("timestamp"),
        F.when(turn == 0, "USER").when(turn == 1, "AGENT").otherwise("SYSTEM").alias("actor"),
        F.when(F.col("event_type") == "signup", "PLANT").when(F.col("event_type") == "purchase", "ADD").when(F.col("event_type") == "error", "REMOVE").when(F.col("event_type") == "click", "UPDATE").otherwise("OBSERVE").alias("action"),
        F.col("user_id").alias("object_id"), F.col("value").alias("d_value"), k.alias("d_k"),
        F.to_json(F.struct(F.col("value"), k.alias("k"))).alias("delta"),
        (F.lit(0.5) + (F.col("event_id") % 50) / 100.0).cast("double").alias("confidence"),
        F.when(turn == 0, 1.0).when(turn == 1, 0.5).otherwise(0.8).cast("double").alias("authority"),
        F.lit(1.0).alias("freshness"), (F.col("user_id") % 4).cast("double").alias("corroboration"),
        F.when(F.col("event_type") == "signup", "identity").when(F.col("event_type") == "purchase", "fact").when(F.col("event_type") == "view", "preference").when(F.col("event_type") == "click", "event").otherwise("prediction").alias("memory_type"),
    )


def value_rows(ev: DataFrame) -> DataFrame:
    """Long form of the one key `value`."""
    return ev.select("object_id", F.lit("value").alias("key"), "timestamp", "id", "action", F.col("d_value").alias("num"), F.col("d_value").cast("string").alias("raw"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("entity_type"), F.col("c_name").alias("name"), F.lit(None).cast("bigint").alias("merged_into"))


def customer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity states from orders: last access, access count, authority from the account balance."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_accessed"), F.count(F.lit(1)).alias("access_count"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    authority = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("c_acctbal") + 1000.0) / 11000.0))
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select(F.col("c_custkey").alias("id"), authority.alias("authority"), "last_accessed", F.coalesce("access_count", F.lit(0)).alias("access_count"), F.lit("active").alias("status"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges: suppliers are part of nations, nations of regions, customers are located in nations."""
    s, n, c = (table(spark, sf_dir, t) for t in ("supplier", "nation", "customer"))
    named = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    rows = [
        s.select(named("S", "s_suppkey").alias("source_id"), named("N", "s_nationkey").alias("target_id"), F.lit("part_of").alias("relation_type"), F.lit(0.9).alias("confidence")),
        n.select(named("N", "n_nationkey").alias("source_id"), named("R", "n_regionkey").alias("target_id"), F.lit("part_of").alias("relation_type"), F.lit(0.8).alias("confidence")),
        c.select(named("C", "c_custkey").alias("source_id"), named("N", "c_nationkey").alias("target_id"), F.lit("located_in").alias("relation_type"), F.lit(0.95).alias("confidence")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector points with truth facts."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("kind"), F.concat(F.lit("entity "), F.col("vec_id").cast("string")).alias("name"), F.col("vec_id").alias("created_at"), F.col("embedding").alias("vec"),
        (F.lit(0.5) + (F.col("vec_id") % 50) / 100.0).cast("double").alias("confidence"), F.when(F.col("vec_id") % 2 == 0, 1.0).otherwise(0.5).alias("authority"), F.lit(1.0).alias("freshness"),
    )


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories with a truth vector."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("namespace"),
        (F.lit(0.5) + (F.col("doc_id") % 50) / 100.0).cast("double").alias("confidence"), F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.5).alias("authority"), F.lit(1.0).alias("freshness"), F.lit(0.0).alias("corroboration"),
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence per event, of twelve kinds by number: (id, namespace, ord, timestamp, user, kind, text)."""
    k, day = F.get_json_object("props", "$.k"), F.date_format("ts", "yyyy-MM-dd")
    kind = F.col("event_id") % 12
    said = [
        F.concat(F.lit("I am from Town"), k, F.lit(" and I like tea "), k, F.lit(".")),
        F.concat(F.lit("My favorite colour is shade "), k, F.lit("!")),
        F.concat(F.lit("I hate rain on day "), k),
        F.concat(F.lit("I always walk, call me P"), k),
        F.concat(F.lit("He stopped work at Firm"), k),
        F.concat(F.lit("I'm employed at Firm"), k, F.lit(", based in Town"), k),
        F.concat(F.lit("I usually enjoy nothing unlike part "), k),
        F.concat(F.lit("I prefer number "), k, F.lit(" of the very long list of things that nobody in this town has ever heard of.")),
        F.concat(F.lit("I live in Town"), k, F.lit(". They aren't here.")),
        F.concat(F.lit("Mail a"), k, F.lit("@x-"), k, F.lit(".org or see https://x"), k, F.lit(".org/a?b=1 from 10.0."), k, F.lit(".7 on "), day),
        F.lit("I LOVE   quiet days!! "),
        F.concat(F.lit("Schedule a meeting today, I like rain on day "), k),
    ]
    text = F.lit(None).cast("string")
    for i, c in enumerate(said):
        text = F.when(kind == i, c).otherwise(text)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("namespace"), F.col("event_id").alias("ord"), F.col("ts").alias("timestamp"),
        F.when(F.col("event_id") % 5 == 0, "agent").otherwise("user").alias("source"), kind.alias("kind"), k.alias("k"), text.alias("text"),
    )


def statement_names(rows: DataFrame) -> DataFrame:
    """(id, label, value) of the names in statements(), as a model would find them."""
    name = lambda prefix: F.concat(F.lit(prefix), F.col("k"))
    found = F.array(
        F.when(F.col("kind") == 0, F.struct(F.lit("GPE").alias("label"), name("Town").alias("value"))),
        F.when(F.col("kind") == 3, F.struct(F.lit("PERSON").alias("label"), name("P").alias("value"))),
        F.when(F.col("kind") == 4, F.struct(F.lit("ORG").alias("label"), name("Firm").alias("value"))),
        F.when(F.col("kind") == 5, F.struct(F.lit("ORGANIZATION").alias("label"), name("Firm").alias("value"))),
        F.when(F.col("kind") == 5, F.struct(F.lit("LOCATION").alias("label"), name("Town").alias("value"))),
        F.when(F.col("kind") == 8, F.struct(F.lit("LOC").alias("label"), name("Town").alias("value"))),
    )
    return rows.select("id", F.explode(F.array_compact(found)).alias("e")).select("id", "e.label", "e.value")
