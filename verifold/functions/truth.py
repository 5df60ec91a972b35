"""Truth vectors: score, decay, merging, and the other scalar rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Weights of the truth score, decay rates per day, legacy decay rates, source authority.
WEIGHTS = {"confidence": 1.0, "authority": 1.2, "freshness": 0.8, "corroboration": 0.6}
RATES = {"fact": 0.001, "preference": 0.01, "event": 0.1, "prediction": 0.5, "identity": 0.0}
OTHER_RATE = 0.02
LEGACY_RATES = {"identity": 0.0005, "preference": 0.005, "event": 0.02}
FLOOR = 0.01
USER_AUTHORITY = 0.9
PARTS = ("confidence", "authority", "freshness", "corroboration")


def score(confidence: Column | str = "confidence", authority: Column | str = "authority", freshness: Column | str = "freshness", corroboration: Column | str = "corroboration") -> Column:
    """Weighted sum of the four parts; corroboration counts by ln(1 + r). Null parts give null."""
    c, a, f, r = (F.col(x) if isinstance(x, str) else x for x in (confidence, authority, freshness, corroboration))
    w = WEIGHTS
    return w["confidence"] * c + w["authority"] * a + w["freshness"] * f + w["corroboration"] * F.log1p(r)


def days_between(later: Column, earlier: Column) -> Column:
    """Elapsed days with fractions."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(8.64e10)


def rate(memory_type: Column, rates: dict[str, float] | None = None) -> Column:
    """Decay per day by type; null and unknown types share one rate."""
    out = F.lit(OTHER_RATE)
    for kind, value in (RATES if rates is None else rates).items():
        out = F.when(memory_type == kind, F.lit(value)).otherwise(out)
    return out


def freshness(base: Column, days: Column, memory_type: Column) -> Column:
    """Exponential decay with a floor; types that don't decay are fully fresh. Future events may exceed 1; a null base is 1."""
    r = rate(memory_type)
    return F.when(r == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(FLOOR), F.coalesce(base, F.lit(1.0)) * F.exp(-r * days)))


def legacy_importance(importance: Column, memory_type: Column, days: Column) -> Column:
    return F.greatest(F.lit(FLOOR), importance * F.exp(-rate(memory_type, LEGACY_RATES) * days))


def importance(stored: Column) -> Column:
    return F.coalesce(stored, F.lit(0.5))


def source_authority(authority: Column, source: Column) -> Column:
    return F.when(source == "user", F.greatest(authority, F.lit(USER_AUTHORITY))).otherwise(authority)


def actor_of(source: Column) -> Column:
    return F.when(source == "user", "USER").otherwise("AGENT")


def merge_confidence(a: Column, b: Column) -> Column:
    """Confidence weighted by itself; 0 where both are 0."""
    return F.when(a + b == 0, F.lit(0.0)).otherwise((a * a + b * b) / (a + b))


def merged(events: DataFrame, by: str = "object_id") -> DataFrame:
    """One truth vector per entity: maxima, summed corroboration plus one per merge, and confidence folded in event order.

    Only the confidences of an entity are gathered, since their merge depends on the order; the rest combines map-side.
    """
    ordered = F.array_sort(F.collect_list(F.struct("timestamp", "id", "confidence")))
    g = events.groupBy(by).agg(
        ordered.alias("_o"), F.max("authority").alias("authority"), F.max("freshness").alias("freshness"),
        (F.sum("corroboration") + F.count(F.lit(1)) - 1).cast("double").alias("corroboration"),
    )
    first, rest = F.get("_o", F.lit(0))["confidence"], F.slice("_o", F.lit(2), F.size("_o"))
    return g.withColumn("confidence", F.aggregate(rest, first, lambda acc, x: merge_confidence(acc, x["confidence"]))).drop("_o")


def decay_curve(facts: DataFrame, days: int = 100) -> DataFrame:
    """(memory_type, day, freshness) at eleven points in time: how a fully fresh fact of each type that occurs in facts decays."""
    step = max(1, days // 10)
    each = facts.select("memory_type").distinct().select("memory_type", F.explode(F.sequence(F.lit(0), F.lit(days), F.lit(step))).alias("day"))
    return each.select("memory_type", F.col("day").cast("long").alias("day"), freshness(F.lit(1.0), F.col("day").cast("double"), F.col("memory_type")).alias("freshness"))


def faded(events: DataFrame, by: float = 0.01) -> DataFrame:
    """Every freshness times 1 - by."""
    return events.withColumn("freshness", F.col("freshness") * (1 - by))


def faded_count(events: DataFrame) -> DataFrame:
    """One row: how many facts have a freshness that fading lowers."""
    return events.agg(F.count_if(F.col("freshness") > 0).alias("decayed"))


def valid_vector(prefix: str = "") -> Column:
    """Whether confidence, authority and freshness lie in [0, 1] and corroboration isn't negative."""
    c, a, f, r = (F.col(prefix + p) for p in PARTS)
    return c.between(0, 1) & a.between(0, 1) & f.between(0, 1) & (r >= 0)


def create_events(rows: DataFrame, at: Column) -> DataFrame:
    """Events of (actor, action, object_id, delta[, namespace, confidence, authority]): deterministic ids, fresh truth vectors."""
    has = set(rows.columns)
    pick = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in has else F.lit(default)
    return rows.select(
        F.sha2(F.concat_ws("\x1f", at.cast("string"), "actor", "action", F.col("object_id").cast("string"), "delta"), 256).alias("id"),
        pick("namespace", "user").alias("namespace"), at.alias("timestamp"), "actor", "action", "object_id", "delta",
        F.array().cast("array<string>").alias("antecedents"), pick("confidence", 1.0).alias("confidence"), pick("authority", 1.0).alias("authority"),
        F.lit(1.0).alias("freshness"), F.lit(0.0).alias("corroboration"),
    )


def register_sql(spark: SparkSession) -> None:
    """truth_score() and decayed() for SQL, as plain SQL functions that the optimizer inlines."""
    w = WEIGHTS
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION truth_score(c DOUBLE, a DOUBLE, f DOUBLE, r DOUBLE) RETURNS DOUBLE
        RETURN {w["confidence"]}D * c + {w["authority"]}D * a + {w["freshness"]}D * f + {w["corroboration"]}D * log1p(r)""")
    cases = " ".join(f"WHEN '{k}' THEN {v}D" for k, v in RATES.items())
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION decayed(f DOUBLE, days DOUBLE, kind STRING) RETURNS DOUBLE
        RETURN CASE WHEN kind = 'identity' THEN 1.0D ELSE greatest({FLOOR}D, f * exp(-(CASE kind {cases} ELSE {OTHER_RATE}D END) * days)) END""")
