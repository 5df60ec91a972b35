"""Recall by keywords, by vectors and by both, and what reads its results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import truth
from . import identity, keywords

# Weights of the hybrid score and its edge limit.
HYBRID = {"vector": 0.5, "keyword": 0.2, "graph": 0.15, "importance": 0.1, "recency": 0.05}
MAX_EDGES = 12


def tokens(text: Column) -> Column:
    """The distinct lower-cased words of a text between white space."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")), "")


def keyword_relevance(memories: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, relevance) of memories (id, text) that share a word with a query (query_id, query).

    Words are exploded and met by equi-join, so that a query only touches memories that have one of its words.
    """
    asked = queries.select("query_id", tokens(F.col("query")).alias("_q")).select("query_id", F.greatest(F.size("_q"), F.lit(1)).alias("_n"), F.explode("_q").alias("word"))
    held = memories.select("id", F.explode(tokens(F.col("text"))).alias("word"))
    met = held.join(asked, "word").groupBy("query_id", "id", "_n").agg(F.count(F.lit(1)).alias("_o"))
    return met.select("query_id", "id", (F.col("_o") / F.col("_n")).alias("relevance"))


def ranked(hits: DataFrame, score: str, top: int, ties: str = "id") -> DataFrame:
    """The best `top` hits per query with their rank; a limit per group, so Spark prunes before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), ties)
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)


def keyword_hits(memories: DataFrame, queries: DataFrame, top: int, digits: int = 6) -> DataFrame:
    """(query_id, id, relevance, rank): each query's `top` memories (id, text) by the share of its words that they have."""
    best = keywords.best_by_share(memories.select("id", "text"), queries.select("query_id", F.col("query").alias("text")), tokens, top, digits)
    return best.select("query_id", "id", F.round("relevance", digits).alias("relevance"), "rank")


def keyword_recall(memories: DataFrame, queries: DataFrame, top: int = 10, least: float = 0.3, digits: int = 6) -> DataFrame:
    """(query_id, id, relevance, score, rank, total_found): 0.6 truth and 0.4 relevance, at least `least`. memories carry a truth vector.

    total_found counts a query's hits before the best `top` of them are taken.
    """
    impact = memories.select("id", "text", (0.6 * truth.score()).alias("impact"))
    best = keywords.best_by_words(impact, queries.select("query_id", F.col("query").alias("text")), tokens, top, 0.4, least, digits)
    return best.withColumn("relevance", F.round("relevance", digits)).select("query_id", "id", "relevance", "score", "rank", "total_found")


def vector_hits(vectors: DataFrame, queries: DataFrame, top: int, digits: int = 6, by: int = 12) -> DataFrame:
    """(query_id, id, similarity, rank): each query's `top` most similar vectors, exactly, by blocks. Both have id, kind, vec.

    Ranks go by the cosine at `by` digits, which are all that doubles carry unless fewer are asked for; ties by the smaller id.
    """
    hits = identity.similar(queries, vectors, -2.0, top, digits=by).select(F.col("left_id").alias("query_id"), F.col("right_id").alias("id"), "similarity", F.round("similarity", by).alias("_s"))
    return ranked(hits, "_s", top).withColumn("similarity", F.round("similarity", digits)).select("query_id", "id", "similarity", "rank")


def vector_recall(memories: DataFrame, queries: DataFrame, top: int = 10, least: float = 0.0, digits: int = 6, by: int = 12) -> DataFrame:
    """(query_id, id, similarity, score, rank): twice as many by cosine at `by` digits, then by 0.4 confidence, 0.3 authority, 0.2 freshness and 0.1 cosine."""
    near = vector_hits(memories.select("id", "kind", "vec"), queries, 2 * top, digits, by).drop("rank")
    facts = memories.select("id", F.coalesce("confidence", F.lit(0.5)).alias("_c"), F.coalesce("authority", F.lit(0.5)).alias("_a"), F.coalesce("freshness", F.lit(1.0)).alias("_f"))
    scored = near.join(facts, "id").withColumn("score", F.round(0.4 * F.col("_c") + 0.3 * F.col("_a") + 0.2 * F.col("_f") + 0.1 * F.col("similarity"), digits + 3))
    return ranked(scored.where(F.col("score") >= least), "score", top).select("query_id", "id", "similarity", "score", "rank")


def recall(memories: DataFrame, queries: DataFrame, top: int = 5, least: float = 0.3, digits: int = 6, by: int = 12) -> DataFrame:
    """(query_id, id, score, rank): by vectors where memories and queries have them (vec, kind), else by keywords (text, query)."""
    if {"vec", "kind"} <= set(memories.columns) and {"vec", "kind"} <= set(queries.columns):
        found = vector_recall(memories, queries.select(F.col("query_id").alias("id"), "kind", "vec"), top, least, digits, by)
    else:
        found = keyword_recall(memories, queries, top, least, digits)
    return found.select("query_id", "id", "score", "rank")


def faceted(hits: DataFrame, memories: DataFrame, kinds: list[str] | None = None, since: Column | None = None, until: Column | None = None, near: DataFrame | None = None) -> DataFrame:
    """hits (query_id, id, score, …) that meet all facets asked for: a memory type, a span of time, a place in a graph (rows id); ranked anew."""
    facts = memories
    if kinds is not None:
        facts = facts.where(F.col("memory_type").isin(kinds))
    if since is not None:
        facts = facts.where(F.col("timestamp") >= since)
    if until is not None:
        facts = facts.where(F.col("timestamp") <= until)
    kept = hits.drop("rank").join(facts.select("id").distinct(), "id", "left_semi")
    if near is not None:
        kept = kept.join(near.select("id").distinct(), "id", "left_semi")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return kept.withColumn("rank", F.row_number().over(w).cast("long"))


def recency(at: Column, last: Column) -> Column:
    """0.99 for each whole day since; a half where nothing is known."""
    return F.when(last.isNull(), F.lit(0.5)).otherwise(F.pow(F.lit(0.99), F.floor(truth.days_between(at, last)).cast("double")))


def hybrid_recall(vector: DataFrame, keyword: DataFrame, edges: DataFrame, facts: DataFrame, at: Column, top: int = 10, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank) over the union of two hit lists.

    vector: query_id, id, similarity; keyword: query_id, id, relevance; edges: id, weight; facts: id, importance,
    last_accessed. What a list doesn't have counts 0; missing importance and recency count a half.
    """
    both = vector.select("query_id", "id", "similarity").join(keyword.select("query_id", "id", "relevance"), ["query_id", "id"], "full")
    strength = edges.groupBy("id").agg((F.sum("weight") / MAX_EDGES).alias("_g"))
    known = facts.select("id", "importance", recency(at, F.col("last_accessed")).alias("_r"))
    joined = both.join(strength, "id", "left").join(known, "id", "left")
    w = HYBRID
    score = w["vector"] * F.coalesce("similarity", F.lit(0.0)) + w["keyword"] * F.coalesce("relevance", F.lit(0.0)) + w["graph"] * F.coalesce("_g", F.lit(0.0)) + w["importance"] * F.coalesce("importance", F.lit(0.5)) + w["recency"] * F.coalesce("_r", F.lit(0.5))
    return ranked(joined.withColumn("score", F.round(score, digits)), "score", top).select("query_id", "id", "score", "rank")


def context(hits: DataFrame, max_tokens: int = 500, scored: bool = True) -> DataFrame:
    """(query_id, lines, context): ranked hits (query_id, rank, content, confidence) as text, up to the first line that would not fit in 4 characters a token."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". ["), F.round(100 * F.col("confidence")).cast("int").cast("string"), F.lit("% confidence] "), F.col("content")) if scored else F.concat(F.lit("- "), F.col("content"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    fit = hits.withColumn("_line", line).withColumn("_used", F.sum(F.length("_line")).over(w)).where(F.col("_used") <= 4 * max_tokens)
    g = fit.groupBy("query_id").agg(F.count(F.lit(1)).alias("lines"), F.array_sort(F.collect_list(F.struct("rank", "_line"))).alias("_l"))
    return g.select("query_id", "lines", F.array_join(F.transform("_l", lambda x: x["_line"]), "\n").alias("context"))


def forget(states: DataFrame, ids: DataFrame) -> DataFrame:
    """states with freshness 0 where the id is among ids."""
    marked = states.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return marked.withColumn("freshness", F.when(F.col("_hit"), 0.0).otherwise(F.col("freshness"))).drop("_hit")


def health(states: DataFrame) -> DataFrame:
    """One row: total, average_score, low_truth, stale, health. Health may fall below 0, as a state can be both low and stale."""
    g = states.withColumn("_s", truth.score()).agg(F.count(F.lit(1)).alias("total"), F.avg("_s").alias("average_score"), F.count_if(F.col("_s") < 0.3).alias("low_truth"), F.count_if(F.col("freshness") < 0.2).alias("stale"))
    return g.withColumn("health", 1 - (F.col("low_truth") + F.col("stale")) / F.greatest(F.col("total"), F.lit(1)))
