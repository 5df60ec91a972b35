"""Text scalars: memory types, entities by pattern, routing, relation patterns, n-gram profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word families of memory types (anything else, the temporal family included, is an event), entity patterns
# by label, patterns of extracted fields, marks of logs, the words of natural language, phrases that state a relation.
IDENTITY = r"\b(i am|i'm|i live in|my name is)\b"
PREFERENCE = r"\b(i prefer|my favorite|i like|i always|i usually)\b"
NEGATION = r"\b(not|don't|no longer|stopped|quit|isn't|aren't)\b"
PATTERNS = {
    "EMAIL": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+",
    "URL": r"https?://\S+",
    "IP": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}
FIELDS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "date": r"\b(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})\b",
}
LOG_WORDS = ("INFO", "WARN", "ERROR", "Exception")
NATURAL = (
    "the and of to a in that is was he for it with as his on be at by i this had not are but from or have an they which one you were "
    "her all she there would their we him been has when who will no more if out so up said what its about than into them can only "
    "other time new some could these two may first then do any my now"
).split()
NAME_PHRASES = ("my name is", "i am ", "i'm ", "call me ")
WORK_PHRASES = ("work at", "work for", "working at", "employed at", "job at")
PLACE_PHRASES = ("live in", "from ", "based in", "located in")
LIKING_PHRASES = ("i like", "i prefer", "i love", "i enjoy")
PREFERENCE_VERBS = ("like", "prefer", "love", "enjoy")
RELATIONS = (("HAS_NAME", NAME_PHRASES, ("PERSON",), 0.95), ("WORKS_AT", WORK_PHRASES, ("ORG", "ORGANIZATION"), 0.9), ("LOCATED_IN", PLACE_PHRASES, ("GPE", "LOC", "LOCATION"), 0.85))


def unicode_classes(pattern: str) -> str:
    """A pattern whose classes and word boundaries know all letters and digits."""
    return "(?U)" + pattern


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = text.contains(phrases[0])
    for p in phrases[1:]:
        out = out | text.contains(p)
    return out


def memory_type(text: Column) -> Column:
    """identity before preference before event, which is also the default."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike(unicode_classes(IDENTITY)), "identity").when(low.rlike(unicode_classes(PREFERENCE)), "preference").otherwise("event")


def is_negated(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(unicode_classes(NEGATION))


def entities(docs: DataFrame, id_col: str = "id", text_col: str = "text", named: DataFrame | None = None) -> DataFrame:
    """(id, label, value, n): distinct entities found by pattern, of a value under several labels the first label.

    named (id, label, value) adds what a model finds, after the patterns: a value that they found keeps their label. Where
    named has a column order, labels of a smaller order go first.
    """
    found = F.concat(*[F.transform(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(unicode_classes(p)), F.lit(0)), _labelled(k, label)) for k, (label, p) in enumerate(PATTERNS.items())])
    each = docs.select(F.col(id_col).alias("id"), F.explode(found).alias("e")).select("id", "e.k", "e.label", "e.value")
    if named is not None:
        later = F.col("order") if "order" in named.columns else F.lit(0)
        each = each.unionByName(named.select("id", (F.lit(len(PATTERNS)) + later).cast("int").alias("k"), "label", "value"))
    g = each.groupBy("id", "value").agg(F.min_by("label", F.struct("k", "label")).alias("label"), F.count(F.lit(1)).alias("n"))
    return g.select("id", "label", "value", "n")


# Labels that a model is sure of, those it is half sure of, and the confidence below which another model is asked.
SURE_LABELS, HALF_SURE_LABELS, LEAST_SURE = ("PERSON", "ORG", "GPE", "PRODUCT"), ("CARDINAL", "DATE"), 0.6


def label_confidence(named: DataFrame) -> DataFrame:
    """(id, confidence) of texts with entities (id, label, value): 1 with a sure label, a half with one half sure, else 0."""
    each = F.when(F.col("label").isin(*SURE_LABELS), 1.0).when(F.col("label").isin(*HALF_SURE_LABELS), 0.5).otherwise(0.0)
    return named.groupBy("id").agg(F.max(each).alias("confidence"))


def hybrid_entities(docs: DataFrame, model: Callable[[DataFrame], DataFrame], fallback: Callable[[DataFrame], DataFrame], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, label, value, n) by patterns, by a model and, for texts that it isn't sure of, by another: the first to find a value names it.

    Both plug-ins take rows of docs and return (id, label, value); the second sees only texts whose confidence is below
    LEAST_SURE, those without any entity of the first among them.
    """
    first = model(docs).select("id", "label", "value")
    sure = label_confidence(first).where(F.col("confidence") >= LEAST_SURE).select(F.col("id").alias("_sure"))
    second = fallback(docs.join(sure, F.col(id_col) == F.col("_sure"), "left_anti")).select("id", "label", "value")
    both = first.withColumn("order", F.lit(0)).unionByName(second.withColumn("order", F.lit(1)))
    return entities(docs, id_col, text_col, both)


def _labelled(k: int, label: str):
    return lambda v: F.struct(F.lit(k).alias("k"), F.lit(label).alias("label"), v.alias("value"))


def regex_fields(text: Column) -> Column:
    """The e-mail addresses and dates of a text as a struct; a field that isn't found is null."""
    found = lambda p: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(unicode_classes(p)), F.lit(0))
    return F.struct(*[F.when(F.size(found(p)) > 0, found(p)).alias(k) for k, p in FIELDS.items()])


def extracted(text: Column, named: Column | None = None) -> Column:
    """Entities, topics and metadata of a text; named, an array of names, may come from a model."""
    found = F.coalesce(regex_fields(text)["email"], F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(named, found)) if named is not None else F.array_distinct(found)
    return F.struct(every.alias("entities"), F.array(F.lit("placeholder")).alias("topics"), F.struct(memory_type(text).alias("memory_type"), is_negated(text).alias("negation")).alias("metadata"))


def digit_ratio(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{Nd}")) / F.greatest(F.length(text), F.lit(1))


def route(text: Column, archetype: list[str] = NATURAL, least: float = 0.1) -> Column:
    """TRIVIAL for short texts, digits and logs; STRUCTURED for short texts with an address; NATURAL near the archetype's words; else COMPLEX."""
    t = F.coalesce(text, F.lit(""))
    start = F.substring(t, 1, 50)
    logs = contains_any(start, LOG_WORDS)
    short = (F.length(t) < 200) & (t.rlike(unicode_classes(PATTERNS["EMAIL"])) | t.rlike(unicode_classes(PATTERNS["URL"])))
    return F.when((F.length(t) < 40) | (digit_ratio(t) > 0.4) | logs, "TRIVIAL").when(short, "STRUCTURED").when(unigram_cosine(t, archetype) > least, "NATURAL").otherwise("COMPLEX")


def unigram_cosine(text: Column, archetype: list[str]) -> Column:
    """Cosine of word counts against a set of distinct words, each once: counts come from one sort of the words."""
    w = F.sort_array(F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), ""))
    zero = F.struct(F.lit("").alias("w"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sq"), F.lit(0.0).alias("dot"))
    known = F.array(*[F.lit(a) for a in archetype])

    def step(a: Column, x: Column) -> Column:  # (n + 1)^2 - n^2 = 2n + 1
        n = F.when(a["w"] == x, a["n"]).otherwise(F.lit(0.0))
        return F.struct(x.alias("w"), (n + 1).alias("n"), (a["sq"] + 2 * n + 1).alias("sq"), (a["dot"] + F.array_contains(known, x).cast("double")).alias("dot"))

    return F.aggregate(w, zero, step, lambda a: F.coalesce(F.try_divide(a["dot"], F.sqrt(a["sq"]) * F.sqrt(F.lit(float(len(archetype))))), F.lit(0.0)))


def ngram_profile(docs: DataFrame, n: int = 1, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """(id, gram, n): counts of lower-cased word n-grams."""
    w = F.array_remove(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    split = docs.select(F.col(id_col).alias("id"), w.alias("_w")).where(F.size("_w") >= n)
    gram = F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda i: F.array_join(F.slice("_w", i, F.lit(n)), " "))
    return split.select("id", F.explode(gram).alias("gram")).groupBy("id", "gram").agg(F.count(F.lit(1)).alias("n"))


def preference(text: Column) -> Column:
    """What follows the first verb of liking, the verbs tried in order, in a text that says "I like" or the like; null if it is empty or has 50 characters or more."""
    low = F.lower(text)
    at = F.coalesce(*[F.when(F.instr(low, v) > 0, F.instr(low, v) + len(v)) for v in PREFERENCE_VERBS])
    rest = F.regexp_replace(F.substring(text, at, F.length(text)), r"(?U)^\s+|\s+$", "")
    return F.when(contains_any(low, LIKING_PHRASES) & F.length(rest).between(1, 49), F.rtrim(rest, F.lit(".!")))


def relation_patterns(docs: DataFrame, named: DataFrame | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, relation, object, confidence): preferences by pattern, and with entities (id, label, value) names, work and places.

    A null text states nothing; an entity counts as often as it is given.
    """
    pref = docs.select(F.col(id_col).alias("id"), F.lit("PREFERS").alias("relation"), preference(F.col(text_col)).alias("object"), F.lit(0.9).alias("confidence")).where("object is not null")
    if named is None:
        return pref
    low = F.lower(text_col)
    rules = F.array(*[
        F.struct(contains_any(low, phrases).alias("on"), F.lit(label).alias("label"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"))
        for relation, phrases, labels, confidence in RELATIONS for label in labels
    ])
    each = docs.select(F.col(id_col).alias("id"), F.explode(F.filter(rules, lambda r: r["on"])).alias("r")).select("id", "r.label", "r.relation", "r.confidence")
    return pref.unionByName(each.join(named, ["id", "label"]).select("id", "relation", F.col("value").alias("object"), "confidence"))
