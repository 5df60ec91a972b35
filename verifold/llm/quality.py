"""Quality rules: fixed text rules, then a hashed n-gram log-likelihood ratio. DataFrame functions only.

Words and pairs of words are hashed into a fixed number of buckets. Two multinomials over the buckets are counted, one
over a bounded sample of trusted documents, one over all documents; a document's score is the mean over its n-grams of
log(target / raw). A bucket's ratio has a Gamma prior of mean 1, so that a bucket that the trusted sample is too small to
tell about weighs next to nothing. The threshold is fitted on labelled documents that the weights were not counted on:
it is the cut that parts good from bad best. The verdict on a text needs nothing but the weights and the threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_bound, private, words

BUCKETS = 65536
#: Bounds of the labelled samples, those whose ids hash lowest: trusted documents, and documents of each class that the threshold is fitted on.
TRUSTED_ROWS, FITTING_ROWS = 20_000, 4_000
#: Shape of the prior of a bucket's ratio: so many expected occurrences weigh as much as it does.
PRIOR = 0.5
MIN_WORDS = 50


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_hashes(w: Column) -> Column:
    """The 64-bit hashes of an array of words: each string is hashed once, windows of words by their words' hashes."""
    return F.transform(w, lambda x: F.xxhash64(x))


def bucket(h: Column, buckets: int) -> Column:
    """The bucket of a hash; buckets is a power of two."""
    return h.bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int")


def pair(h: Column, i: Column) -> Column:
    """The hash of the two words that begin at i."""
    return F.xxhash64(F.get(h, i), F.get(h, i + 1))


def grams(h: Column, buckets: int) -> Column:
    """The buckets of all words and pairs of words of an array of word hashes."""
    n = F.size(h)
    ones = F.transform(h, lambda x: bucket(x, buckets))
    twos = F.when(n > 1, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(2)) - 2), lambda i: bucket(pair(h, i), buckets))).otherwise(F.array().cast("array<int>"))
    return F.concat(ones, twos)


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, good, half) of each labelled id: good if a label calls it so and none calls it toxic; half deals good ids to counting (0) and fitting (1)."""
    toxic = F.max(F.coalesce("toxic", F.lit(0))) if "toxic" in labels.columns else F.lit(0)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_q"), toxic.alias("_t"))
    good = F.when((F.col("_q") == 1) & (F.col("_t") != 1), True).when(F.col("_q") != 1, False)
    half = F.when(F.col("_q") == 1, F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2))).otherwise(F.lit(1))
    return known.select("doc_id", good.alias("good"), half.cast("int").alias("half")).where("good is not null")


def lowest(ids: DataFrame, most: int) -> DataFrame:
    """At most `most` ids, those whose hashes are lowest."""
    return ids.where(F.xxhash64("doc_id") <= hash_bound(ids, ["doc_id"], most))


def trusted_ids(labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    return lowest(labelled(labels).where("good and half = 0").select("doc_id"), most)


def fitting_ids(labels: DataFrame, most: int = FITTING_ROWS) -> DataFrame:
    """(doc_id, good) of at most `most` ids of each class that no weight is counted on."""
    rest = labelled(labels).where("half = 1").select("doc_id", "good")
    return lowest(rest.where("good"), most).unionByName(lowest(rest.where("not good"), most))


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> list[float]:
    """log((t + prior) / (e + prior)) of each bucket, to three digits; all 0 if no trusted document has a word.

    t are the bucket's n-grams in trusted documents, e as many as its share of all n-grams leads to expect. Counts cover
    all of docs in one pass. `trusted` is bounded, so it is broadcast; the driver gets one row per bucket.
    """
    marked = docs.select("doc_id", "text").join(F.broadcast(trusted.withColumn("_good", F.lit(1))), "doc_id", "left")
    each = marked.select(F.coalesce("_good", F.lit(0)).alias("good"), let(word_hashes(words(F.col("text"))), lambda h: grams(h, buckets)).alias("g")).select("good", F.explode("g").alias("b"))
    counts = each.groupBy("b").agg(F.sum("good").cast("double").alias("t"), F.count(F.lit(1)).cast("double").alias("r"))
    found = counts.collect()
    t, r = sum(x.t for x in found), sum(x.r for x in found)
    out = [0.0] * buckets
    for x in found if t else ():
        out[x.b] = round(math.log((x.t + prior) / (x.r * t / r + prior)), 3)
    return out


def cut(scored: list[tuple[bool, float]]) -> float:
    """The threshold that parts good from bad scores best: the largest difference of the shares of good and of bad at or above it.

    Between two scores it lies in the middle; of equally good cuts the lowest counts. Without scores of a class: minus infinity.
    """
    good = sum(g for g, _ in scored)
    bad = len(scored) - good
    if not good or not bad:
        return -math.inf
    rows = sorted(scored, key=lambda x: x[1])
    best, at, below_good, below_bad = 0.0, -math.inf, 0, 0
    for k, (g, v) in enumerate(rows):
        below_good, below_bad = below_good + g, below_bad + (not g)
        gain = below_bad / bad - below_good / good
        if gain > best + 1e-12 and k + 1 < len(rows) and rows[k + 1][1] > v:
            best, at = gain, (v + rows[k + 1][1]) / 2
    return at


def fitted_threshold(docs: DataFrame, fitting: DataFrame, weights: list[float], min_words: int = MIN_WORDS) -> float:
    """cut() over the documents of `fitting` that pass the fixed rules; the driver gets a row per id, at most twice FITTING_ROWS."""
    some = docs.select("doc_id", "text").join(F.broadcast(fitting), "doc_id")
    # no filter here: it would be pushed below the join and judge every document
    found = some.select("doc_id", "good", measured(F.coalesce("text", F.lit("")), weights).alias("m")).groupBy("doc_id", "good").agg(F.min("m").alias("m"))
    return cut([(r.good, r.m.llr) for r in found.collect() if not fails(r.m.n_words, r.m.n_repeat_words, min_words)])


def numbers(values: list[float]) -> Column:
    """A constant array; as text it is one literal, folded once on the driver."""
    return F.split(F.lit(",".join(format(v, ".6f") for v in values)), ",").cast("array<double>")


def thousandths(values: list[float]) -> Column:
    """A constant array in whole thousandths, as short a text as a plan has to carry."""
    return F.split(F.lit(",".join(str(round(1000 * v)) for v in values)), ",").cast("array<int>")


def ratio(h: Column, weights: list[float]) -> Column:
    """The mean weight of the n-grams of an array of word hashes; 0 without words."""
    n, k = F.size(h), len(weights)

    def total(w: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            one = F.get(w, bucket(F.get(h, i), k))
            return acc + F.when(i < n - 1, one + F.get(w, bucket(pair(h, i), k))).otherwise(one)

        return F.aggregate(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(0).cast("long"), add)

    return F.when(n > 0, let(thousandths(weights), total) / (1000 * (2 * n - 1))).otherwise(F.lit(0.0))


def repeated_words(h: Column) -> Column:
    """How many words stand in a three-word window that the text has twice or more; sorting, so n log n for any text."""
    n = F.size(h)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(3)) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))))

    def covered(order: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(order, k)["h"] == x["h"], F.lit(False))
        found = F.filter(order, lambda x, k: F.when(k > 0, same(x, k - 1)).otherwise(F.lit(False)) | same(x, k + 1))
        at = F.sort_array(F.transform(found, lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct((a["n"] + (i + 3 - F.greatest(i, a["end"]))).alias("n"), (i + 3).alias("end"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    def count(v: Column) -> Column:
        ordered = F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(v)) < F.size(v), let(ordered, covered)).otherwise(F.lit(0).cast("long"))

    return F.coalesce(let(windows, count), F.lit(0).cast("long"))


def measured(text: Column, weights: list[float]) -> Column:
    """n_words, word_chars, n_repeat_words and llr of a text as a struct, from one split and one hash of each word."""

    def of(w: Column) -> Column:
        fields = lambda h: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(h).alias("n_repeat_words"), ratio(h, weights).alias("llr"))
        return let(word_hashes(w), fields)

    return let(words(text), of)


def fails(n_words, n_repeat_words, min_words: int = MIN_WORDS):
    """The fixed rule: too few words, or more than half of them in repeated windows."""
    return (n_words < min_words) | (100 * n_repeat_words > 50 * n_words)


def passes(text: Column, weights: list[float], threshold: float, min_words: int = MIN_WORDS) -> Column:
    """The verdict alone, as one expression that a filter may hold: a text that fails the fixed rule isn't scored."""

    def of(h: Column) -> Column:
        n = F.size(h)
        return F.when(fails(n, F.when(n < min_words, F.lit(0).cast("long")).otherwise(repeated_words(h)), min_words), F.lit(False)).otherwise(ratio(h, weights) >= threshold)

    return let(word_hashes(words(text)), of)


def with_rules(docs: DataFrame, weights: list[float], text_col: str = "text", threshold: float = -math.inf, min_words: int = MIN_WORDS, prefix: str = "") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept beside their own columns.

    A null text counts as empty: no words, so base_failed. Rows are judged one by one: repeated ids, ties and null ids
    change nothing, an empty table stays empty. `prefix` goes before the new names; a column of docs with one of them is
    replaced. Repeated three-word windows are told by 64-bit hashes.
    """
    text, m = F.coalesce(F.col(text_col), F.lit("")), private(docs) + "m"
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    name = lambda c: F.col(prefix + c)
    counted = docs.withColumn(m, measured(text, weights)).withColumns({
        prefix + "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        prefix + "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        **{prefix + c: F.col(m)[c] for c in ("n_words", "word_chars", "n_repeat_words", "llr")},
    })
    judged = counted.withColumn(prefix + "base_failed", fails(name("n_words"), name("n_repeat_words"), min_words))
    return judged.withColumn(prefix + "kept", ~name("base_failed") & (name("llr") >= threshold)).drop(m)


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[list[float], float]:
    """The weights counted on docs and the threshold fitted on its labels."""
    weights = bucket_weights(docs, trusted_ids(labels))
    return weights, fitted_threshold(docs, fitting_ids(labels), weights)


def judge(docs: DataFrame, labels: DataFrame, prefix: str = "") -> DataFrame:
    """with_rules() under fitted()."""
    weights, threshold = fitted(docs, labels)
    return with_rules(docs, weights, threshold=threshold, prefix=prefix)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with their own columns only, whatever their names."""
    weights, threshold = fitted(docs, labels)
    return docs.where(passes(F.coalesce(F.col("text"), F.lit("")), weights, threshold))
