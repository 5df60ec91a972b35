"""Target-distribution importance resampling: documents are weighed by hashed words and drawn by Gumbel top-k.

Two passes of Arrow batches over the texts. The first counts features by bucket, a vector of counts per partition, and
treeReduce adds the vectors, so that the driver gets one of them whatever the corpus. The second gathers the buckets'
gains, which are broadcast, and sums them by document. Ranks come from a range sort and offsets per partition: neither
the drawn documents nor their scores meet in one task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frozen, private, shuffle_width

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 10  # per cent of the documents that are long enough
SEED = 2024
#: What stands between words, after A-Z are lower-cased: anything ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Texts are cut into words so many bytes at a time; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of whole texts of about SLICE_BYTES."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield texts.slice(at, end - at)
        at = end


def _features(texts: pa.Array, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: each one's words, and per feature the number of its text and its bucket."""
    parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BETWEEN)
    owner, words = pc.list_parent_indices(parts).to_numpy(), pc.list_flatten(parts)
    held = pc.not_equal(words, "")
    owner, words = owner[held.to_numpy(zero_copy_only=False)], words.filter(held)
    n_words = np.bincount(owner, minlength=len(texts))
    owners, found = [], []
    for n in range(1, runs + 1):
        if n > 1:  # a run is a run before it and the word after that, of one text
            words = pc.binary_join_element_wise(words.slice(0, len(words) - 1), single.slice(n - 1), " ") if len(words) > 1 else words.slice(0, 0)
            own = owner[: len(words)]
            keep = own == owner[n - 1 : n - 1 + len(words)]
        else:
            single, own, keep = words, owner, np.ones(len(words), bool)
        coded = words.dictionary_encode()
        hashes = np.fromiter((zlib.crc32(w.as_buffer()) % buckets for w in coded.dictionary.cast(pa.binary())), np.int64, len(coded.dictionary))
        owners.append(own[keep])
        found.append(hashes[coded.indices.to_numpy()][keep] if len(hashes) else np.zeros(0, np.int64))
    return n_words, np.concatenate(owners), np.concatenate(found)


def bucket_counts(docs: DataFrame, text: str = "text", runs: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: one vector per partition, added up along a tree of tasks."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for part in _slices(b.column(0)):
                total += np.bincount(_features(part, runs, buckets)[2], minlength=buckets)
        yield pa.RecordBatch.from_pydict({"n": pa.array([total.tobytes()], pa.binary())})

    vectors = docs.select(F.col(text).cast("string")).mapInArrow(counted, "n binary").rdd.map(lambda r: np.frombuffer(bytes(r[0]), np.int64))
    return vectors.treeReduce(lambda a, b: a + b, 3) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Of each bucket, the floor of 1000 times the log ratio of its smoothed shares of the target and of the source."""
    k = float(len(target))
    t, s = target.astype(np.float64), source.astype(np.float64)
    ratio = (t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A document's Gumbel draw in thousandths, from a hash of seed and id; a null id is the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighed(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", runs: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of docs, target being texts of the distribution that is wanted."""
    spark = docs.sparkSession
    gain = spark.sparkContext.broadcast(gains(bucket_counts(target, text, runs, buckets), bucket_counts(docs, text, runs, buckets)))

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = gain.value
        for b in batches:
            at = 0
            for part in _slices(b.column(1)):
                n_words, owner, bucket = _features(part, runs, buckets)
                weight = np.bincount(owner, weights=value[bucket], minlength=len(part))  # whole numbers below 2**53: exact
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(part)), pa.array(n_words, pa.int64()), pa.array(np.bincount(owner, minlength=len(part)), pa.int64()), pa.array(weight.astype(np.int64))],
                    ["doc_id", "n_words", "n_features", "weight"],
                )
                at += len(part)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(summed, f"doc_id {kind}, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, most: int) -> DataFrame:
    """scored with rank, 1 to most by score downwards, ties to the smaller doc_id, nulls last; null beyond.

    A range sort numbers the rows within each partition; a partition's first rank is the sum of the sizes before it, of
    which there are as many as partitions.
    """
    width = max(1, shuffle_width(scored.sparkSession))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    p = private(scored)
    placed = frozen(scored.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn(p, F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright(p, 33), F.col(p).bitwiseAND((1 << 33) - 1)
    sizes = {r[0]: r[1] for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    before, offsets = 0, []
    for k in sorted(sizes):
        offsets.append((k, before))
        before += sizes[k]
    if not offsets:
        return placed.withColumn("rank", F.lit(None).cast("long")).drop(p)
    first = placed.sparkSession.createDataFrame(offsets, f"{p}k long, {p}first long")
    rank = F.col(f"{p}first") + within + 1
    joined = placed.join(F.broadcast(first), part.cast("long") == F.col(f"{p}k"))
    return joined.withColumn("rank", F.when(rank <= most, rank)).drop(p, f"{p}k", f"{p}first")


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", runs: int = 1, buckets: int = BUCKETS, least: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs; those with a rank are drawn.

    Of the N documents of at least so many words, the floor of share * N / 100 with the highest scores are drawn: the sum
    of their features' gains and a Gumbel draw by id, so that runs agree. Features are runs of 1 to `runs` words.

    A null text has no word, weighs 0 and isn't drawn; a null id is hashed as the empty text and comes last among equals;
    repeated rows are documents of their own, of equal score; an empty table gives none; an empty target weighs by
    smoothing alone. Other columns are not read.
    """
    scored = weighed(docs, target, doc_id, text, runs, buckets)
    scored = frozen(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weighed")
    long_enough = F.col("n_words") >= least
    most = share * scored.where(long_enough).count() // 100
    rest = scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked(scored.where(long_enough), most).unionByName(rest)


def drawn(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """The drawn rows of docs with all their columns. Rows that share an id are drawn together."""
    p = private(docs)
    ids = resampled(docs, target, doc_id, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias(p)).distinct()
    return docs.join(ids, F.col(doc_id).eqNullSafe(F.col(p)), "left_semi")
