"""Mixing sources to target weights: fixed-length blocks, multinomial counts per output shard, pseudorandom permutations.

Each source's documents are laid end to end in a pseudorandom order and cut into blocks of `block` words. The mix has as
many slots as the targets have blocks; slots are dealt to shards. The shards are the leaves of a binary tree: at each node the source
counts of the left half are a multinomial draw from the quotas of the node, never above them, and the right half gets the
rest, so that the shards together meet the quotas, and any task can draw its own shards from the seed, the quotas and the
way down to them. The n-th slot of a source takes the block at place n of the source's permutation; after a full pass the
next permutation goes on. Slots meet blocks by an equi-join on (source, block).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import count_words, frozen, words

BLOCK, SHARD_SLOTS, MOST, SEED, BUCKET_ROWS = 256, 4096, 3, 17, 512
#: Shards that one task draws.
TASK_SHARDS = 64
#: Equal rows that one task lays out.
COPIES = 4096


def targets(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Shares of the total by weight; none above `most` times its size, the excess reshared by weight until none is."""
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        whole = sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if left * weights[i] / whole > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / whole
            return out
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= set(full)
    return out


def drawn(left: np.ndarray, n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A multinomial draw of n slots by what is left of each source, cut at what is left, the rest drawn again."""
    rnd, out = np.random.Generator(np.random.PCG64(list(seed))), np.zeros(len(left), np.int64)
    while (short := n - int(out.sum())) > 0:
        rest = left - out
        out += np.minimum(rnd.multinomial(short, rest / rest.sum()), rest)
    return out


def shard_counts(quotas: np.ndarray, first: int, last: int, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, counts, before) of the shards first to last - 1: slots of each source in the shard, and in all shards before it.

    Only the nodes above those shards are drawn; a draw is seeded by its node alone.
    """

    def walk(a: int, b: int, left: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if b <= first or a >= last:
            return
        if b - a == 1:
            yield a, left, before
            return
        middle = (a + b) // 2
        half = drawn(left, (middle - a) * shard_slots, (seed, a, b))
        yield from walk(a, middle, half, before)
        yield from walk(middle, b, left - half, before + half)

    quotas = np.asarray(quotas, np.int64)
    yield from walk(0, -(-int(quotas.sum()) // shard_slots), quotas, np.zeros_like(quotas))


def permuted(n: np.ndarray, size: np.ndarray, source: np.ndarray, seed: int = SEED, rounds: int = 4) -> np.ndarray:
    """Where a pseudorandom permutation of 0..size-1, another for each source and pass n // size, sends n % size.

    A Feistel network over the smallest power of four above size, walked on until the result lies below size.
    """
    n, size = n.astype(np.uint64), size.astype(np.uint64)
    half = np.maximum(1, np.ceil(np.log2(size.astype(np.float64) + 1) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    tag = _mixed(source.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ _mixed(n // size + np.uint64(seed)))
    out, todo = n % size, np.arange(len(n))
    while len(todo):
        h, m, t = half[todo], mask[todo], tag[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(rounds):
            left, right = right, left ^ (_mixed(right ^ t ^ _mixed(np.uint64(r + 1) + t)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned longs; sums wrap."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def source_plan(docs: DataFrame, most: int = MOST, block: int = BLOCK) -> list[dict]:
    """One record per source, by code point with null last: size, target, blocks, quota. The driver gets only these sums."""
    sums = docs.groupBy("source").agg(F.sum("size").alias("size")).orderBy(F.col("source").asc_nulls_last()).collect()
    sizes = [int(r["size"]) for r in sums]
    goal = targets(sizes, [1 + i % 3 for i in range(len(sizes))], most)
    out = []
    for i, r in enumerate(sums):
        blocks = -(-sizes[i] // block)
        quota = min(most * blocks, round(goal[i] / sizes[i] * blocks)) if sizes[i] else 0
        out.append({"source_no": i, "source": r["source"], "source_size": sizes[i], "target": goal[i], "blocks": blocks, "quota": quota})
    return out


def few(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """A frame made from `rows` rows that the driver holds: sent to all tasks while they are few, else joined by shuffle."""
    return F.broadcast(df) if rows <= most else df


def slots(spark: SparkSession, plan: list[dict], shard_slots: int = SHARD_SLOTS, seed: int = SEED, task_shards: int = TASK_SHARDS) -> DataFrame:
    """Rows (shard, slot, source_no, block_no): every slot of the mix and the block it takes. Each task draws its own shards."""
    plan = [p for p in plan if p["quota"]]
    quotas, blocks, number = (np.array([p[k] for p in plan], np.int64) for k in ("quota", "blocks", "source_no"))
    shards = -(-int(quotas.sum()) // shard_slots)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids = x.column(0).to_numpy()
            for s, e in zip(*_runs(ids)):
                for shard, counts, before in shard_counts(quotas, int(ids[s]), int(ids[e - 1]) + 1, shard_slots, seed):
                    which = np.repeat(np.arange(len(counts)), counts)
                    nth = before[which] + np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
                    taken = permuted(nth, blocks[which], number[which], seed)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), shard)), pa.array(np.arange(len(which))), pa.array(number[which]), pa.array(taken)], names=["shard", "slot", "source_no", "block_no"])

    return spark.range(0, shards, 1, max(1, -(-shards // task_shards))).mapInArrow(spread, "shard long, slot long, source_no long, block_no long")


def _runs(ids: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of consecutive numbers begin and end."""
    cuts = (np.flatnonzero(np.diff(ids) != 1) + 1).tolist()
    return ([0, *cuts], [*cuts, len(ids)]) if len(ids) else ([], [])


def laid_out(docs: DataFrame, plan: list[dict], seed: int = SEED, bucket_rows: int | None = None) -> DataFrame:
    """docs with source_no, source_size, target and start, the words of its source that stand before it.

    A source's documents fall into buckets by the hash of their id and text, about `bucket_rows` in each, and these into
    groups of `bucket_rows`; the running sum is one over the groups' totals, one over the buckets' totals in a group and
    one inside a bucket, so that no task holds a source. Rows that are equal in all columns are one row with a count until
    their starts are known, and then lie end to end.
    """
    bucket_rows = bucket_rows or BUCKET_ROWS
    docs = frozen(docs.groupBy(*docs.columns).agg(F.count(F.lit(1)).alias("_copies")), "distinct")
    rows = [(p["source_no"], p["source"], p["source_size"], p["target"]) for p in plan]
    names = few(docs.sparkSession.createDataFrame(rows, "source_no int, _name string, source_size long, target double"), len(rows))
    known = docs.join(names, docs["source"].eqNullSafe(names["_name"]), "inner").drop("_name")
    width = max(1, math.ceil(known.count() / bucket_rows))
    mark = F.xxhash64(F.lit(seed), "doc_id", "_text_mark")
    dealt = known.withColumn("_mark", mark).withColumn("_bucket", F.pmod(F.col("_mark"), F.lit(width)).cast("int"))
    group = F.floor(F.col("_bucket") / bucket_rows).cast("int").alias("_group")
    totals = frozen(dealt.groupBy("source_no", "_bucket").agg(F.sum(F.col("size") * F.col("_copies")).alias("_sum")).select("source_no", group, "_bucket", "_sum"), "bucket-sizes")
    over = lambda keys, by: F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = totals.groupBy("source_no", "_group").agg(F.sum("_sum").alias("_sum")).select("source_no", "_group", over(["source_no"], "_group").alias("_groups"))
    before = totals.withColumn("_buckets", over(["source_no", "_group"], "_bucket")).join(groups, ["source_no", "_group"]).select("source_no", "_bucket", (F.col("_groups") + F.col("_buckets")).alias("_before"))
    inside = Window.partitionBy("source_no", "_bucket").orderBy("_mark", "doc_id", "_text_mark", "size").rowsBetween(Window.unboundedPreceding, -1)
    started = (
        dealt.withColumn("_in", F.coalesce(F.sum(F.col("size") * F.col("_copies")).over(inside), F.lit(0)))
        .join(before, ["source_no", "_bucket"])
        .withColumn("start", F.col("_before") + F.col("_in"))
        .drop("_mark", "_bucket", "_before", "_in")
    )
    return copied(frozen(started, "started"))


def copied(started: DataFrame, most: int | None = None) -> DataFrame:
    """Each row as often as _copies says, one after the other from its start on; those of a row with many are many tasks' work."""
    most = most or COPIES
    first, last = F.col("_part") * most, F.least((F.col("_part") + 1) * most, F.col("_copies")) - 1
    own = started.where(F.col("_copies") <= most).withColumn("_part", F.lit(0).cast("long"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / most).cast("long")))
    hot = started.where(F.col("_copies") > most).withColumn("_part", parts).repartition("source_no", "start", "_part")
    each = own.unionByName(hot).withColumn("_copy", F.explode(F.sequence(first, last)))
    return each.withColumn("start", F.col("start") + F.col("_copy") * F.col("size")).drop("_copies", "_part", "_copy")


def mix(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, most: int = MOST, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The laid-out documents and the placements of the mix.

    docs needs doc_id, source and text. The first frame has one row per document: doc_id, source, size, source_no,
    source_size, target, start. The second has one row per slot and document in its block: shard, slot, source_no,
    block_no, start (the document's), doc_id, first_word, n_words, and times, how many slots took the block. A null text
    has size 0 and is in no block; a null source is a source of its own; repeated rows are documents of their own, told
    apart by their start; an empty table gives empty frames.
    """
    slim = docs.select("doc_id", F.col("source").cast("string").alias("source"), count_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_text_mark"))
    slim = frozen(slim, "sizes")
    plan = source_plan(slim, most, block)
    spark = docs.sparkSession
    laid = frozen(laid_out(slim, plan, seed).drop("_text_mark"), "laid-out")
    begin, end = F.floor(F.col("start") / block).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block).cast("long")
    pieces = laid.where("size > 0").select("source_no", "doc_id", "start", "size", F.explode(F.sequence(begin, end)).alias("block_no"))
    low = F.greatest(F.col("block_no") * block, F.col("start"))
    high = F.least((F.col("block_no") + 1) * block, F.col("start") + F.col("size"))
    pieces = pieces.select("source_no", "block_no", "doc_id", "start", (low - F.col("start")).alias("first_word"), (high - low).alias("n_words"))
    # both sides grow with the corpus, and the size of exploded pieces is underrated: never broadcast
    return laid, slots(spark, plan, shard_slots, seed).join(pieces.hint("merge"), ["source_no", "block_no"])


def taken(laid: DataFrame, placements: DataFrame) -> DataFrame:
    """laid with taken, the words that the mix takes of each document, repeats counted."""
    # (source_no, start) names a document that has words
    sums = placements.groupBy("source_no", "start").agg(F.sum("n_words").alias("_taken")).withColumn("_sized", F.lit(True))
    joined = laid.withColumn("_sized", F.col("size") > 0).join(sums, ["source_no", "start", "_sized"], "left")
    return joined.withColumn("taken", F.coalesce("_taken", F.lit(0)).cast("long")).drop("_taken", "_sized")


def materialise(docs: DataFrame, placements: DataFrame) -> DataFrame:
    """placements with the text of each piece: the words it takes, joined by single spaces. doc_id must be unique in docs."""
    texts = docs.select("doc_id", words(F.col("text")).alias("_w"))
    joined = placements.join(texts, "doc_id")
    return joined.withColumn("text", F.array_join(F.slice("_w", (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int")), " ")).drop("_w")
