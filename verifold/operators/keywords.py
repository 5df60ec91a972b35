"""Keyword search with bounds: an inverted index in impact order, and queries that stop once their best hits are safe.

Memories are numbered by what they score without any word, the best first, and cut into shards of one run of numbers each.
A task holds one shard as postings by word, in that order, words of many memories as bit sets too. A query's score of a
memory is at most its impact plus what all the words that the shard knows would add; as impacts fall along the shard, only
a prefix of it can still enter the query's best, and shards whose bound is below what the first shard gave aren't scored
at all. How many memories share a word is the size of a union of bit sets. No row is made for a query and a memory that
share a word, and a word that all memories have is in no task more than once for each memory of a shard.

Where nothing but the share of a query's words counts, no impact bounds a memory. Then the memories of the most words come
first, as they share most with any query: what the best of them have is what others must have too. A memory that has k of
a query's m words has one of any m - k + 1, so that only the postings of its rarest words are read; the frequent ones are
looked up in the bit sets of the memories that can still have k, which are few.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.order import numbered
from ..sources.shared import frozen

#: Memories in the first shard, a multiple of 64, and queries that meet it in one task. Of the other shards so many at most: what
#: is sent grows with the number of shards and of blocks of queries.
SHARD, ASKING, WIDE = 4096, 4096, 65536
#: Shards that a large table has beside the first one at least.
SHARDS = 32
#: Words of at least so many memories of a shard, and of at least a 64th of them, are kept as bit sets too.
DENSE = 32
#: Words of memories in one task; of queries twice as many. Of the memories that come first a quarter, as they meet smaller blocks.
WORDS = 1 << 25
#: Lists of fewer memories are gathered together.
SHORT = 128
#: Queries that meet the shards after the first in one task, as long as WORDS allows; so many have their words looked up at once.
ASKED, TOGETHER = 1 << 18, 1 << 14


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves go up, as in Spark, what doubles lack of a half included."""
    return np.floor(np.round(x * 10.0**digits, 3) + 0.5) / 10.0**digits


class Lists:
    """Postings by word, words of few memories first; which words of many memories a memory has is also in its bit set."""

    def __init__(self, words: pa.Array):
        self.size = len(words)
        coded = pc.list_flatten(words).dictionary_encode()
        codes, self.words = coded.indices.to_numpy(), coded.dictionary
        found = np.bincount(codes, minlength=len(self.words))
        by = np.argsort(found, kind="stable")
        self.rank = np.empty(len(by), np.int32)  # of a code
        self.rank[by] = np.arange(len(by))
        self.start = np.concatenate([[0], np.cumsum(found[by])]).astype(np.int64)
        self.common = int(np.searchsorted(found[by], max(DENSE, self.size // 128)))  # the first word that bit sets have
        self.short = int(np.searchsorted(found[by], SHORT))  # the first word whose list is copied by itself
        self.room = np.empty(1 << 16, np.int64)
        ranks, memory = self.rank[codes], pc.list_parent_indices(words).to_numpy().astype(np.int32)
        del coded, codes
        self.bits = np.zeros((self.size, -(-(len(by) - self.common) // 64)), np.uint64)  # a memory's common words
        together = max(1, (1 << 24) // max(1, self.bits.shape[1] * 64))
        ends = np.searchsorted(memory, np.arange(0, self.size + together, together))
        for k, at in enumerate(range(0, self.size, together)):
            some = np.zeros((min(together, self.size - at), self.bits.shape[1] * 64), bool)
            r, m = ranks[ends[k] : ends[k + 1]], memory[ends[k] : ends[k + 1]]
            some[m[r >= self.common] - at, r[r >= self.common] - self.common] = True
            self.bits[at : at + together] = np.packbits(some, axis=1).view(np.uint64)
        self.owner = ranks.astype(np.int64)
        self.owner <<= 32
        self.owner |= memory
        self.owner.sort()
        self.owner &= 0xFFFFFFFF

    def sharing(self, own: np.ndarray, least: int, upto: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The memories, of all or the first, that have at least `least` of some words, given by sorted ranks, and how many each has."""
        m = len(own)
        if m < least:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        read = min(m, max(m - least + 1 + least // 6, int(np.searchsorted(own, self.common))))
        held = np.bincount(self.postings(own[:read]), minlength=self.size)[:upto]
        near = np.flatnonzero(held >= least - (m - read))
        held = held[near]
        if read < m and len(near):
            rest = np.zeros(self.bits.shape[1] * 64, bool)
            rest[own[read:] - self.common] = True
            held = held + np.bitwise_count(self.bits[near] & np.packbits(rest).view(np.uint64)).sum(axis=1, dtype=np.int64)
            near, held = near[held >= least], held[held >= least]
        return near, held

    def postings(self, own: np.ndarray) -> np.ndarray:
        """The memories of some words, one after another, valid until the next call: short lists by one index, the others by a copy each."""
        first, last = self.start[own], self.start[own + 1]
        few = int(np.searchsorted(own, self.short))
        size = (last - first)[:few]
        ends = np.cumsum(size)
        here = np.repeat(first[:few] - ends + size, size)
        here += np.arange(len(here))
        lists = [self.owner[here]]
        lists += [self.owner[a:b] for a, b in zip(first[few:].tolist(), last[few:].tolist())]
        total = len(here) + int((last - first)[few:].sum())
        if total > len(self.room):
            self.room = np.empty(2 * total, np.int64)
        return np.concatenate(lists, out=self.room[:total])


class Shard:
    """Postings of memories in impact order; words of many memories are bit sets too, by the memory and by the word."""

    def __init__(self, impact: np.ndarray, words: pa.Array):
        self.impact, self.size, self.lists = impact, len(impact), Lists(words)
        self.words, lists = self.lists.words, self.lists
        count = len(lists.rank) - lists.common
        self.bits = np.empty((count, -(-self.size // 64)), np.uint64)  # the memories of a common word
        for at in range(0, count, 256):
            some = np.zeros((min(256, count - at), self.bits.shape[1] * 64), bool)
            for k, row in enumerate(some):
                w = lists.common + at + k
                row[lists.owner[lists.start[w] : lists.start[w + 1]]] = True
            self.bits[at : at + 256] = np.packbits(some, axis=1).view(np.uint64)

    def postings(self, codes: np.ndarray) -> np.ndarray:
        """The memories of some words, one after another, valid until the next call."""
        return self.lists.postings(np.sort(self.lists.rank[codes]))

    def sharing(self, codes: np.ndarray) -> int:
        """How many memories have one of some words."""
        rows = self.lists.rank[codes] - self.lists.common
        union = np.bitwise_or.reduce(self.bits[rows[rows >= 0]], axis=0) if (rows >= 0).any() else np.zeros(self.bits.shape[1], np.uint64)
        seen = np.unpackbits(union.view(np.uint8)).view(bool)
        seen[self.postings(codes[rows < 0])] = True
        return int(np.count_nonzero(seen))

    def having(self, codes: np.ndarray, least: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the first memories, those that have at least `least` of some words, and how many each has."""
        return self.lists.sharing(np.sort(self.lists.rank[codes]), least, upto)


def _listed(words: pa.Array) -> pa.Array:
    """Words as lists, also where they come as one text, with spaces between them."""
    return pc.split_pattern(words, " ") if pa.types.is_string(words.type) or pa.types.is_large_string(words.type) else words


def _searched(weight: float, top: int, least: float, digits: int):
    """Of a shard (position, impact, id, words) and queries (query_id, n, words, safe): each query's best hits and, with a null id, how many there are."""
    names = ["query_id", "id", "relevance", "score", "found"]
    slack = 10.0**-digits

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows, asked = rows.sort_by("position"), asked.rename_columns(["_s", "_b", "query_id", "n", "words", "safe"])
        ids, named = (t.column(c).combine_chunks() for t, c in ((rows, "id"), (asked, "query_id")))
        if not len(ids) or not len(named):
            return pa.table([named.slice(0, 0), ids.slice(0, 0), *(pa.array([], k) for k in (pa.float64(), pa.float64(), pa.int64()))], names)
        shard = Shard(rows.column("impact").to_numpy(), _listed(rows.column("words").combine_chunks()))
        del rows
        place = np.empty(shard.size, np.int64)  # of ids in order, for ties
        place[pc.sort_indices(ids).to_numpy()] = np.arange(shard.size)
        rising, best, counts = -shard.impact, [], []
        for at in range(0, len(named), TOGETHER):
            part = asked.slice(at, TOGETHER)
            words = _listed(part.column("words").combine_chunks())
            code = pc.index_in(pc.list_flatten(words), shard.words)
            owner, known = pc.list_parent_indices(words).to_numpy(), code.is_valid().to_numpy(zero_copy_only=False)
            codes, owner = code.drop_null().to_numpy(), owner[known]
            ends = np.searchsorted(owner, np.arange(len(part) + 1))
            n, safe = part.column("n").to_numpy(), part.column("safe").to_numpy()
            for q in range(len(part)):
                own = codes[ends[q] : ends[q + 1]]
                if not len(own):
                    continue
                # impacts fall: beyond the prefix not even all words would do
                bar = max(safe[q], least)
                prefix = int(np.searchsorted(rising, weight * (len(own) / n[q]) - bar + 2 * slack, "right"))
                if shard.impact[-1] + weight / n[q] >= least + slack:  # whoever shares a word is a hit
                    hits = shard.sharing(own)
                else:
                    hits, prefix, bar = None, shard.size, least
                if prefix:
                    # nor do fewer words, even of the first memory
                    few = max(1, math.ceil((bar - 2 * slack - shard.impact[0]) * n[q] / weight)) if weight > 0 and bar > float("-inf") else 1
                    near, held = shard.having(own, few, prefix)
                    relevance = held / n[q]
                    exact = rounded(shard.impact[near] + weight * relevance, digits)
                    good = exact >= least
                    hits = int(good.sum()) if hits is None else hits
                    if len(near) > top:
                        good &= exact >= np.partition(exact, len(exact) - top)[len(exact) - top]
                    near, relevance, exact = near[good], relevance[good], exact[good]
                    order = np.lexsort((place[near], -exact))[:top]
                    best.append((np.full(len(order), at + q), near[order], relevance[order], exact[order]))
                if hits:
                    counts.append((at + q, hits))
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))
        who, which, relevance, score = (np.concatenate(x) for x in zip(none, *best))
        met, hits = np.array(counts, np.int64).reshape(-1, 2).T
        hit, count = (pa.table([named.take(pa.array(q)), *more], names) for q, more in (
            (who, (ids.take(pa.array(which)), pa.array(relevance), pa.array(score), pa.nulls(len(who), pa.int64()))),
            (met, (pa.nulls(len(met), ids.type), pa.nulls(len(met), pa.float64()), pa.nulls(len(met), pa.float64()), pa.array(hits))),
        ))
        return pa.concat_tables([hit, count]).combine_chunks()

    return run


def shard_size(n: int, shard: int = SHARD, wide: int = WIDE) -> int:
    """Memories, of n, in each shard but the first."""
    return max(shard, min(n // SHARDS, wide))


def _laid(rows: DataFrame, key: str, split: Callable[[Column], Column], *more: str) -> DataFrame:
    """(key, n, words, ...) of rows (key, text, ...), the words as one text, which is smaller than a list of texts where it is sent."""
    return rows.select(key, split(F.col("text")).alias("w"), *more).select(key, F.size("w").alias("n"), F.array_join("w", " ").alias("words"), *more)


def best_by_words(memories: DataFrame, queries: DataFrame, split: Callable[[Column], Column], top: int, weight: float = 1.0, least: float = 0.0, digits: int = 6, shard: int = SHARD, asking: int = ASKING, wide: int = WIDE, most: int = WORDS) -> DataFrame:
    """(query_id, id, relevance, score, rank, total_found) of memories (id, text, impact) for queries (query_id, text); split gives a text's distinct words, none with a space.

    relevance is the share of a query's words that a memory has, the score impact plus weight times relevance, rounded; hits
    share a word and score at least `least`. Each query gets its `top` best, ties to the smaller id, and how many hits it
    has in all. A null impact is no hit; queries and memories without words have none; repeated rows count each.
    """
    spark = memories.sparkSession
    held = frozen(_laid(memories.where("impact IS NOT NULL").select("id", "text", F.col("impact").cast("double").alias("impact")), "id", split, "impact"), "held").where("n > 0")
    placed = numbered(held, [F.desc("impact"), F.asc("id")])
    asked = frozen(_laid(queries, "query_id", split), "asked").where("n > 0")
    size = F.struct(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"))
    n, n_asked = held.agg(size).first()[0], asked.agg(size).first()[0]
    each = min(shard_size(n.rows, shard, wide), math.ceil(n.rows / max(1, math.ceil(n.words / most))))
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {placed.schema['id'].dataType.simpleString()}, relevance double, score double, found long"

    def met(own: DataFrame, place: Column, shards: int, blocks: int, known: DataFrame) -> DataFrame:
        own = own.withColumn("shard", place.cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks) - 1)))).select("shard", "block", "position", "impact", "id", "words")
        sent = known.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks))).cast("int"))
        pairs = own.groupBy("shard", "block").cogroup(sent.select("_s", "_b", "query_id", "n", "words", "safe").groupBy("_s", "_b"))
        return frozen(pairs.applyInArrow(_searched(weight, top, least, digits), kinds), "found")

    found = met(placed.where(F.col("position") < shard), F.lit(0), 1, math.ceil(n_asked.rows / asking), asked.withColumn("safe", F.lit(float("-inf")))) if n.rows else spark.createDataFrame([], kinds)
    if n.rows > shard:  # a query that has its fill from the best shard asks the others for better ones only
        w = Window.partitionBy("query_id").orderBy(F.desc("score"))
        safe = found.where("id IS NOT NULL").withColumn("_n", F.row_number().over(w)).where(F.col("_n") == top).groupBy(F.col("query_id").alias("_q")).agg(F.max("score").alias("_safe"))
        known = asked.join(safe, F.col("query_id") == F.col("_q"), "left").withColumn("safe", F.coalesce("_safe", F.lit(float("-inf"))))
        place = F.floor((F.col("position") - shard) / each)
        blocks = max(math.ceil(n_asked.rows / max(asking, ASKED)), math.ceil(n_asked.words / (2 * most)))
        found = found.unionByName(met(placed.where(F.col("position") >= shard), place, math.ceil((n.rows - shard) / each), blocks, known))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.where("id IS NOT NULL").withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top).drop("found")
    return best.join(found.groupBy("query_id").agg(F.sum("found").alias("total_found")), "query_id")


def _shared(top: int, digits: int):
    """Of a shard (id, words) and queries (query_id, n, words, safe): each query's best memories by the share of its words, none below safe."""
    names = ["query_id", "id", "relevance", "score"]

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows, asked = rows.rename_columns(["_s", "_b", "id", "words"]), asked.rename_columns(["_s", "_b", "query_id", "n", "words", "safe"])
        ids, named = (t.column(c).combine_chunks() for t, c in ((rows, "id"), (asked, "query_id")))
        if not len(ids) or not len(named):
            return pa.table([named.slice(0, 0), ids.slice(0, 0), pa.array([], pa.float64()), pa.array([], pa.float64())], names)
        shard = Lists(pc.split_pattern(rows.column("words").combine_chunks(), " "))
        place = np.empty(len(ids), np.int64)  # of ids in order, for ties
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        words = pc.split_pattern(asked.column("words").combine_chunks(), " ")
        code = pc.index_in(pc.list_flatten(words), shard.words)
        known = code.is_valid().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(known, dtype=np.int32)])[words.offsets.to_numpy()]
        codes = shard.rank[code.drop_null().to_numpy()]
        del words, code, known
        n, safe = asked.column("n").to_numpy(), asked.column("safe").to_numpy()
        # what is below would be rounded below safe
        least = np.maximum(1, np.ceil((np.maximum(safe, 0.0) - 10.0**-digits) * n)).astype(np.int64)
        who, which, both = [], [], []
        for q in np.flatnonzero(np.diff(ends) >= least):
            near, held = shard.sharing(np.sort(codes[ends[q] : ends[q + 1]]), int(least[q]))
            if len(near) > top:
                exact = rounded(held / n[q], digits)
                kept = np.flatnonzero(exact >= np.partition(exact, len(exact) - top)[len(exact) - top])
                kept = kept[np.lexsort((place[near[kept]], -exact[kept]))[:top]]
                near, held = near[kept], held[kept]
            who.append(np.full(len(near), q)), which.append(near), both.append(held)
        who, which, both = (np.concatenate([np.empty(0, np.int64), *x]) for x in (who, which, both))
        relevance = both / n[who]
        return pa.table([named.take(pa.array(who)), ids.take(pa.array(which)), pa.array(relevance), pa.array(rounded(relevance, digits))], names)

    return run


def best_by_share(memories: DataFrame, queries: DataFrame, split: Callable[[Column], Column], top: int, digits: int = 6, shard: int = SHARD, asking: int = ASKING // 2, wide: int = WIDE, most: int = WORDS) -> DataFrame:
    """(query_id, id, relevance, rank) of memories (id, text) for queries (query_id, text); split gives a text's distinct words, none with a space.

    The `top` best by the share of a query's words that a memory has, rounded, ties to the smaller id; who shares no word is
    no hit, nor is a null id; repeated rows count each. Hits are not counted, so that most pairs that share a word aren't met.
    """
    spark = memories.sparkSession
    held = frozen(_laid(memories.where("id IS NOT NULL"), "id", split).withColumn("seq", F.monotonically_increasing_id()), "held").where("n > 0")
    asked = frozen(_laid(queries, "query_id", split), "asked").where("n > 0")
    size = F.struct(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"))
    n, n_asked = held.agg(size).first()[0], asked.agg(size).first()[0]
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {held.schema['id'].dataType.simpleString()}, relevance double, score double"
    if not n.rows or not n_asked.rows:
        return spark.createDataFrame([], kinds.replace("score double", "rank long"))

    def met(own: DataFrame, shards: int, together: int, known: DataFrame) -> DataFrame:
        blocks = max(math.ceil(n_asked.rows / together), math.ceil(n_asked.words / (2 * most)))
        own = own.withColumn("_s", F.pmod(F.xxhash64("seq"), F.lit(shards)).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        sent = known.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        pairs = own.select("_s", "_b", "id", "words").groupBy("_s", "_b").cogroup(sent.select("_s", "_b", "query_id", "n", "words", "safe").groupBy("_s", "_b"))
        return frozen(pairs.applyInArrow(_shared(top, digits), kinds), "shared")

    longest = held.select("n", "seq").orderBy(F.desc("n"), "seq").limit(shard).collect()
    first = max(1, int((np.cumsum([r.n for r in longest]) <= most // 4).sum()))
    last = longest[first - 1]
    ahead = (F.col("n") > last.n) | ((F.col("n") == last.n) & (F.col("seq") <= last.seq))
    found = met(held.where(ahead), 1, shard_size(n_asked.rows, asking, wide), asked.withColumn("safe", F.lit(0.0)))
    if n.rows > first:  # the others are asked for what the longest don't have better
        w = Window.partitionBy("query_id").orderBy(F.desc("score"))
        safe = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == top).select(F.col("query_id").alias("_q"), F.col("score").alias("_safe"))
        known = asked.join(safe, F.col("query_id") == F.col("_q"), "left").withColumn("safe", F.coalesce("_safe", F.lit(0.0)))
        shards = max(math.ceil((n.rows - first) / shard_size(n.rows, shard, wide)), math.ceil(n.words / most))
        found = found.unionByName(met(held.where(~ahead), shards, max(asking, wide), known))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top).select("query_id", "id", "relevance", "rank")
