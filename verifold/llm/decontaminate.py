"""Benchmark decontamination: a BM25 index of the test items, block-max WAND, then overlap of question and answer.

Test items are the documents of the index, passages of training documents are the queries. An item's scores are divided
by its score against itself, so that one threshold serves all items. An item's essential terms are its longest words,
all but a rest of its weight; a passage that reaches the threshold has at least threshold - rest from them alone. That
sum is taken for all passages and items at once, over the essential postings; the passages that remain for any item walk
all postings by block-max WAND, which finds every item at the threshold or above.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, frozen

K1, B = 1.2, 0.75
#: Items are indexed in blocks of at most so many, and of so many bytes of text; each block is sent to all tasks. Document
#: frequencies, the number of items and their mean length are those of all items, so that blocks don't change a score.
ITEMS, ITEM_BYTES = 20_000, 16_000_000
THRESHOLD, OVERLAP, SHINGLE, BLOCK = 0.6, 0.5, 5, 16
#: The share of the threshold that unessential terms may carry.
REST = 2 / 3

SCHEMA = "doc_id long, item_id long, score double, passages long, question_overlap double, answer_overlap double, first_word long, last_word long"


#: What is stripped off the edges of words, in items and passages alike; a word of nothing else stays as it is.
EDGES = string.punctuation


def raw_words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def split_words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, without punctuation at their edges."""
    return [w.strip(EDGES.encode()) or w for w in raw_words(text)]


def question_and_answer(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The last line of an item is its answer; of a single line, the last sentence; of a single sentence, its last third."""
    t = (text or "").strip()
    head, sep, tail = t.rpartition("\n")
    if not sep:
        head, sep, tail = t.rstrip(".!? ").rpartition(". ")
    if sep and raw_words(head) and raw_words(tail):
        return raw_words(head), raw_words(tail)
    w = raw_words(t)
    cut = len(w) - len(w) // 3
    return w[:cut], w[cut:]


def parts(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The words of an item as split_words() has them, cut where question_and_answer() cuts. None is lost but lone punctuation at the end."""
    w, cut = split_words(text), len(question_and_answer(text)[0])
    while len(w) > cut + 1 and not w[-1].strip(EDGES.encode()):
        w.pop()
    return w[:cut], w[cut:]


def shingles(w: list[bytes], n: int) -> set:
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


class ItemIndex:
    """Inverted index of one block of items, with block maxima.

    stats: document frequencies of at least the block's terms, number of items and their mean length; the block's own unless given.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, block: int = BLOCK, shingle: int = SHINGLE, stats: tuple[dict, int, float] | None = None):
        self.threshold, self.block, self.shingle, rest = threshold, block, shingle, REST * threshold
        self.needed = threshold - rest
        split = [(i, *parts(t)) for i, t in items]
        self.items = [(i, q, a) for i, q, a in split if q or a]
        bags = [Counter(q + a) for _, q, a in self.items]
        df, n, mean = stats or (Counter(t for b in bags for t in b), len(bags), sum(sum(b.values()) for b in bags) / max(1, len(bags)))
        idf = {t: math.log(1 + (n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
        self.ids, post, essential = {}, [], []
        for k, b in enumerate(bags):
            norm = K1 * (1 - B + B * sum(b.values()) / mean)
            weight = {t: idf[t] * f * (K1 + 1) / (f + norm) for t, f in b.items()}
            own, left = sum(weight.values()), 1.0
            for t in sorted(weight, key=lambda t: (-len(t), t)):  # long words are rare in any corpus
                at = self.ids.setdefault(t, len(self.ids))
                if at == len(post):
                    post.append([])
                    essential.append(False)
                post[at].append((k, weight[t] / own))
                if left > rest:
                    essential[at] = True
                    left -= weight[t] / own
        self.docs = [[k for k, _ in p] for p in post]
        self.impacts = [[x for _, x in p] for p in post]
        self.most = [max(p) for p in self.impacts]
        self.blocks = [[max(p[i : i + block]) for i in range(0, len(p), block)] for p in self.impacts]
        self.essential = np.array([*essential, False])
        sizes = [len(d) if e else 0 for d, e in zip(self.docs, essential)] + [0]
        self.post_size, self.post_start = np.array(sizes), np.cumsum([0, *sizes[:-1]])  # essential postings, term by term
        self.post_item = np.array([k for d, e in zip(self.docs, essential) if e for k in d], np.int64)
        self.post_impact = np.array([x for p, e in zip(self.impacts, essential) if e for x in p], np.float64)
        self.shingled = [(shingles(q, max(1, min(shingle, len(q)))), shingles(a, max(1, min(shingle, len(a))))) for _, q, a in self.items]

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items that a set of terms scores at the threshold or above: block-max WAND over the terms' postings."""
        goal, block, out = self.threshold - 1e-9, self.block, []
        cursor = [[self.docs[t][0], 0, t] for t in terms]
        while cursor:
            cursor.sort()
            total, pivot = 0.0, -1
            for i, c in enumerate(cursor):
                total += self.most[c[2]]
                if total >= goal:
                    pivot = i
                    break
            if pivot < 0:
                break
            doc = cursor[pivot][0]
            while pivot + 1 < len(cursor) and cursor[pivot + 1][0] == doc:
                pivot += 1
            bound, jump = 0.0, None  # block maxima of the lists up to the pivot, for the blocks that hold its item
            for c in cursor[: pivot + 1]:
                docs, at = self.docs[c[2]], c[1] // block
                while (end := min(len(docs), (at + 1) * block)) < len(docs) and docs[end - 1] < doc:
                    at += 1
                bound += self.blocks[c[2]][at]
                if docs[end - 1] >= doc:
                    jump = docs[end - 1] + 1 if jump is None else min(jump, docs[end - 1] + 1)
            if bound >= goal and cursor[0][0] == doc:
                score = sum(self.impacts[c[2]][c[1]] for c in cursor[: pivot + 1])
                if score >= goal:
                    out.append((doc, score))
                target = doc + 1
            elif bound >= goal:
                target = doc
            else:
                target = max(doc + 1, jump) if jump is not None else doc + 1
                if pivot + 1 < len(cursor):
                    target = min(target, max(doc + 1, cursor[pivot + 1][0]))
            for c in cursor[: pivot + 1]:
                docs, at = self.docs[c[2]], c[1]
                while at < len(docs) and docs[at] < target:
                    at += 1
                c[0], c[1] = (docs[at] if at < len(docs) else -1), at
            cursor = [c for c in cursor if c[0] >= 0]
        return out

    def overlaps(self, item: int, passage: list[bytes]) -> tuple[float, float]:
        """Shares of the question's and of the answer's word shingles that the passage holds; 1 for an empty part."""
        _, q, a = self.items[item]
        found = [len(own & shingles(passage, max(1, min(self.shingle, len(part))))) / len(own) if own else 1.0 for own, part in zip(self.shingled[item], (q, a))]
        return found[0], found[1]


def matcher(index: ItemIndex, overlap: float, longest: int):
    """Arrow batches of (doc_id, text) to rows of SCHEMA; longest: words of the longest item of all blocks."""
    window = max(64, 2 * longest)
    stride = window // 2
    value_set = pa.array(list(index.ids), pa.binary())
    unknown = len(index.ids)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("passages", pa.int64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])

    def of_slice(ids: pa.Array, texts: pa.Array) -> Iterator[tuple]:
        # lowered before the cast: ascii_lower misreads a slice that was cast
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string()))
        flat = pc.list_flatten(split)
        sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        bare = pc.ascii_trim(flat, characters=EDGES)
        flat = pc.if_else(pc.equal(bare, ""), flat, bare)
        codes = pc.fill_null(pc.index_in(flat.cast(pa.large_binary()).cast(pa.binary()), value_set=value_set), unknown).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        begin = ends - sizes
        count = np.maximum(1, -(-(sizes - stride) // stride)) * (sizes > 0)  # windows of a text: each starts where a stride does
        base = np.cumsum(count) - count
        doc = np.repeat(np.arange(len(sizes)), count)
        start = begin[doc] + (np.arange(len(doc)) - base[doc]) * stride
        stop = np.minimum(start + window, ends[doc])
        # essential terms: each stands in the window that its stride begins and in the one before
        at = np.flatnonzero(index.essential[codes])
        own = np.searchsorted(ends, at, side="right")
        nth = (at - begin[own]) // stride
        term = codes[at]
        in_window = np.concatenate((base[own] + nth, base[own] + nth - 1))[(inside := np.concatenate((nth < count[own], nth > 0)))]
        term = np.concatenate((term, term))[inside]
        n = index.post_size[term]
        post = np.repeat(index.post_start[term] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pairs, which = np.unique(np.repeat(in_window, n) * len(index.items) + index.post_item[post], return_inverse=True)
        sums = np.bincount(which, weights=index.post_impact[post], minlength=len(pairs))
        maybe = np.unique(pairs[sums >= index.needed - 1e-6] // max(1, len(index.items)))
        found: dict = {}
        for m in maybe.tolist():
            s, e, d = int(start[m]), int(stop[m]), int(doc[m])
            own = codes[s:e]
            for item, score in index.search(np.unique(own[own < unknown]).tolist()):
                passage = flat.slice(s, e - s).cast(pa.large_binary()).to_pylist()
                q, a = index.overlaps(item, passage)
                if q >= overlap and a >= overlap:
                    was = found.get((d, item), (0.0, 0, 0.0, 0.0, s, e))
                    found[d, item] = (max(was[0], score), was[1] + 1, max(was[2], q), max(was[3], a), min(was[4], s), max(was[5], e))
        for (d, item), (score, n, q, a, s, e) in found.items():
            yield ids[d].as_py(), index.items[item][0], score, n, q, a, s - int(begin[d]), e - int(begin[d])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at in range(0, x.num_rows, 512):
                part = x.slice(at, 512)
                rows = list(of_slice(part.column(0), part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def known_items(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()


def item_blocks(items: DataFrame, most: int = ITEMS, most_bytes: int = ITEM_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The test items, fetched in id order in blocks of bounded size; blocks are cut by the driver as rows arrive."""
    block, size = [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        if block and (len(block) >= most or size + len(r.text) > most_bytes):
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield block


def term_statistics(items: DataFrame) -> DataFrame:
    """(term, n, total) over all items with words: how many have a term, and how often in all; the empty term stands for the items themselves."""
    schema = pa.schema([("term", pa.binary()), ("tf", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for t in x.column(0):
                bag = Counter(w for part in parts(t.as_py()) for w in part)
                if bag:
                    bag[b""] = sum(bag.values())
                    yield pa.RecordBatch.from_arrays([pa.array(list(bag), pa.binary()), pa.array(list(bag.values()), pa.int64())], schema=schema)

    return items.select("text").mapInArrow(run, "term binary, tf long").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("total"))


def statistics_of(block: list[tuple[int, str]], terms: DataFrame) -> tuple[dict, int, float]:
    """What ItemIndex needs to know about all items, for the terms of a block, which ITEM_BYTES bounds."""
    own = {b""} | {w for _, t in block for part in parts(t) for w in part}
    wanted = terms.sparkSession.createDataFrame(pa.table({"term": pa.array(sorted(own), pa.binary())}))
    found = {bytes(r.term): (r.n, r.total) for r in terms.join(F.broadcast(wanted), "term", "left_semi").collect()}
    n, total = found.pop(b"", (0, 0))
    return {t: k for t, (k, _) in found.items()}, n, total / max(1, n)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, most: int = ITEMS) -> DataFrame:
    """Rows of SCHEMA: a document and a test item whose question and answer one of its passages holds.

    Every document is cut into passages of twice the longest item, at least 64 words, that begin every half passage, so
    that any stretch as long as an item lies whole in one. score is the largest over passages, passages how many
    matched, first_word and last_word their extent in words. Null and wordless texts and items match nothing; repeated
    documents give repeated rows; a null doc_id is kept; extra columns are not read; no items give an empty result.
    Scores don't depend on how items fall into blocks; passages are as long as the longest item of all needs.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = frozen(known_items(items), "items")
    terms = frozen(term_statistics(known), "item-terms")
    longest = known.agg(F.max(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    out = None
    for block in item_blocks(known, most):
        index = ItemIndex(block, threshold, stats=statistics_of(block, terms))
        if index.items:
            part = rows.mapInArrow(matcher(index, overlap, longest), SCHEMA)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def without_contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of docs that hold no test item. Rows with a null id can't be told apart: all go if one of them holds an item."""
    ids = frozen(contaminated(docs, items, **how).select(F.col("doc_id").alias("_id")).distinct(), "leaks")
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_anti")
