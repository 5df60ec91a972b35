"""Language identification by mixture inference.

A language is a multinomial over hashed byte trigrams of lower-cased words; a word's likelihood is that of its trigrams.
A document is a mixture: expectation-maximisation over its words estimates the languages' shares, for the best set of
one language, of two, and so on; the set with the largest penalised likelihood (BIC) stands, and its largest share is
the document's language. A word that a document repeats is weighed by its count, so that memory follows the distinct
words of a document, not its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_fold, frozen

#: Trigram buckets of a language, however many languages there are: 64 kB each in the model that every task gets.
BUCKETS = 1 << 14
#: What a task sums up of the training texts before it hands it on.
COUNTED_CELLS = 1 << 23
FOLDS, HELD_OUT = 3, 1
#: At most so many labelled documents of a language are learned from, those whose ids hash lowest.
TRAIN_ROWS = 1500
#: Distinct words of a batch times languages: what inference holds at once, unless one document has more.
BATCH_CELLS = 1 << 22
ROUNDS, PENALTY, LETTER = 12, 2.0, r"\p{L}"


def trigrams(words: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each word between spaces, and how many each word has. buckets is a power of two."""
    space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    flat = pc.binary_join_element_wise(space, words, space, none).cast(pa.large_binary())
    raw = np.frombuffer(flat.buffers()[2], np.uint8)
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw, ends = raw[ends[0] : ends[-1]].astype(np.uint32), ends - ends[0]
    n = np.diff(ends) - 2
    code = raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA6B) ^ raw[2:] * np.uint32(0xC2B2AE35) if len(raw) > 2 else raw[:0]
    code ^= code >> np.uint32(15)
    code = (code * np.uint32(0x2C1B3C6D)) >> np.uint32(33 - buckets.bit_length())
    inside = np.ones(len(code), bool)  # a trigram must not reach into the next word
    for back in (2, 1):
        at = ends[1:-1] - back
        inside[at[at < len(inside)]] = False
    return code[inside].astype(np.int64), n


def tokenised(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words that hold a letter, lower-cased, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    flat = pc.list_flatten(split)
    own = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    word = pc.match_substring_regex(flat, LETTER)
    keep = word.to_numpy(zero_copy_only=False)
    return np.bincount(own[keep], minlength=len(texts)), flat.filter(word)


def training_rows(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, most: int = TRAIN_ROWS) -> DataFrame:
    """(lang, text) of at most `most` documents of each language outside the held-out fold.

    Rows are known by a hash of id and text, chosen without their texts. Of each language only hashes below a share of
    the range that holds some 2 * most distinct ones are ranked, so that no task ranks a whole language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("doc_id"), folds) != held_out))
    marks = known.select("lang", F.xxhash64("doc_id", "text").alias("_m"))
    sizes = marks.groupBy("lang").agg(F.approx_count_distinct("_m", 0.02).alias("_n")).select(F.col("lang").alias("_lang"), F.least(F.lit(1.0), F.lit(2.0 * most) / F.greatest("_n", F.lit(1))).alias("_share"))
    sizes = frozen(sizes, "languages")
    place = (F.col("_m") / F.lit(2.0**64)) + 0.5  # of a hash in its range
    low = marks.join(sizes, F.col("lang") == F.col("_lang")).where(place <= F.col("_share")).groupBy("lang", "_m").agg(F.count(F.lit(1)).alias("_c"))
    ranked = low.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_m"))).where(F.col("_r") <= most)
    chosen = frozen(ranked.select(F.col("lang").alias("_lang"), F.col("_m").alias("_chosen")), "training-rows")
    return known.join(chosen, (F.col("lang") == F.col("_lang")) & (F.xxhash64("doc_id", "text") == F.col("_chosen")), "left_semi").select("lang", "text")


def count_trigrams(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(lang, bucket, n) over all rows of (lang, text); each task sums its own first."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], schema=schema)
            sums.clear()

        for x in batches:
            lang = x.column(0).dictionary_encode()
            own = lang.indices.to_numpy()
            for k, name in enumerate(lang.dictionary.to_pylist()):
                code, _ = trigrams(tokenised(x.column(1).filter(pa.array(own == k)))[1], buckets)
                sums[name] = sums.get(name, 0) + np.bincount(code, minlength=buckets)
                if len(sums) * buckets > COUNTED_CELLS:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, **how) -> tuple[list[str], np.ndarray]:
    """The languages by name and their log-likelihoods per bucket, smoothed by 1/2.

    The driver gets BUCKETS counts a language at most.
    """
    rows, buckets = frozen(training_rows(docs, **how), "training-texts"), BUCKETS
    found = count_trigrams(rows, buckets).toArrow()
    lang = found.column("lang").combine_chunks().dictionary_encode()
    names = sorted(lang.dictionary.to_pylist())
    place = {n: i for i, n in enumerate(names)}
    at = np.array([place[x] for x in lang.dictionary.to_pylist()], np.int64)
    counts = np.full((buckets, len(names)), 0.5)
    if len(names):
        counts[found.column("bucket").to_numpy(), at[lang.indices.to_numpy()]] += found.column("n").to_numpy()
    return names, np.log(counts / counts.sum(0)).astype(np.float32)


def fit(like: np.ndarray, first: np.ndarray, doc: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Shares and log-likelihood of each document's mixture over its allowed languages.

    like: log-likelihoods, words by languages; first: each document's first word; doc: each word's document; times: how
    often the word stands there, once unless given.
    """
    times = np.ones(len(like)) if times is None else times.astype(np.float64)
    top = like.max(1, keepdims=True)
    p = np.exp(like - top)
    n = np.add.reduceat(times, first)[:, None]
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        part = p * share[doc]
        part *= (times / np.maximum(part.sum(1), 1e-300))[:, None]
        share = np.add.reduceat(part, first) / n
    total = np.log(np.maximum((p * share[doc]).sum(1), 1e-300)) + top[:, 0]
    return share, np.add.reduceat(total * times, first)


def infer(like: np.ndarray, sizes: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, its share and the shares of the whole chosen set, 0 outside it, of documents that have `sizes` > 0 rows of like each, rows standing for `times` words.

    Sets grow from the best single language by the languages' shares in the full mixture; a set of k costs
    penalty * (k - 1) * ln(words) / 2. Growth ends where a document's penalised likelihood falls.
    """
    times = np.ones(len(like)) if times is None else times.astype(np.float64)
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    words = np.add.reduceat(times, first)
    k = like.shape[1]
    sums = np.add.reduceat(like.astype(np.float64) * times[:, None], first)
    rows = np.arange(len(sizes))
    best_lang, best_share, best_value = sums.argmax(1), np.ones(len(sizes)), sums.max(1)
    best_set = np.zeros((len(sizes), k))
    best_set[rows, best_lang] = 1
    if k == 1:
        return best_lang, best_share, best_set
    full, _ = fit(like, first, doc, np.ones((len(sizes), k)), rounds, times)
    full[rows, best_lang] += 2  # the best single language comes first
    order = np.argsort(-full, axis=1, kind="stable")
    open_ = full[rows, order[:, 1]] * words >= 1  # a second language with less than one word can't pay for itself
    for size in range(2, k + 1):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        allowed = np.zeros((len(at), k))
        np.put_along_axis(allowed, order[at, :size], 1, axis=1)
        mine = open_[doc]
        n = sizes[at]
        share, value = fit(like[mine], np.cumsum(n) - n, np.repeat(np.arange(len(at)), n), allowed, rounds, times[mine])
        value = value - penalty * (size - 1) * np.log(words[at] + 1) / 2
        better = value > best_value[at]
        win = at[better]
        best_value[win], best_lang[win], best_share[win], best_set[win] = value[better], share[better].argmax(1), share[better].max(1), share[better]
        open_[at[~better]] = False
    return best_lang, best_share, best_set


def predictor(names: list[str], table: np.ndarray, penalty: float, cells: int = BATCH_CELLS):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))])
    buckets = len(table)

    def of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list, list]:
        """Language and share of each text, and the chosen set with its shares, the largest first."""
        sizes, words = tokenised(texts)
        lang, score = np.full(len(sizes), "und", object), np.zeros(len(sizes))
        sets, shares = [[] for _ in sizes], [[] for _ in sizes]
        if not len(words) or not names:
            return lang, score, sets, shares
        kinds = words.dictionary_encode()
        code, n = trigrams(kinds.dictionary, buckets)
        kind = np.empty((len(n), len(names)), np.float32)  # a word's likelihood, once for all its places
        ends, at = np.cumsum(n), 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + max(1, cells // len(names)), side="right")))
            begin = int(ends[at - 1]) if at else 0
            kind[at:to] = np.add.reduceat(table[code[begin : int(ends[to - 1])]], ends[at:to] - n[at:to] - begin)
            at = to
        own = np.repeat(np.arange(len(sizes)), sizes)
        pair, times = np.unique(own * len(n) + kinds.indices.to_numpy(), return_counts=True)
        doc, word = pair // len(n), pair % len(n)
        has, each = np.unique(doc, return_counts=True)
        cuts, total = [0], 0
        for d, m in enumerate(each.tolist()):  # documents are inferred together as long as their words are few
            if total and (total + m) * len(names) > cells:
                cuts.append(d)
                total = 0
            total += m
        starts = np.concatenate(([0], np.cumsum(each)))
        for s, e in zip(cuts, [*cuts[1:], len(each)]):
            rows = slice(int(starts[s]), int(starts[e]))
            best, share, chosen = infer(kind[word[rows]], each[s:e], penalty, times=times[rows])
            lang[has[s:e]], score[has[s:e]] = np.array(names, object)[best], share
            for d, own in zip(has[s:e].tolist(), chosen):
                order = np.argsort(-own, kind="stable")[: np.count_nonzero(own)]
                sets[d], shares[d] = [names[i] for i in order], own[order].tolist()
        return lang, score, sets, shares

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at in range(0, x.num_rows, 128):
                s = x.slice(at, 128)
                lang, score, sets, shares = of(s.column(2))
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(sets, schema.field(4).type), pa.array(shares, schema.field(5).type)], schema=schema)

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, folds: int = FOLDS, held_out: int = HELD_OUT, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages, shares), one row for each row of docs, from its text alone.

    languages is the set that the penalised likelihood selects, shares their parts of the text, the largest first.

    lang_pred is `und` with score 0 for a null text, one without a letter, and wherever no language was learned; else the
    language with the largest share in the chosen set, ties to the first by name. A null id is kept and falls into the
    fold of the empty id. The model, BUCKETS floats a language, goes to every task; no language is left out, and a
    language's likelihoods don't depend on how many others there are.
    """
    names, table = model or train(docs, folds=folds, held_out=held_out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_fold(F.col("doc_id"), folds) == held_out).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predictor(names, table, penalty), "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>")
