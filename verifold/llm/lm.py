"""Language-model scoring by a weighted backoff automaton.

The model interpolates orders 1 to ORDER, each smoothed towards the one below, the lowest by adding one:

    p(w | h) = (c(h w) + MU p(w | h')) / (c(h) + MU),    p(w) = (c(w) + 1) / (N + V + 1)

where h' is h without its first word. As an automaton: a state for each context h of one word that training texts hold and
of more words that they hold LEAST times, and one for no context; a state's arcs are the n-grams seen after it, and its
failure arc, of weight MU / (c(h) + MU), leads to the state of h'. Reading a text from left to right, a token takes
failure arcs until the state has an arc for it, then that arc, and leaves the state of the longest context that ends in it;
log10 of the weights adds up.

The counts grow with the corpus, so the model is on no machine as a whole. Documents form blocks of bounded size. A
block lists its distinct n-grams; their counts are exchanged by ranges of the n-grams' hashes, and each block gets back
the corpus counts of its own n-grams: the part of the automaton that its texts can reach, on which it then runs all its
texts, many stretches of text side by side. What is shuffled are sorted arrays of n-grams, not rows. A sender deals its
n-grams to at most FAN ranges; where more are needed, what FAN senders sent to a range is summed and dealt further, so
that the number of rows follows the number of n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, frozen

ORDER, MU, LEAST = 3, 4.0, 2
#: A block is closed at so many tokens; memory follows it. A range of the exchange has about so many n-grams. Dealing further
#: writes all n-grams anew, so a sender deals to as many ranges as some 30 GB of texts need.
BLOCK_TOKENS, PART_GRAMS, FAN = 1_000_000, 4_000_000, 8192
#: n-grams of two words and more are exchanged by so many bits of their hash beyond those that number them: one in 2^22
#: meets another. Words, whose counts the base score is made of, are exchanged by all of theirs but one.
SPARE_BITS = 22
#: Tokens that one lane reads of a text.
STRETCH = 256
FOLDS, HELD_OUT = 7, 2
END, BEGIN = 0xE5D0000000000001, 0xBE61000000000002

BLOCKS = "block long, doc_ids binary, held binary, sizes binary, tokens binary, vocab binary, grams long"
KEYS = "part long, sender long, keys binary, counts binary"
TOTALS = "sender long, part long, totals binary, seen long, token_sum long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

_CODEC = pa.Codec("zstd", 1)


def packed(x: np.ndarray) -> bytes:
    """An array of longs as compressed bytes: its length, then each byte place by itself, as far as any is used."""
    raw = np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8)
    used = 8
    while used and not raw[:, used - 1].any():
        used -= 1
    body = np.ascontiguousarray(raw[:, :used].T).tobytes()
    return len(x).to_bytes(8, "little") + bytes([used]) + (_CODEC.compress(body, asbytes=True) if body else b"")


def unpacked(b: bytes) -> np.ndarray:
    n, used = int.from_bytes(b[:8], "little"), b[8]
    out = np.zeros((n, 8), np.uint8)
    if n and used:
        out[:, :used] = np.frombuffer(_CODEC.decompress(b[9:], decompressed_size=n * used, asbytes=True), np.uint8).reshape(used, n).T
    return out.reshape(-1).view(np.int64)


def packed_keys(x: np.ndarray) -> bytes:
    """Sorted exchange_keys() by their differences: those of longer n-grams without the bits that all of them lack, then those of words."""
    odd = (x & np.uint64(1)).astype(bool)
    longer, words = x[~odd], x[odd]
    used = int(np.bitwise_or.reduce(longer)) if len(longer) else 0
    drop = (used & -used).bit_length() - 1 if used else 0
    one, two = (packed(np.diff(k, prepend=np.uint64(0)).view(np.int64)) for k in (longer >> np.uint64(drop), words))
    return bytes([drop]) + len(one).to_bytes(8, "little") + one + two


def unpacked_keys(b: bytes) -> np.ndarray:
    at = 9 + int.from_bytes(b[1:9], "little")
    longer, words = (np.cumsum(unpacked(x).view(np.uint64), dtype=np.uint64) for x in (b[9:at], b[at:]))
    return np.sort(np.concatenate((longer << np.uint64(b[0]), words)), kind="stable")


def pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit hash of an n-gram from those of its context and its last word."""
    with np.errstate(over="ignore"):
        x = context * np.uint64(0x9E3779B97F4A7C15) ^ (word << np.uint64(31) | word >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class Block:
    """Tokens of some documents as places in a vocabulary of hashes, each text between the beginning (1) and the end (0).

    ids[n] numbers, at each token, the distinct n + 1-gram that ends there, -1 where the text is too short for one; the
    n + 1-gram has a context, the n-gram before its last word, and a suffix, the n-gram without its first word.
    """

    def __init__(self, sizes: np.ndarray, tokens: np.ndarray, vocab: np.ndarray, held: np.ndarray, order: int = ORDER):
        self.sizes, self.tokens, self.vocab, self.held, self.order = sizes, tokens, vocab, held, order
        self.first = np.cumsum(sizes) - sizes
        self.learns = np.repeat(~held, sizes)
        depth = np.arange(len(tokens)) - np.repeat(self.first, sizes)
        self.ids, self.hashes, self.context, self.suffix = [tokens], [vocab], [None], [None]
        for n in range(1, order):
            at = np.flatnonzero(depth >= n)
            kinds, where, own = np.unique(self.ids[-1][at - 1] * len(vocab) + tokens[at], return_index=True, return_inverse=True)
            ids = np.full(len(tokens), -1, np.int64)
            ids[at] = own
            self.context.append(kinds // len(vocab))
            self.suffix.append(self.ids[-1][at[where]])
            self.hashes.append(pair_hash(self.hashes[-1][self.context[-1]], vocab[kinds % len(vocab)]))
            self.ids.append(ids)

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all n-grams (the beginning among the words, as a context), their counts in training texts, and a 1 for each word but the beginning."""
        counts = [np.bincount(i[self.learns & (i >= 0)], minlength=len(h)) for i, h in zip(self.ids, self.hashes)]
        word = np.zeros(sum(map(len, counts)), np.int64)
        word[: len(self.vocab)] = 1
        word[1] = 0
        return np.concatenate(self.hashes), np.concatenate(counts).astype(np.int64), word

    def automaton(self, totals: np.ndarray, n: int, v: int, mu: float, least: int) -> tuple[list, list, list, list]:
        """Per order: whether an n-gram is an arc, log10 of its weight, whether it is a state, log10 of its failure arc."""
        counts = [x.astype(np.float64) for x in np.split(totals, np.cumsum([len(h) for h in self.hashes])[:-1])]
        p = (counts[0] + 1) / (n + v + 1)
        arc, weight = [np.ones(len(p), bool)], [np.log10(p)]
        state = [c >= (least if k else 1) for k, c in enumerate(counts)]
        fail = [np.log10(mu / (c + mu)) for c in counts]
        for k in range(1, self.order):
            lower = p[self.suffix[k]]
            c, h, known = counts[k], counts[k - 1][self.context[k]], state[k - 1][self.context[k]]
            p = np.where(known, (c + mu * lower) / (h + mu), lower)
            arc.append(known & (c > 0))
            weight.append(np.log10(p))
        return arc, weight, state, fail

    def scores(self, totals: np.ndarray, n: int, v: int, mu: float = MU, least: int = LEAST, stretch: int = STRETCH) -> tuple[np.ndarray, ...]:
        """Per document: tokens, known tokens, base score, model score. totals are corpus counts in the order of grams()."""
        arc, weight, state, fail = self.automaton(totals, n, v, mu, least)
        last = self.first + self.sizes
        add = lambda x: np.add.reduceat(x, self.first) if len(self.first) else x[:0]
        real = self.tokens != 1
        known = real & (totals[: len(self.vocab)] > 0)[self.tokens]
        base = np.where(real, weight[0][self.tokens], 0.0)
        # a text is read in stretches, each by a lane that first reads the order - 1 tokens before it, which settle its state
        pieces = -(-(self.sizes - 1) // stretch)
        doc = np.repeat(np.arange(len(self.sizes)), pieces)
        begin = self.first[doc] + 1 + stretch * (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        stop = np.minimum(begin + stretch, last[doc])
        at = np.maximum(begin - (self.order - 1), self.first[doc])
        order = np.argsort(at - stop, kind="stable")  # the longest first, so that those still reading are the first lanes
        doc, begin, stop, at = doc[order], begin[order], stop[order], at[order]
        total, length = np.zeros(len(doc)), np.zeros(len(doc), np.int64)  # length: words of the state's context
        step, lanes = 0, len(doc)
        while True:
            lanes = int(np.searchsorted(at[:lanes] + step - stop[:lanes], 0))
            if not lanes:
                break
            here, k, gain = at[:lanes] + step, length[:lanes].copy(), np.zeros(lanes)
            for m in range(self.order - 1, 0, -1):  # failure arcs, from the longest context down
                some = np.flatnonzero(k == m)
                if len(some):
                    missing = some[~arc[m][self.ids[m][here[some]]]]
                    gain[missing] += fail[m - 1][self.ids[m - 1][here[missing] - 1]]
                    k[missing] -= 1
            for m in range(self.order):
                some = np.flatnonzero(k == m)
                gain[some] += weight[m][self.ids[m][here[some]]]
            counted = here >= begin[:lanes]
            total[:lanes][counted] += gain[counted]
            k = np.minimum(k + 1, self.order - 1)
            for m in range(self.order - 1, 0, -1):
                some = np.flatnonzero(k == m)
                k[some[~state[m - 1][self.ids[m - 1][here[some]]]]] -= 1
            length[:lanes] = k
            step += 1
        return self.sizes - 1, add(known.astype(np.int64)), add(base), np.bincount(doc, weights=total, minlength=len(self.sizes))


def _tokenised(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words per text, and the flat words, A-Z lower-cased."""
    # lowered before the cast: ascii_lower misreads a slice that was cast
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string())))
    flat = pc.list_flatten(split)
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    if (lone := pc.equal(flat, "")) and pc.any(lone).as_py():  # an empty text splits into one empty word
        empty = lone.to_numpy(zero_copy_only=False)
        sizes = sizes - np.bincount(np.repeat(np.arange(len(sizes)), sizes)[empty], minlength=len(sizes))
        flat = flat.filter(pc.invert(lone))
    return sizes, flat


def block_writer(block_tokens: int, order: int):
    schema = pa.schema([("block", pa.int64()), *[(k, pa.binary()) for k in ("doc_ids", "held", "sizes", "tokens", "vocab")], ("grams", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        ids, held, sizes, codes, words, total = [], [], [], [], {}, 0

        def close() -> pa.RecordBatch:
            nonlocal nth, total
            vocab = np.fromiter((END, BEGIN, *(xxhash.xxh64_intdigest(w, 42) for w in words)), np.uint64, len(words) + 2)
            n = np.concatenate(sizes) + 2
            ends = np.cumsum(n)
            tokens = np.zeros(int(n.sum()), np.int64)
            tokens[ends - n] = 1
            place = np.ones(len(tokens), bool)
            place[ends - n] = place[ends - 1] = False
            tokens[place] = np.concatenate(codes) + 2
            # doc ids: a flag for null, and the id
            own = pa.concat_arrays(ids)
            flags = np.concatenate(held).astype(np.int64) | own.is_null().to_numpy(zero_copy_only=False).astype(np.int64) << 1
            row = [part * 1_000_000 + nth, packed(pc.fill_null(own, 0).to_numpy()), packed(flags), packed(n), packed(tokens), packed(vocab.view(np.int64)), len(vocab) + (order - 1) * len(tokens)]
            nth, total = nth + 1, 0
            for x in (ids, held, sizes, codes, words):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for x in batches:
            for at in range(0, x.num_rows, 256):
                s = x.slice(at, 256)
                n, flat = _tokenised(s.column(1))
                d = flat.cast(pa.large_binary()).dictionary_encode()
                own = np.fromiter((words.setdefault(w, len(words)) for w in d.dictionary.to_pylist()), np.int64, len(d.dictionary))
                ids.append(s.column(0))
                held.append(s.column(2).to_numpy(zero_copy_only=False))
                sizes.append(n)
                codes.append(own[d.indices.to_numpy()] if len(d) else np.empty(0, np.int64))
                total += len(d) + len(n)
                if total >= block_tokens:
                    yield close()
        if ids:
            yield close()

    return run


def _load(x: dict, order: int) -> tuple[np.ndarray, np.ndarray, Block]:
    flags = unpacked(x["held"])
    return unpacked(x["doc_ids"]), flags, Block(unpacked(x["sizes"]), unpacked(x["tokens"]), unpacked(x["vocab"]).view(np.uint64), (flags & 1).astype(bool), order)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The range of each key; parts is a power of two."""
    return (keys >> np.uint64(64 - (parts.bit_length() - 1))).astype(np.int64) if parts > 1 else np.zeros(len(keys), np.int64)


def exchange_keys(hashes: list[np.ndarray], bits: int) -> np.ndarray:
    """Keys of words, all odd, and of longer n-grams, all even and of so many bits at most, so that neither takes the other's count."""
    out = np.concatenate(hashes)
    out[: len(hashes[0])] |= np.uint64(1)
    out[len(hashes[0]) :] &= np.uint64((1 << 64) - (1 << (64 - bits)))  # bits are 63 at most
    return out


_KEY_SCHEMA = pa.schema([("part", pa.int64()), ("sender", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_TOTAL_SCHEMA = pa.schema([("sender", pa.int64()), ("part", pa.int64()), ("totals", pa.binary()), ("seen", pa.int64()), ("token_sum", pa.int64())])


def _dealt(sender: int, keys: np.ndarray, what: np.ndarray, parts: int, span: int) -> pa.Table:
    """Sorted keys of a sender, cut at ranges of `span` parts each."""
    own = _part(keys, parts) // span
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1, [len(own)])) if len(own) else np.zeros(1, np.int64)
    rows = [(int(own[s]), sender, packed_keys(keys[s:e]), packed(what[s:e])) for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_KEY_SCHEMA)], schema=_KEY_SCHEMA)


def key_writer(parts: int, span: int, bits: int, order: int):
    """A block's n-grams, dealt to ranges of their hash and sorted; a count's lowest bit says whether it is a word's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                block = _load(x, order)[2]
                counts, word = block.grams()[1:]
                keys = exchange_keys(block.hashes, bits)
                del block  # the larger part of what a task holds
                at = np.argsort(keys, kind="stable")
                yield from _dealt(x["block"], keys[at], counts[at] << 1 | word[at], parts, span).to_batches()

    return run


def _joined(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of what several senders sent: each one's keys, the distinct keys, where each key is among them, their sums and word marks."""
    keys = [unpacked_keys(x) for x in table.column("keys").to_pylist()]
    each = np.concatenate([unpacked(x) for x in table.column("counts").to_pylist()])
    kinds, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(kinds), np.int64)
    np.add.at(sums, at, each >> 1)
    word = np.zeros(len(kinds), np.int64)
    word[at[(each & 1) == 1]] = 1
    return keys, kinds, at, sums, word


def _returned(table: pa.Table, keys: list[np.ndarray], own: np.ndarray, seen: int, token_sum: int) -> pa.Table:
    """Each sender's totals in the order of its own keys; what a range knows of all words goes with its first row."""
    senders, part = table.column("sender").to_pylist(), table.column("part").to_pylist()
    cut = np.split(own, np.cumsum([len(k) for k in keys])[:-1])
    first = [1] + [0] * (len(senders) - 1)
    cols = [senders, part, [packed(x) for x in cut], [seen * f for f in first], [token_sum * f for f in first]]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _TOTAL_SCHEMA)], schema=_TOTAL_SCHEMA)


def totals_of_part(table: pa.Table) -> pa.Table:
    """Of all n-grams in a range: the sums over senders, handed back to each."""
    keys, _, at, sums, word = _joined(table)
    seen, token_sum = int(((sums > 0) & (word == 1)).sum()), int(sums[word == 1].sum())
    return _returned(table, keys, sums[at], seen, token_sum)


def summed(sent: DataFrame, parts: int, span: int, senders: int, fan: int) -> DataFrame:
    """TOTALS for rows of KEYS that were dealt by ranges of `span` parts: what a bundle of senders sent to a range is summed
    and dealt to `fan` smaller ranges, until a range is one part."""
    ranges = parts // span
    if span == 1:
        return frozen(sent.repartition(ranges, "part").groupBy("part").applyInArrow(totals_of_part, TOTALS), "totals")
    bundles, below = -(-senders // fan), max(1, span // fan)

    def bundle(table: pa.Table) -> pa.Table:
        _, kinds, _, sums, word = _joined(table)
        return _dealt(table.column("bundle")[0].as_py(), kinds, sums << 1 | word, parts, below)

    def unbundle(down: pa.Table, up: pa.Table) -> pa.Table:
        keys, _, at, _, _ = _joined(down)
        back = sorted(zip(up.column("part").to_pylist(), up.column("totals").to_pylist()))
        own = np.concatenate([unpacked(t) for _, t in back])[at]
        return _returned(down, keys, own, sum(up.column("seen").to_pylist()), sum(up.column("token_sum").to_pylist()))

    sent = frozen(sent.withColumn("bundle", F.col("part") * bundles + F.pmod(F.xxhash64("sender"), F.lit(bundles))), "sent")
    up = summed(sent.groupBy("bundle").applyInArrow(bundle, KEYS), parts, below, ranges * bundles, fan)
    return frozen(sent.groupBy("bundle").cogroup(up.groupBy("sender")).applyInArrow(unbundle, TOTALS), "totals")


def scorer(n: int, v: int, mu: float, least: int, order: int, bits: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        parts = sorted(zip(right.column("part").to_pylist(), right.column("totals").to_pylist()))
        found = np.concatenate([unpacked(t) for _, t in parts]) if parts else np.empty(0, np.int64)
        for x in left.to_pylist():
            ids, flags, block = _load(x, order)
            keys = exchange_keys(block.hashes, bits)
            totals = np.empty(len(keys), np.int64)
            totals[np.argsort(keys, kind="stable")] = found
            size, known, base, score = block.scores(totals, n, v, mu, least)
            cols = [pa.array(ids, mask=(flags & 2).astype(bool)), pa.array((flags & 1).astype(bool)), pa.array(size), pa.array(known), pa.array(np.full(len(ids), n, np.int64)), pa.array(base), pa.array(score)]
            out.append(pa.table(cols, schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def ranges(grams: int, part_grams: int = PART_GRAMS, fan: int = FAN) -> tuple[int, int]:
    """How many parts the n-grams are counted in, and of how many parts a range is that blocks deal to."""
    parts, span = 1 << max(0, math.ceil(math.log2(grams / part_grams))), 1
    while parts // span > fan:
        span *= fan
    return parts, span


def scores(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, order: int = ORDER, mu: float = MU, least: int = LEAST, block_tokens: int = BLOCK_TOKENS, part_grams: int = PART_GRAMS, fan: int = FAN, spare_bits: int = SPARE_BITS) -> DataFrame:
    """Rows of SCORES, one for each row of docs, under a model of the documents whose fold isn't `held_out`.

    A null text is empty: one token, its end. A null id falls into the fold of the empty id. Rows that repeat count as
    often as they stand. With no training document every count is 0. Words are known by 63 bits of their hash, whatever the
    size of the corpus, so that base_score has their own counts; longer n-grams by spare_bits more than number them, so that
    one in 2 ** spare_bits takes another's count in score. Extra columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc_fold(F.col("doc_id"), folds) == held_out).alias("held"))
    blocks = frozen(rows.mapInArrow(block_writer(block_tokens, order), BLOCKS), "blocks")
    senders, grams = blocks.agg(F.count(F.lit(1)), F.sum("grams")).first()
    if not grams:
        return docs.sparkSession.createDataFrame([], SCORES)
    parts, span = ranges(grams, part_grams, fan)
    bits = max(1, min(63, grams.bit_length() + spare_bits))
    sent = blocks.mapInArrow(key_writer(parts, span, bits, order), KEYS)
    totals = summed(sent, parts, span, senders, fan)
    v, n = totals.agg(F.sum("seen"), F.sum("token_sum")).first()
    return blocks.groupBy("block").cogroup(totals.select("sender", "part", "totals").groupBy("sender")).applyInArrow(scorer(n, v, mu, least, order, bits), SCORES)
