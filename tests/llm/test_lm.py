import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from verifold.llm import lm


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w] + [None]


class Plain:
    """Counts in dictionaries; probabilities by the formula, order by order."""

    def __init__(self, texts, order, mu=lm.MU, least=lm.LEAST):
        self.order, self.mu, self.least, self.grams = order, mu, least, Counter()
        for t in texts:
            w = ["<s>", *tokens(t)]
            for n in range(1, order + 1):
                self.grams.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        words = {g: c for g, c in self.grams.items() if len(g) == 1 and g != ("<s>",)}
        self.n, self.v = sum(words.values()), len(words)

    def p1(self, w):
        return (self.grams[w,] + 1) / (self.n + self.v + 1)

    def p(self, w, h):
        if not h:
            return self.p1(w)
        lower = self.p(w, h[1:])
        if self.grams[h] < (self.least if len(h) > 1 else 1):
            return lower
        return (self.grams[(*h, w)] + self.mu * lower) / (self.grams[h] + self.mu)

    def row(self, t):
        ts, base, score, before = tokens(t), 0.0, 0.0, ["<s>"]
        for w in ts:
            base += math.log10(self.p1(w))
            score += math.log10(self.p(w, tuple(before[-(self.order - 1) :])))
            before.append(w)
        return len(ts), sum(self.grams[w,] > 0 for w in ts), self.n, base, score


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def corpus():
    rnd = random.Random(4)
    vocab = ["the", "The", "of", "ñu", "x1", "β", "end", "a.b"] + [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 2, 9, 30])))) for i in range(700)]
    return docs + [(100, None), (101, ""), (102, " \t\n"), (103, "  lead and trail \x0b"), (None, "no id at all"), (5, docs[5][1]), (104, "long words of it " * 5000)]


@pytest.mark.parametrize("how", [{"block_tokens": 500, "part_grams": 400, "fan": 4}, {"block_tokens": 300, "part_grams": 2000}, {}, {"order": 4, "least": 1, "block_tokens": 900, "part_grams": 900, "fan": 2}, {"order": 2}])
def test_matches_brute_force(spark, how):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").coalesce(1)
    got = sorted(([*r] for r in lm.scores(df, **how).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    model = Plain([t for i, t in docs if not held(i)], how.get("order", lm.ORDER), least=how.get("least", lm.LEAST))
    want = sorted(([i, held(i), *model.row(t)] for i, t in docs), key=lambda r: (r[0] is None, r[0] or 0))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_words_keep_their_counts_under_narrow_hashes(spark):
    """n-grams that share few bits take each other's counts, words never do."""
    docs = corpus()
    got = sorted(([*r] for r in lm.scores(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spare_bits=-9).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    model = Plain([t for i, t in docs if not held(i)], lm.ORDER, least=lm.LEAST)
    want = sorted(([i, held(i), *model.row(t)] for i, t in docs), key=lambda r: (r[0] is None, r[0] or 0))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)
    assert any(abs(a[6] - b[6]) > 0.1 for a, b in zip(got, want))


def test_probabilities_sum_to_one():
    """Over the vocabulary and one unknown word, in contexts that were seen and in some that weren't."""
    model = Plain([t for _, t in corpus()], 3)
    words = [g[0] for g in model.grams if len(g) == 1 and g != ("<s>",)] + ["never seen"]
    for h in [(), ("<s>",), ("the",), ("the", "of"), ("<s>", "w1"), ("never seen", "the"), ("never seen",)]:
        assert sum(model.p(w, h) for w in words) == pytest.approx(1)


def test_texts_that_occur_twice_score_higher(spark):
    rnd = random.Random(3)
    text = lambda: " ".join(f"w{rnd.randrange(400)}" for _ in range(60))
    ids = [i for i in range(600) if not held(i)]
    once, twice = [(i, text()) for i in ids[:300]], [(i, text()) for i in ids[300:340]]
    docs = once + twice + [(i + 10_000, t) for i, t in twice if not held(i + 10_000)]
    again = {i for i, _ in twice if not held(i + 10_000)}
    got = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in lm.scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert min(got[i] for i in again) > max(got[i] for i, _ in once)


def test_empty_table(spark):
    assert lm.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packing():
    x = np.sort(np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (lm.unpacked_keys(lm.packed_keys(x)) == x).all()
    assert (lm.unpacked(lm.packed(x.view(np.int64))).view(np.uint64) == x).all()


def test_exchange_is_one_level_at_size():
    """A GB of texts has some 570 million n-grams; a second level writes all of them again."""
    assert lm.ranges(290_000_000)[1] == lm.ranges(3_500_000_000)[1] == lm.ranges(17_000_000_000)[1] == 1
    assert lm.ranges(10**12)[1] > 1
