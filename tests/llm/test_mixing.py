import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from verifold.llm import mixing


def plain_targets(sizes):
    """Share by weight, cap, share the excess again, with exact fractions."""
    from fractions import Fraction as Q

    weights = [1 + i % 3 for i in range(len(sizes))]
    out, open_, left = [Q(0)] * len(sizes), list(range(len(sizes))), Q(sum(sizes))
    while True:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > 3 * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            return [float(x) for x in out]
        for i in over:
            out[i] = Q(3 * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in over]


def test_targets():
    rnd = random.Random(2)
    for _ in range(50):
        sizes = [rnd.choice([0, 1, 10, 1000, 50000]) for _ in range(rnd.randrange(1, 12))]
        got = mixing.targets(sizes, [1 + i % 3 for i in range(len(sizes))])
        assert got == pytest.approx(plain_targets(sizes))
        assert sum(got) == pytest.approx(sum(sizes))


def test_permutation_is_one():
    for size in (1, 2, 3, 17, 256, 1000):
        for turn in range(3):
            n = np.arange(size) + turn * size
            got = mixing.permuted(n, np.full(size, size), np.full(size, 4))
            assert sorted(got.tolist()) == list(range(size))
    a, b = (mixing.permuted(np.arange(1000) + t * 1000, np.full(1000, 1000), np.full(1000, 4)).tolist() for t in (0, 1))
    assert a != b and a != sorted(a)


def test_shard_counts_meet_quotas():
    quotas = [0, 5, 1000, 20_000]
    rows = list(mixing.shard_counts(quotas, 0, 42, 512))
    counts = [c.tolist() for _, c, _ in rows]
    assert [r[0] for r in rows] == list(range(42)) and [sum(c) for c in zip(*counts)] == quotas
    assert {sum(c) for c in counts[:-1]} == {512}
    assert len({c[2] for c in counts}) > 3  # drawn, not split evenly
    before = np.zeros(4, np.int64)
    for _, c, b in rows:
        assert b.tolist() == before.tolist()
        before += c
    # any task draws the same shards from its own part of the tree
    for first, last in ((0, 1), (5, 9), (41, 42), (7, 7)):
        assert [(k, c.tolist(), b.tolist()) for k, c, b in mixing.shard_counts(quotas, first, last, 512)] == [(k, c.tolist(), b.tolist()) for k, c, b in rows[first:last]]
    assert list(mixing.shard_counts([0, 0], 0, 10, 512)) == list(mixing.shard_counts([], 0, 10, 512)) == []


def test_slots_are_the_shards_draws(spark):
    plan = [{"source_no": k, "quota": q, "blocks": b} for k, (q, b) in enumerate([(0, 0), (700, 300), (90, 90), (2600, 1000)])]
    got = sorted(map(tuple, mixing.slots(spark, plan, 64, 3, task_shards=4).collect()))
    assert [(r[0], r[1]) for r in got] == [(k // 64, k % 64) for k in range(3390)]
    assert got == sorted(map(tuple, mixing.slots(spark, plan, 64, 3, task_shards=50).collect()))
    for p in plan[1:]:  # a full pass takes every block once
        uses = Counter(r[3] for r in got if r[2] == p["source_no"])
        assert sum(uses.values()) == p["quota"] and set(uses.values()) <= {p["quota"] // p["blocks"], -(-p["quota"] // p["blocks"])} and len(uses) == min(p["blocks"], p["quota"])


def test_matches_brute_force_and_reruns(spark, monkeypatch):
    rnd = random.Random(9)
    docs = []
    for i in range(400):
        src = rnd.choice(["a", "a", "a", "b", "é", "Z", None, "tiny"]) if i > 3 else "tiny"
        n = rnd.choice([0, 1, 30, 300]) if src != "tiny" else 3
        docs.append((i, src, " ".join(f"w{j}" for j in range(n)), "x"))
    docs += [(7, "a", "twice told", "x"), (7, "a", "twice told", "x"), (900, "a", None, "x"), (901, "b", "\t \n", "x"), (None, "b", "no id", "x"), (902, "b", "long " * 30000, "x")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, size string")
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    laid, placed = mixing.mix(df.repartition(4), block=16, shard_slots=64)
    got = mixing.taken(laid, placed).collect()
    again = mixing.taken(*mixing.mix(df.repartition(7), block=16, shard_slots=64)).collect()
    row = lambda r: (r.doc_id is None, r.doc_id or 0, r.source or "", r["size"], r.taken)
    assert sorted(map(row, got)) == sorted(map(row, again))
    size = Counter()
    for _, s, t, _ in docs:
        size[s] += len((t or "").split())
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(names, plain_targets([size[s] for s in names])))
    assert len(got) == len(docs)
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= max(16, 0.02 * want[s])
    # blocks and documents, laid end to end by hand
    starts = defaultdict(list)
    for r in laid.where("size > 0").collect():
        starts[r.source_no].append((r.start, r["size"]))
    for own in starts.values():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
    slots = placed.select("shard", "slot", "source_no", "block_no").distinct().collect()
    pieces = Counter()
    for x in slots:
        for start, n in starts[x.source_no]:
            both = min((x.block_no + 1) * 16, start + n) - max(x.block_no * 16, start)
            if both > 0:
                pieces[x.source_no, start] += both
    mine = {(r.source_no, r.start): r.taken for r in got if r["size"]}
    assert mine == {k: pieces.get(k, 0) for k in mine}


def test_equal_rows_are_split(spark, monkeypatch):
    docs = [(7, "a", "told again and again")] * 700 + [(8, "a", None)] * 90 + [(i, "b" if i % 2 else "a", "x " * i) for i in range(30)]
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    monkeypatch.setattr(mixing, "COPIES", 16)
    laid, placed = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(4), block=8, shard_slots=64)
    got = mixing.taken(laid, placed).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len((t or "").split())) for i, _, t in docs)
    ends = defaultdict(int)
    for r in sorted((r for r in got if r["size"]), key=lambda r: (r.source_no, r.start)):
        assert r.start == ends[r.source_no]
        ends[r.source_no] += r["size"]
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    for s in ("a", "b"):
        own = [r for r in got if r.source == s]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, abs=8)
    # the copies of one row are cut into parts of 16, each a group of its own
    many = spark.createDataFrame([(1, 3, 100, 10), (2, 5, 1, 0)], "source_no long, size long, _copies long, start long")
    assert sorted(tuple(r) for r in mixing.copied(many).collect()) == sorted([(1, 3, 10 + 3 * k) for k in range(100)] + [(2, 5, 0)])


def test_text_of_pieces_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a", "one two three four five"), (2, "b", "six seven")], "doc_id long, source string, text string")
    laid, placed = mixing.mix(df, block=2)
    out = mixing.materialise(df, placed).collect()
    texts = {1: "one two three four five".split(), 2: "six seven".split()}
    assert out and all(r.text.split() == texts[r.doc_id][r.first_word : r.first_word + r.n_words] for r in out)
    laid, placed = mixing.mix(df.limit(0))
    assert mixing.taken(laid, placed).count() == 0
