"""Keyword search with bounds beside all pairs that share a word."""

import random

import pytest
from pyspark.sql import functions as F

from verifold.operators import keywords, retrieval


def brute(memories, queries, top, weight, least, digits=6):
    out = []
    for q, asked in queries:
        hits = []
        for i, words, impact in memories:
            both = len(set(asked or ()) & set(words or ()))
            if both and impact is not None:
                score = round(impact + weight * (both / len(asked)), digits)
                if score >= least:
                    hits.append((-score, i, round(both / len(asked), digits)))
        out += [(q, i, rel, pytest.approx(-s, abs=1e-9), k + 1, len(hits)) for k, (s, i, rel) in enumerate(sorted(hits)[:top])]
    return sorted(out, key=lambda r: (r[0], r[4]))


def got(spark, memories, queries, kind="long", **how):
    text = lambda rows: [(r[0], None if r[1] is None else " ".join(r[1]), *r[2:]) for r in rows]
    m = spark.createDataFrame(text(memories), f"id {kind}, text string, impact double")
    q = spark.createDataFrame(text(queries), "query_id long, text string")
    rows = keywords.best_by_words(m, q, retrieval.tokens, **how).select("query_id", "id", F.round("relevance", 6), "score", "rank", "total_found").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[4]))


def corpus(n, seed, name=lambda i: i):
    rnd = random.Random(seed)
    deal = lambda k: list({f"w{min(int(rnd.paretovariate(0.7)), 400)}" for _ in range(k)} | ({"all"} if rnd.random() < 0.9 else set()))
    memories = [(name(i), deal(rnd.randrange(0, 25)), rnd.choice([0.0, 0.3, 0.7, 1.1, 1.9])) for i in range(n)]
    return memories, [(q, deal(rnd.randrange(1, 12))) for q in range(30)]


@pytest.mark.parametrize(("least", "weight", "top"), [(0.0, 0.4, 10), (0.9, 0.4, 3)])
def test_equals_all_pairs_over_many_shards(spark, least, weight, top):
    memories, queries = corpus(300, int(10 * least))
    memories += [(2000, None, 1.0), (2001, ["w1"], None), (2002, [], 1.0)]
    queries += [(100, []), (101, None), (102, ["nowhere"])]
    assert got(spark, memories, queries, top=top, weight=weight, least=least, shard=64, asking=17) == brute(memories, queries, top, weight, least)


def test_text_ids_equal_scores_and_empty(spark):
    memories, queries = corpus(150, 9, lambda i: f"m-{i}")
    memories = [(i, w, 0.0) for i, w, _ in memories]
    assert got(spark, memories, queries, "string", top=5, weight=1.0, shard=64) == brute(memories, queries, 5, 1.0, 0.0)
    assert got(spark, [], queries, top=5) == [] and got(spark, corpus(9, 1)[0], [], top=5) == []


def test_shards_below_the_bound_are_not_scored():
    import numpy as np
    import pyarrow as pa

    shard = keywords.Shard(np.array([1.0] * 100), pa.array([["a", "b"] if i % 2 else ["a"] for i in range(100)]))
    assert shard.sharing(np.array([0])) == 100 and shard.sharing(np.array([1])) == 50 and len(shard.postings(np.array([0, 1]))) == 150
    scored = []
    shard_postings, keywords.Shard.postings = keywords.Shard.postings, lambda self, codes: scored.append(len(codes)) or shard_postings(self, codes)
    try:
        run = keywords._searched(0.4, 2, 0.0, 6)
        rows = pa.table({"shard": [1] * 100, "block": [0] * 100, "position": list(range(100)), "impact": [1.0] * 100, "id": list(range(100)), "words": [["a"]] * 100})
        ask = lambda safe: pa.table({"_s": [1], "_b": [0], "query_id": [7], "n": [2], "words": [["a", "b"]], "safe": [safe]})
        assert run(rows, ask(1.5)).column("found").to_pylist() == [100] and scored == [0]  # counted by bit sets alone
        assert run(rows, ask(1.1)).column("id").to_pylist() == [0, 1, None]
    finally:
        keywords.Shard.postings = shard_postings


def test_large_tables_make_few_shards(spark, monkeypatch):
    """Shards after the first grow with the table, so that queries aren't sent to ever more of them."""
    assert keywords.shard_size(3_000_000) == 65536 and keywords.shard_size(500_000) > 15_000 and keywords.shard_size(10) == 4096
    monkeypatch.setattr(keywords, "SHARDS", 3)
    memories, queries = corpus(1500, 4)
    assert got(spark, memories, queries, top=5, weight=0.4, least=0.3, shard=64, asking=8, wide=512) == brute(memories, queries, 5, 0.4, 0.3)


def shares(spark, memories, queries, kind="long", **how):
    text = lambda rows: [(r[0], None if r[1] is None else " ".join(r[1])) for r in rows]
    m, q = spark.createDataFrame(text(memories), f"id {kind}, text string"), spark.createDataFrame(text(queries), "query_id long, text string")
    rows = keywords.best_by_share(m, q, retrieval.tokens, **how).select("query_id", "id", F.round("relevance", 6), "rank").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[3]))


def by_share(memories, queries, top, digits=6):
    return [(q, i, rel, k) for q, i, rel, _, k, _ in brute([(i, w, 0.0) for i, w, _ in memories], queries, top, 1.0, 0.0, digits)]


@pytest.mark.parametrize(("top", "most"), [(3, 1 << 25), (20, 500)])
def test_shares_equal_all_pairs_over_many_shards(spark, top, most):
    memories, queries = corpus(400, top)
    memories += [(2000, None, 0.0), (2001, [], 0.0), (None, ["w1", "all"], 0.0), (7, ["w1", "all"], 0.0)]
    queries += [(100, []), (101, None), (102, ["nowhere"]), (103, ["all"]), *[(i, w) for i, w, _ in memories[::40] if w]]
    queries = [*{q: (q, w) for q, w in queries}.values()]
    got = shares(spark, memories, queries, top=top, shard=64, asking=17, wide=128, most=most)
    assert got == by_share([r for r in memories if r[0] is not None], queries, top)


def test_shares_of_text_ids_and_empty(spark):
    memories, queries = corpus(150, 9, lambda i: f"m-{i}")
    assert shares(spark, memories, queries, "string", top=5, shard=64) == by_share(memories, queries, 5)
    assert shares(spark, [], queries, top=5) == [] and shares(spark, corpus(9, 1)[0], [], top=5) == []


def test_frequent_words_are_not_read_for_those_who_cannot_have_enough():
    """Without impacts each pair that shares a word was scored: here 120 postings of 10,120 are enough to find who has 45 of 50 words."""
    import numpy as np
    import pyarrow as pa

    often = [f"often{k}" for k in range(10)]
    lists = keywords.Lists(pa.array([[*often, *([f"rare{k}" for k in range(40)] if i < 3 else [])] for i in range(1000)]))
    own, read, postings = np.arange(len(lists.words)), [], lists.postings
    lists.postings = lambda ranks: read.append(len(postings(ranks))) or postings(ranks)
    near, held = lists.sharing(own, 45)
    assert near.tolist() == [0, 1, 2] and held.tolist() == [50, 50, 50] and read == [120]
    near, held = lists.sharing(own, 1)
    assert len(near) == 1000 and sorted(set(held.tolist())) == [10, 50] and read[1] == 10_120
    assert lists.sharing(own, 51)[0].tolist() == []


def test_words_are_sent_as_one_text_and_few_postings_are_read(monkeypatch):
    """Lists of texts took most of the disk; whoever cannot have enough words isn't scored, however many queries are looked up at once."""
    import numpy as np
    import pyarrow as pa

    memories, queries = corpus(200, 3)
    memories = [(i, sorted(w), 1.0) for i, w, _ in memories if w]
    queries = [(q, sorted(w)) for q, w in queries if w]

    def found(joined, safe=0.0):
        words = lambda rows: pa.array([" ".join(r[1]) if joined else r[1] for r in rows])
        rows = pa.table({"shard": [1] * len(memories), "block": [0] * len(memories), "position": range(len(memories)), "impact": [1.0] * len(memories), "id": [r[0] for r in memories], "words": words(memories)})
        asked = pa.table({"_s": [1] * len(queries), "_b": [0] * len(queries), "query_id": [r[0] for r in queries], "n": [len(r[1]) for r in queries], "words": words(queries), "safe": [safe] * len(queries)})
        return sorted(keywords._searched(0.4, 5, 0.3, 6)(rows, asked).to_pylist(), key=str)

    whole = found(False)
    monkeypatch.setattr(keywords, "TOGETHER", 7)
    assert found(True) == whole
    counts = [r for r in whole if r["id"] is None]
    assert [r for r in found(True, 1.2) if r["id"] is None] == counts and [r for r in found(True, 1.2) if r["id"] is not None and r["score"] >= 1.2] == [r for r in whole if r["id"] is not None and r["score"] >= 1.2]
    often = [f"often{k}" for k in range(10)]
    shard = keywords.Shard(np.ones(1000), pa.array([[*often, *([f"rare{k}" for k in range(40)] if i < 3 else [])] for i in range(1000)]))
    read, postings = [], shard.lists.postings
    shard.lists.postings = lambda ranks: read.append(len(postings(ranks))) or postings(ranks)
    near, held = shard.having(np.arange(50), 45, 2)
    assert near.tolist() == [0, 1] and held.tolist() == [50, 50] and read == [120]
    assert shard.sharing(np.arange(50)) == 1000
