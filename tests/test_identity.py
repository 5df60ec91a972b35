"""Similar vectors beside all pairs: sizes, odd vectors, ids of any type, pruned blocks."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verifold.operators import identity, retrieval


def brute(rows, threshold):
    """(left, right) -> cosine over pairs of one kind and size."""
    sound = [(i, k, v) for i, k, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    unit = lambda v: np.array([x / (math.hypot(*v) or 1) for x in v])
    out = {}
    for i, k, v in sound:
        for j, m, w in sound:
            if k == m and len(v) == len(w) and (s := float(unit(v) @ unit(w))) >= threshold - 1e-12:
                out[i, j] = s
    return out


def frame(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"id {kind}, kind string, vec array<double>")


def pairs(df, threshold, **how):
    return {(r.left_id, r.right_id): r.similarity for r in identity.similar(df, df, threshold, **how).collect()}


ODD = [(1, "a", [1.0, 0.0, 0.0]), (2, "a", [1.0, 0.0]), (3, "a", [1.0, 0.0, 0.0]), (4, "a", [0.9, 0.1]), (5, "a", [1.0, None, 0.0]), (6, "a", []), (7, "a", None), (8, "a", [0.0, 0.0, 0.0]),
       (9, None, [1.0, 0.0]), (10, None, [1.0, 0.0]), (11, "b", [1.0, 0.0]), (12, "a", [math.nan, 1.0]), (13, "a", [math.inf, 1.0]), (14, "a", [1e200, 0.0, 0.0]), (None, "a", [1.0, 0.0])]


@pytest.mark.parametrize("threshold", [0.95, 0.0, -2.0])
def test_sizes_and_odd_vectors(spark, threshold):
    got = pairs(frame(spark, ODD), threshold)
    assert got.keys() == brute(ODD, threshold).keys()
    assert got[1, 3] == got[1, 1] == pytest.approx(1.0) and (1, 2) not in got and got[9, 10] == pytest.approx(1.0)
    assert sorted(r.id or 0 for r in identity.unsound(frame(spark, ODD)).collect()) == [0, 5, 6, 7, 12, 13]


def test_text_ids_through_merge(spark):
    rows = [("e-9", "a", [1.0, 0.0]), ("e-10", "a", [1.0, 0.001]), ("e-2", "a", [0.0, 1.0]), ("x", "a", [0.999, 0.0])]
    ents = frame(spark, rows, "string").withColumns({"name": F.col("id"), "created_at": F.length("id"), "merged_into": F.lit(None).cast("string"), "updated_at": F.lit(None).cast("timestamp")})
    found = identity.duplicate_pairs(ents)
    assert {(r.source_id, r.target_id) for r in found.collect()} == {("e-9", "x"), ("e-10", "e-9"), ("e-10", "x")}
    assert [(r.source_id, r.target_id) for r in identity.greedy(found).collect()] == [("e-9", "x"), ("e-10", "x")]
    merged = identity.merge(ents, found, F.current_timestamp())
    assert {r.id: r.canonical_id for r in identity.canonical(merged).collect()} == {"e-9": "x", "e-10": "x", "x": "x", "e-2": "e-2"}


def test_made_entities_are_proposed(spark):
    made = identity.create_entities(spark.createDataFrame([("Ann", "p", "{}"), ("Bob", "p", "{}")], "name string, entity_type string, attributes string"), F.current_timestamp(), 32)
    assert identity.duplicate_pairs(made.select("id", F.col("entity_type").alias("kind"), "name", "created_at", F.col("embedding").alias("vec")), -1.0).count() == 2


def test_ranks_are_not_rounded(spark):
    near = lambda c: [c, math.sqrt(1 - c * c)]
    rows = [(1, "a", [1.0, 0.0]), (2, "a", near(0.98000009)), (3, "a", near(0.98000041))]
    got = [(r.left_id, r.right_id) for r in identity.duplicate_pairs(frame(spark, rows).withColumns({"name": F.lit("n"), "created_at": F.col("id")}), 0.98, 2).where("left_id = 1").collect()]
    assert got == [(1, 3)]
    hits = retrieval.vector_hits(frame(spark, rows), frame(spark, rows[:1]), 3).collect()
    assert [r.id for r in sorted(hits, key=lambda r: r.rank)] == [1, 3, 2]


def test_ranks_by_as_many_digits_as_asked_for(spark):
    """Hits that are equal at these digits come by their ids, within a block and over blocks."""
    near = lambda c: [c, math.sqrt(1 - c * c)]
    rows = [(i, "a", near(0.98 + (i % 4) * 1e-7)) for i in range(2, 60)] + [(1, "a", [1.0, 0.0])]
    hits = retrieval.vector_hits(frame(spark, rows), frame(spark, rows[-1:]), 6, 5, 5).collect()
    assert [r.id for r in sorted(hits, key=lambda r: r.rank)] == [1, 2, 3, 4, 5, 6]
    got = identity.similar(frame(spark, rows[-1:]), frame(spark, rows), -2.0, 6, block=8, digits=5).collect()
    assert {r.right_id for r in got} >= {1, 2, 3, 4, 5, 6}


def test_blocks_grow_with_rows_and_products_are_bounded(monkeypatch):
    """What is sent falls with the size of a block; a task's best hits don't depend on the products that it holds at once."""
    assert identity.block_for(900_000, 32) > 50_000 and identity.block_for(900_000, 1536) < 3000 and identity.block_for(100, 3) == identity.BLOCK
    rnd = np.random.default_rng(8)
    side = lambda n: pa.table([pa.array(np.arange(n)), pa.array(rnd.normal(size=(n, 6)).round(1).tolist()), pa.array(["b"] * n), pa.array(["k"] * n)], ["id", "vec", "block", "other"])
    left, right = side(70), side(400)
    u, v = (identity._units(t.column("vec").combine_chunks()) for t in (left, right))
    s = u @ v.T
    for block, products in ((2048, 1 << 21), (32, 500)):
        monkeypatch.setattr(identity, "BLOCK", block)
        monkeypatch.setattr(identity, "PRODUCTS", products)
        got = identity._matched(-2.0, 7, 2)(left, right).to_pylist()
        for i in range(70):
            assert [r["right_id"] for r in got if r["left_id"] == i] == sorted(range(400), key=lambda j: (-identity._half_up(s[i, j], 2), j))[:7]
        got = identity._matched(0.8, None, 12, {6: v[:5]})(left, right).to_pylist()
        assert {(r["left_id"], r["right_id"]) for r in got} == set(zip(*(z.tolist() for z in np.nonzero(s >= 0.8))))


def test_pivots_prune_and_lose_nothing(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(40, 24))
    rows = [(i, "ab"[i % 7 == 0], (centres[i % 12] + 0.08 * rnd.normal(size=24)).tolist()) for i in range(500)]
    rows += [(2000 + i, "a", rows[1][2]) for i in range(80)]  # copies, more than a block holds
    rows += [(3000 + i, "a", rnd.normal(size=5).tolist()) for i in range(60)]
    df = frame(spark, rows)
    got, want = pairs(df, 0.95, block=64), brute(rows, 0.95)
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9
    row = identity.block_counts(df, df, 0.98, block=64).first()
    assert 0 < row.visited < row.pairs / 3, row


def test_two_sides_and_empty(spark):
    rnd = random.Random(4)
    rows = [(i, "a", [rnd.gauss(0, 1) for _ in range(3)]) for i in range(200)]
    left, right = frame(spark, rows[:20]), frame(spark, rows)
    got = {(r.left_id, r.right_id) for r in identity.similar(left, right, 0.9, block=16).collect()}
    assert got == {(i, j) for i, j in brute(rows, 0.9) if i < 20}
    best = identity.similar(left, right, 0.5, most=1, block=1000).collect()
    assert {(r.left_id, r.right_id) for r in best} == {(i, i) for i in range(20)}
    assert identity.similar(frame(spark, []), right, 0.9).isEmpty() and identity.similar(left, frame(spark, []), 0.9).isEmpty()


def test_repeated_entities_are_met_once_and_take_ranks(spark, monkeypatch):
    """Each row of an entity takes ranks, but a proposal comes once; numbers stand for long ids while vectors meet."""
    near = lambda c: [c, math.sqrt(1 - c * c)]
    rows = [("a", "k", [1.0, 0.0])] * 2 + [("b", "k", near(0.99)), ("c", "k", near(0.98))] + [("d", "k", near(0.97))] * 3
    met, similar = [], identity.similar
    monkeypatch.setattr(identity, "similar", lambda left, right, *how: met.append((left.schema["id"].dataType.simpleString(), left.count())) or similar(left, right, *how))
    got = sorted((r.left_id, r.right_id) for r in identity.duplicate_pairs(frame(spark, rows, "string").withColumns({"name": F.lit("n"), "created_at": F.lit(1)}), 0.9, 5).collect())
    # four rows of five are a's own, all of d's
    assert got == [("a", "b"), ("b", "c"), ("b", "d"), ("c", "b"), ("c", "d")]
    assert met == [("bigint", 4)]


def test_singles_stay_singles(spark):
    """Vectors of singles are sent as singles, and give the cosines of their doubles."""
    rnd = np.random.default_rng(5)
    rows = [(i, "a", rnd.normal(size=7).astype(np.float32).tolist()) for i in range(80)]
    df = frame(spark, rows)
    singles = df.withColumn("vec", F.col("vec").cast("array<float>"))
    assert identity._laid_out(singles, singles, 0.5, None, 8)[0].schema["vec"].dataType.simpleString() == "array<float>"
    assert pairs(singles, 0.5) == pairs(df, 0.5) and pairs(singles, -2.0, most=3) == pairs(df, -2.0, most=3)


@pytest.mark.parametrize("repeated", [1, 2])
def test_few_products_are_counted_anew(monkeypatch, repeated):
    """Bounds rise while the other side is met, where the first 2,048 of it were the bound for all: some 49 products a row here."""
    rnd = np.random.default_rng(6)
    side = lambda n: pa.table([pa.array(np.arange(n)), pa.array(np.tile(rnd.uniform(-1, 1, (n, 8)), repeated).tolist()), pa.array(["b"] * n), pa.array(["k"] * n)], ["id", "vec", "block", "other"])
    left, right = side(150), side(20_001)
    u, v = (identity._units(t.column("vec").combine_chunks()) for t in (left, right))
    widths, anew, dots, above = [], [], identity._dots, identity._above
    monkeypatch.setattr(identity, "_dots", lambda a, b, i, j: anew.append(len(i)) or dots(a, b, i, j))
    monkeypatch.setattr(identity, "_above", lambda x, *how: widths.append(x.shape[1]) or above(x, *how))
    got = identity._matched(-2.0, 5)(left, right).to_pylist()
    best = np.argsort(-(u @ v.T), axis=1, kind="stable")[:, :5]
    assert [[r["right_id"] for r in got if r["left_id"] == i] for i in range(150)] == best.tolist()
    assert sum(anew) <= 6 * 150 and widths == [8]
    assert identity._true(np.arange(21) % 5 == 0).tolist() == [0, 5, 10, 15, 20]
