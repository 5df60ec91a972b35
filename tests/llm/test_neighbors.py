"""Nearest neighbours beside all distances."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from verifold.llm import neighbors

SCHEMA = "id long, vec array<double>"


def found(df, queries=None, **how):
    out = {}
    for r in sorted(neighbors.nearest(df, df.where("id % 100 = 0") if queries is None else queries, **how).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def brute(rows, most=10):
    """Every query's nearest, rows of one id being one item."""
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in sorted({i for i, _ in good if i % 100 == 0}):
        best = {}
        for qv in [v for i, v in good if i == q]:
            for i, v in good:
                if i != q and len(v) == len(qv):
                    best[i] = min(best.get(i, math.inf), math.dist(v, qv))
        if best:
            out[q] = [(k + 1, i, s) for k, (s, i) in enumerate(sorted((s, i) for i, s in best.items())[:most])]
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [x[:2] for x in got[q]] == [x[:2] for x in want[q]]
        assert [x[2] for x in got[q]] == pytest.approx([x[2] for x in want[q]], rel=1e-12)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=7).tolist()) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(1000, 1040)] + [(2000, rows[5][1])]  # copies, one of them a query
    rows += [(3000 + i, rng.normal(size=3).tolist()) for i in range(3)] + [(3, rng.normal(size=7).tolist()), (100, rng.normal(size=7).tolist())]
    rows += [(400, None), (401, []), (500, [0.0] * 7), (501, [1.0, None, 1.0]), (600, [math.nan] * 7), (601, [math.inf, 1.0]), (None, [1.0] * 7), (700, [1e200] * 7), rows[0], rows[0]]
    rows += [(7, [x + k for x in rows[0][1]]) for k in range(30)]  # one id with many vectors
    rows += [(800, [1.0])]  # alone with its length
    same(found(spark.createDataFrame(rows, SCHEMA)), brute(rows))
    # cells and blocks of queries are layout alone
    neighbors_asking, neighbors.ASKING = neighbors.ASKING, 1
    try:
        same(found(spark.createDataFrame(rows, SCHEMA), cell=16), brute(rows))
    finally:
        neighbors.ASKING = neighbors_asking


def test_fewer_than_ten_and_empty(spark):
    rows = [(100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, -1.0])]
    same(found(spark.createDataFrame(rows, SCHEMA)), brute(rows))
    assert found(spark.createDataFrame([], SCHEMA)) == {}
    assert found(spark.createDataFrame([(1, [1.0])], SCHEMA)) == {}


def test_recall_on_random_directions_and_among_copies(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(6000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[1::3] = v[1]  # a third of all rows are one vector
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SCHEMA)
    got, hits, total = found(df), 0, 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        near = np.lexsort((np.arange(6000), d))[:10]
        assert len(got[q]) == 10 and all(d[i] == pytest.approx(s, abs=1e-12) for _, i, s in got[q])
        hits, total = hits + len({int(i) for i in near} & {i for _, i, _ in got[q]}), total + 10
    assert hits / total >= 0.9


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="needs the driver's tables")
def test_recall_on_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    got, rows = found(df), [(r.id, [float(x) for x in r.vec]) for r in df.collect()]
    want = brute(rows)
    assert got.keys() == want.keys()
    assert sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want) >= 0.9 * sum(len(x) for x in want.values())


def test_clashing_columns(spark):
    rows = [(i * 50, [float(i), 1.0]) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_h", F.lit("x")).withColumn("ids", F.lit(1)).withColumn("cell", F.lit(2))
    same(found(df), brute(rows))
