"""Resampling beside a loop over words, and SQL."""

import hashlib
import math
import re
import zlib
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verifold.llm import importance, oracles

SCHEMA = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, runs=1, buckets=10_000, least=20, share=10):
    def features(text):
        words = WORD.findall((text or "").translate(LOWER))
        return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, runs + 1) for i in range(len(words) - n + 1)]

    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for b in features(t)[1]:
                out[b] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((a + 1) * (sum(s) + buckets) / ((b + 1) * (sum(t) + buckets)))) for a, b in zip(t, s)]
    rows = []
    for i, text in docs:
        words, own = features(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append((i, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = [(*r, k + 1 if k < share * len(fit) // 100 else None) for k, r in enumerate(fit)]
    return sorted([*ranks, *((*r, None) for r in rows if r[1] < least)], key=str)


def texts(n):
    some = ["alpha Beta_9 gamma-delta", "été ÉTÉ über 12 Straße", "x" * 40, "the of and", "\x00nul\x7f\U0001f600 end"]
    return [(i, " ".join(some[(i * k) % 5] for k in range(1, 4 + i % 9))) for i in range(n)]


def got(df, target, **how):
    return sorted((tuple(r) for r in importance.resampled(df, target, **how).collect()), key=str)


@pytest.mark.parametrize("runs", [1, 2, 3])
def test_equals_a_loop(spark, runs):
    docs = [*texts(300), (None, " ".join(["word"] * 30)), (900, None), (901, ""), (902, "..."), (903, "tail " * 20_000), *texts(2)]
    target = [x for _, x in texts(9)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    assert got(df, spark.createDataFrame([(i, x) for i, x in enumerate(target)], SCHEMA), runs=runs) == plain(docs, target, runs)


def test_many_ranges_and_equal_scores(spark):
    docs = [(i, "same words again " * 7) for i in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.createDataFrame(docs, SCHEMA)
        assert got(df, df.limit(3), share=50) == plain(docs, [docs[0][1]] * 3, share=50)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(texts(30), SCHEMA)
    assert got(none, some) == [] and got(none, none) == []
    assert got(some, none) == plain(texts(30), [])


def test_drawn_rows_keep_all_columns(spark):
    docs = texts(200)
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 AS rank", "'w' AS weight", "2 AS _own_", "3 AS _OWN_x")
    rows = importance.drawn(df, df.limit(5)).collect()
    assert sorted(rows[0].asDict()) == sorted(df.columns)
    want = {r[0] for r in plain(docs, [x for _, x in docs[:5]]) if r[5]}
    assert {r.doc_id for r in rows} == want and len(rows) == len(want)




def test_long_texts_are_cut_between_texts_only(monkeypatch):
    monkeypatch.setattr(importance, "SLICE_BYTES", 10)
    parts = [p.to_pylist() for p in importance._slices(pa.array(["aaaa", None, "b" * 50, "", "cc"]))]
    assert sum(parts, []) == ["aaaa", None, "b" * 50, "", "cc"] and len(parts) > 1


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the driver's tables")
def test_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    found = importance.resampled(read("documents"), read("benchmark")).select("doc_id", "n_features", "weight", "score", F.col("rank"))
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(con.execute(oracles.OP13_SQL).fetchall(), key=str)
