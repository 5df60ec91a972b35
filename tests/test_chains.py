"""Chains beside a search over all simple ways, cycles, and events that follow one another."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from verifold.operators import chains

EDGES = "source_id string, target_id string, relation_type string, confidence double"
T0 = datetime(2024, 1, 1)


def every_way(edges, hops, least):
    """The best (confidence, path) of each two ends, by depth-first search."""
    best = {}
    step = {}
    for a, b, c in edges:
        if a != b:
            step.setdefault(a, {})[b] = max(c, step.get(a, {}).get(b, 0))

    def walk(path, c):
        if len(path) > 1:
            key, mine = (path[0], path[-1]), (-round(c, 12), len(path), path)
            best[key] = min(best.get(key, mine), mine)
        if len(path) <= hops:
            for b, e in step.get(path[-1], {}).items():
                if b not in path and c * e >= least:
                    walk([*path, b], c * e)

    for a in step:
        walk([a], 1.0)
    return {k: (v[2], pytest.approx(-v[0])) for k, v in best.items()}


@pytest.mark.parametrize(("hops", "least"), [(1, 0.0), (3, 0.0), (4, 0.3)])
def test_chains_equal_a_search_over_all_ways(spark, hops, least):
    rnd = random.Random(hops)
    edges = [(rnd.choice("abcdefgh"), rnd.choice("abcdefgh"), rnd.choice([0.5, 0.9, 0.9, 1.0])) for _ in range(22)]
    df = spark.createDataFrame([(a, b, "caused", c) for a, b, c in edges] + [("a", "z", "other", 1.0), ("a", None, "caused", 1.0), (None, "a", "caused", 1.0), ("a", "y", "caused", None)], EDGES)
    rows = chains.chains(df, "caused", hops, least).collect()
    assert {(r.source_id, r.target_id): (r.path, r.confidence) for r in rows} == every_way(edges, hops, least)
    assert all(r.hops == len(r.path) - 1 and r.is_inferred == (r.hops > 1) and r.relation_type == ("may_have_caused" if r.is_inferred else "caused") for r in rows)


def test_two_causes_multiply_and_nothing_causes_itself(spark):
    df = spark.createDataFrame([("a", "b", "caused", 0.9), ("b", "c", "caused", 0.8), ("c", "a", "caused", 1.0), ("c", "c", "caused", 1.0)], EDGES)
    got = {(r.source_id, r.target_id): r.confidence for r in chains.chains(df).collect()}
    assert got["a", "c"] == pytest.approx(0.72) and not any(a == b for a, b in got) and len(got) == 6
    assert chains.chains(df.limit(0)).isEmpty() and chains.order_conflicts(df.limit(0)).isEmpty()


def test_nodes_before_themselves(spark):
    df = spark.createDataFrame([(a, b, "happened_before", 1.0) for a, b in ("ab", "bc", "ca", "cd", "de", "ed")], EDGES)
    assert {r.node: "".join(r.path) for r in chains.order_conflicts(df).collect()} == {"a": "abca", "b": "bcab", "c": "cabc", "d": "ded", "e": "ede"}


def test_no_limit_of_rows_in_a_recursion(spark):
    was = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    try:
        line = spark.range(60).select(F.col("id").cast("string").alias("source_id"), (F.col("id") + 1).cast("string").alias("target_id"), F.lit("caused").alias("relation_type"), F.lit(1.0).alias("confidence"))
        assert chains.chains(line, max_hops=3).count() == 60 + 59 + 58
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", was)


def test_what_follows_within_a_time(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randrange(3), T0 + timedelta(seconds=rnd.randrange(600)), 0.5) for i in range(120)] + [(500, 0, None, 0.5), (501, None, T0, 0.5)]
    df = spark.createDataFrame(rows, "id long, object_id long, timestamp timestamp, confidence double")
    got = {(r.source_id, r.target_id) for r in chains.follows(df, 60, ["object_id"]).collect()}
    real = [x for x in rows if x[2] is not None and x[1] is not None]
    assert got == {(a[0], b[0]) for a in real for b in real if a[1] == b[1] and (a[2], a[0]) < (b[2], b[0]) and b[2] - a[2] <= timedelta(seconds=60)}
