"""Table functions called from SQL, centroids that drift, fingerprints of sets, and the store's counts."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from verifold.functions import tables
from verifold.operators import conflict, history, state
from verifold.streaming import ingest

T0 = datetime(2024, 1, 1)
EDGES = "source_id string, target_id string, relation_type string, confidence double"


def test_graph_functions_by_sql_alone(spark):
    tables.register_graph(spark.createDataFrame([("a", "b", "x", 0.5), ("b", "c", "x", 0.5), ("a", "c", "y", 0.1), ("c", "a", "x", 1.0), ("c", "c", "x", 1.0)], EDGES), 2, "t_")
    rows = spark.sql("SELECT n.k, f.* FROM VALUES ('a'), ('c'), ('q') AS n(k), LATERAL t_neighbors_of(n.k) f").collect()
    assert {(r.k, r.neighbor, r.direction) for r in rows} == {("a", "b", "out"), ("a", "c", "out"), ("a", "c", "in"), ("c", "a", "out"), ("c", "c", "out"), ("c", "b", "in"), ("c", "a", "in")} and len(rows) == 7
    rows = spark.sql("SELECT n.k, f.* FROM VALUES ('a'), ('b'), ('q') AS n(k), LATERAL t_reached_from(n.k) f").collect()
    assert {(r.k, r.node): (r.hops, r.confidence) for r in rows} == {("a", "b"): (1, 0.5), ("a", "c"): (1, 0.25), ("b", "c"): (1, 0.5), ("b", "a"): (2, 0.5)}
    assert spark.sql("SELECT * FROM t_neighbors_of('b')").count() == 2


def test_state_at_any_time(spark):
    rnd = random.Random(2)
    rows = [(rnd.randrange(4), rnd.choice("vw"), T0 + timedelta(minutes=rnd.randrange(90)), i, rnd.choice(["ADD", "REMOVE", "UPDATE"]), float(rnd.randrange(9)), None) for i in range(150)]
    log = spark.createDataFrame(rows, "object_id long, key string, timestamp timestamp, id long, action string, num double, raw string")
    tables.register_states(state.intervals(state.timeline(log)), "t_")
    for minute in (0, 33, 89, 500):
        at = T0 + timedelta(minutes=minute)
        got = {(r.k, r.key): r.value for r in spark.sql(f"SELECT n.k, f.* FROM VALUES (0L), (1L), (2L), (3L), (9L) AS n(k), LATERAL t_state_at(n.k, timestamp '{at}') f").collect()}
        want = {(r.object_id, r.key): pytest.approx(r.num) for r in state.fold(log.where(F.col("timestamp") <= F.lit(str(at)).cast("timestamp"))).collect()}
        assert got == want
    plan = spark.sql("SELECT f.* FROM {n} n, LATERAL t_state_at(n.id, timestamp '2024-01-01') f", n=spark.range(9))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def unit(angle):
    return [math.cos(angle), math.sin(angle)]


def test_a_domain_that_drifts_is_flagged(spark):
    rnd = random.Random(4)
    still = [("still", w, unit(0.2 + rnd.gauss(0, 0.05))) for w in range(6) for _ in range(20)]
    turns = [("turns", w, unit((0.2 if w < 4 else 1.4) + rnd.gauss(0, 0.05))) for w in range(6) for _ in range(20)]
    odd = [("still", 1, None), ("still", 1, []), ("still", 1, [None, 1.0]), ("still", 1, [float("nan"), 1.0]), ("still", 2, [float("inf"), 1.0]), ("zero", 0, [0.0, 0.0]), ("zero", 1, [1.0, 0.0]), ("still", 3, [1.0, 0.0, 0.0])]
    rows = spark.createDataFrame(still + turns + odd, "domain string, window int, vec array<double>")
    got = {(r.domain, r.dims, r.window): r for r in conflict.centroid_drift(rows, 0.2).collect()}
    assert {k for k, r in got.items() if r.drifted} == {("turns", 2, 4), ("turns", 2, 5)}
    assert got["still", 2, 1].n == 20 and got["zero", 2, 1].distance is None and got["still", 2, 0].distance is None and got["still", 3, 3].n == 1
    # by hand: the mean of a window against that of all before it
    mean = lambda vs: [sum(v[i] for v in vs) / len(vs) for i in (0, 1)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
    now, past = mean([v for _, w, v in turns if w == 4]), mean([v for _, w, v in turns if w < 4])
    assert got["turns", 2, 4].distance == pytest.approx(1 - cos(now, past))
    kept = conflict.strays(rows.withColumn("before", F.lit("mine")), 0.3)
    assert kept.count() == len(still + turns + odd) and kept.where("quarantined").select("domain", "window").distinct().count() == 2
    assert conflict.centroid_drift(rows.limit(0)).isEmpty() and conflict.strays(rows.limit(0)).isEmpty()


def test_set_hashes_in_any_order_and_by_parts(spark, tmp_path):
    ids = [(i % 5, i) for i in range(400)] + [(1, None)]
    random.Random(1).shuffle(ids)
    rows = spark.createDataFrame(ids, "object_id long, id long")
    whole = {r.object_id: (r.n_events, r.low, r.high) for r in history.set_hash(rows).collect()}
    for k in range(4):
        spark.createDataFrame(ids[k::4], rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest.fingerprint_stream(source, str(tmp_path / "parts"), str(tmp_path / "cp"))
    q.awaitTermination()
    seen = lambda: {r.object_id: (r.n_events, r.low, r.high) for r in ingest.current_fingerprints(spark, str(tmp_path / "parts")).collect()}
    assert len(q.recentProgress) == 4 and seen() == whole and len({v[1:] for v in whole.values()}) == 5
    spark.createDataFrame([(3, 9999)], rows.schema).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.fingerprint_stream(source, str(tmp_path / "parts"), str(tmp_path / "cp")).awaitTermination()
    after = seen()
    assert {k for k in after if after[k] != whole[k]} == {3} and after[3][0] == whole[3][0] + 1


def test_states_deleted_and_counted(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "object_id long, namespace string")
    left = state.deleted(rows, spark.createDataFrame([(2,), (2,), (None,), (77,)], "object_id long"))
    assert {(r.namespace, r.n, r.is_total) for r in state.counted(left).collect()} == {("a", 1, False), ("b", 1, False), (None, 1, False), (None, 3, True)}
