"""Hits and the events behind them, hybrid entities, transactions with vectors, the weekly run, ids of records."""

import hashlib
import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from verifold.functions import text
from verifold.operators import evidence, history, identity, maintain
from verifold.streaming import ingest

T0 = datetime(2024, 1, 1)
EVENTS = "id long, object_id long, timestamp timestamp, actor string"


def log(spark, n=500):
    rng = random.Random(7)
    # entity 1 holds a third of all events; some have no entity, and some come twice
    rows = [(i, rng.choice([1, None, *range(2, 5)]) if i % 3 else 1, T0 + timedelta(minutes=rng.randrange(200)), rng.choice(["USER", "AGENT", None])) for i in range(n)]
    return rows + rows[:5], spark.createDataFrame(rows + rows[:5], EVENTS)


def test_evidence_is_cut_into_parts_in_order(spark):
    rows, ev = log(spark)
    got = evidence.evidence(ev, 16).collect()
    assert all(len(r.ids) == r.n <= 16 and r.first_at <= r.last_at for r in got)
    assert any(r.part > 5 for r in got)
    for e in {r.object_id for r in got}:
        parts = sorted((r.part, r.ids) for r in got if r.object_id == e)
        assert [p for p, _ in parts] == list(range(len(parts)))
        assert [i for _, ids in parts for i in ids] == [i for i, o, *_ in sorted((x for x in rows if x[1] == e), key=lambda x: (x[2], x[0]))]
    assert {r.object_id for r in got} == {1, 2, 3, 4}
    assert evidence.evidence(ev.limit(0)).count() == 0


def test_hits_keep_what_all_facets_hold_of(spark):
    rows, ev = log(spark)
    hits = spark.createDataFrame([(9, e, s, 0) for e, s in [(1, 0.5), (2, 0.9), (3, 0.5), (77, 1.0), (None, 2.0)]], "query_id long, id long, score double, rank int")
    early = F.col("timestamp") < F.lit(T0 + timedelta(minutes=60))
    got = evidence.grounded(hits, ev, {"said": F.col("actor") == "USER", "early": early}, least=20).collect()
    own = {e: [x for x in rows if x[1] == e] for e in (1, 2, 3)}
    said = {e: sum(x[3] == "USER" for x in own[e]) for e in own}
    soon = {e: sum(x[2] < T0 + timedelta(minutes=60) for x in own[e]) for e in own}
    want = sorted((-s, e) for e, s in [(1, 0.5), (2, 0.9), (3, 0.5)] if said[e] >= 20 and soon[e] >= 20)
    assert [(r.id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(e, k + 1) for k, (_, e) in enumerate(want)] and want
    for r in got:
        order = [i for i, *_ in sorted(own[r.id], key=lambda x: (x[2], x[0]))]
        assert (r.n_events, r.n_said, r.n_early, r.first_id, r.last_id) == (len(order), said[r.id], soon[r.id], order[0], order[-1])
    # no facet: every hit with an event; an entity is cited once, however often it is hit
    assert {r.id for r in evidence.grounded(hits, ev, {}).collect()} == {1, 2, 3}
    assert evidence.cited(hits.unionByName(hits), ev, 16).agg(F.sum("n")).first()[0] == sum(map(len, own.values()))


def test_the_second_model_sees_only_what_the_first_is_unsure_of(spark):
    docs = spark.createDataFrame([(1, "Ann in Rome"), (2, "on Monday, Bob"), (3, "nothing"), (4, None)], "id long, text string")
    first = spark.createDataFrame([(1, "PERSON", "Ann"), (2, "DATE", "Monday")], "id long, label string, value string")
    seen = []

    def second(rows):
        seen.extend(r.id for r in rows.collect())
        return rows.where("id = 2").select("id", F.explode(F.array(F.lit("Monday"), F.lit("Bob"))).alias("value")).withColumn("label", F.lit("A"))

    assert {r.id: r.confidence for r in text.label_confidence(first).collect()} == {1: 1.0, 2: 0.5}
    got = {(r.id, r.label, r.value) for r in text.hybrid_entities(docs, lambda _: first, second).collect()}
    assert sorted(seen) == [2, 3, 4]
    assert got == {(1, "PERSON", "Ann"), (2, "DATE", "Monday"), (2, "A", "Bob")}


def test_both_sides_of_a_transfer_take_the_roots_vector(spark):
    roots = spark.createDataFrame(
        [(1, T0, 1, "UPDATE", None, 2, 5.0, 0.9), (2, T0 + timedelta(1), 1, "ADD", '{"inventory": 3}', None, None, 0.4), (3, T0 + timedelta(2), 2, "OBSERVE", None, None, None, 0.7), (4, T0, 8, "UPDATE", None, 2, 1.0, 0.1)],
        "id long, timestamp timestamp, object_id long, action string, delta string, transfer_to long, qty double, confidence double",
    )
    got = {r.object_id: (r.num, r.version, r.last_event_id, r.confidence) for r in history.transacted(roots, spark.createDataFrame([(1,), (2,)], "object_id long")).collect()}
    # a first REMOVE stores its value as it stands
    assert got == {1: (8.0, 2, 2, 0.4), 2: (6.0, 3, 3, 0.7)}


def test_the_weekly_run_merges(spark):
    rows = [("a", "person", "x", 1, [1.0, 0.0]), ("b", "person", "x", 2, [1.0, 0.01]), ("c", "person", "y", 3, [0.0, 1.0]), ("d", "thing", "x", 4, [1.0, 0.0]), ("e", "thing", "x", 5, [1.0, 0.0])]
    ents = spark.createDataFrame(rows, "id string, kind string, name string, created_at long, vec array<double>")
    states = spark.createDataFrame([], "id string, status string, updated_at timestamp, freshness double, authority double, last_accessed timestamp, access_count long")
    out = maintain.schedule(states, ents.withColumn("memory_type", F.lit("fact")), F.lit(T0), "all", ents)
    assert set(out) == {"daily", "weekly", "merged", "monthly"}
    assert {r.id: r.merged_into for r in out["merged"].collect()} == {"a": None, "b": "a", "c": None, "d": None, "e": None}
    assert set(maintain.schedule(states, ents, F.lit(T0), "monthly")) == {"monthly"}
    assert [tuple(r) for r in identity.merge_log(out["weekly"], F.lit(T0)).select("source_id", "target_id", "timestamp").collect()] == [("b", "a", T0)]


def test_records_without_an_entity_are_their_own(spark):
    rows = spark.createDataFrame([(1, '{"action":"ADD","object_id":"7","delta":{"n":1}}'), (2, "hello"), (3, "hello"), (None, None)], "id long, value string")
    got = {r.id: r.object_id for r in ingest.identified(ingest.checked(rows)).collect()}
    assert got == {1: "7", 2: hashlib.sha256(b"2\x1fhello").hexdigest(), 3: hashlib.sha256(b"3\x1fhello").hexdigest(), None: None}


def test_vectors_of_a_plug_in(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    got = identity.model_embeddings(rows, lambda texts: [[len(t), 1] for t in pd.Series(texts)])
    assert {r.id: r.vec for r in got.collect()} == {1: [2.0, 1.0], 2: [0.0, 1.0]}
