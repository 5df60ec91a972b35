"""Runs of a log beside the windows of whole entities; facts as of a time; texts within texts; routes of late events."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from verifold.operators import conflict, scan, state
from verifold.streaming import ingest

T0 = datetime(2024, 1, 1)
ROWS = "object_id long, key string, timestamp timestamp, id long, action string, num double, raw string"


@pytest.fixture(scope="module")
def log(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(900):  # one entity and key has two thirds of all rows
        num = rnd.choice([None, 1.0, 2.0, 5.5, 7.0, 7.0, 7.0])
        who = (1, "v") if i % 3 else (rnd.randrange(4), rnd.choice("vw"))
        rows.append((*who, T0 + timedelta(minutes=rnd.randrange(400)), i, rnd.choice(["ADD", "ADD", "ADD", "REMOVE", "PLANT"] * 4 + ["UPDATE", "INFER"]), num, '"t"' if num is None else str(num)))
    return spark.createDataFrame(rows, ROWS)


@pytest.mark.parametrize("run", [1, 7, 10_000])
def test_fold_and_timeline_by_runs(log, run):
    close = lambda rows: {k: (pytest.approx(n) if n is not None else None, raw) for *k, n, raw in rows for k in [tuple(k)]}
    assert {(r.object_id, r.key): (r.num, r.raw) for r in scan.fold(log, run).collect()} == close(state.fold(log).collect())
    got = {r.id: r.state for r in scan.timeline(log, run).collect()}
    assert got == {r.id: pytest.approx(r.state) if r.state is not None else None for r in state.timeline(log).collect()}


def test_no_run_holds_a_hot_entity(log):
    placed = scan.in_runs(log, [F.col(c) for c in ("object_id", "key", "timestamp", "id")], 50)
    per = placed.groupBy("run").count().collect()
    assert max(r["count"] for r in per) == 50 and placed.where("object_id = 1 and key = 'v'").select("run").distinct().count() >= 12
    assert scan.fold(log.limit(0)).isEmpty() and scan.timeline(log.limit(0)).isEmpty()


@pytest.mark.parametrize("inclusive", [False, True])
def test_as_of(spark, inclusive):
    rnd = random.Random(3)
    at = lambda: None if rnd.random() < 0.03 else T0 + timedelta(hours=rnd.randrange(60))
    who = lambda: rnd.choice([None, 1, 1, 1, 1, 2, 3, 4])
    facts = [(who(), at(), i) for i in range(150)]
    probes = [(i, who(), at(), "x") for i in range(300)]
    probes += probes[:5]
    f = spark.createDataFrame(facts, "object_id long, timestamp timestamp, v long")
    p = spark.createDataFrame(probes, "id long, object_id long, timestamp timestamp, fact_ string")

    def want(o, t):
        fit = [(ft, v) for fo, ft, v in facts if fo is not None and ft is not None and o is not None and t is not None and fo == o and (ft < t or inclusive and ft == t)]
        return max(fit)[1] if fit else None

    for run in (4, 1000):
        got = sorted((r.id, r.fact.v if r.fact else None) for r in scan.as_of(p, f, inclusive=inclusive, run=run).collect())
        assert got == sorted((i, want(o, t)) for i, o, t, _ in probes)
    assert scan.as_of(p, f.limit(0)).where("fact is not null").isEmpty() and scan.as_of(p.limit(0), f).isEmpty()


def test_contained_equals_all_pairs(spark):
    rnd = random.Random(6)
    words = ["tea", "i like tea", "a", "", "ab", "abc", "abcd", "i like", "ö tea ü", "like  tea", "xyz", "i like tea and rain", "rain"]
    texts = [(rnd.choice("mno"), rnd.choice(words) + rnd.choice(["", " ", " x"])) for _ in range(120)] + [("m", None), (None, "tea")]
    inner, outer = texts[:60], texts[60:]
    side = lambda rows: spark.createDataFrame(rows, "g string, text string")
    want = {(g, i, o) for g, i in inner for h, o in outer if g is not None and g == h and i is not None and o is not None and i in o}
    for size in (2, 4):
        assert {tuple(r) for r in conflict.contained(side(inner), side(outer), "g", size).collect()} == want
    assert conflict.contained(side(inner).limit(0), side(outer), "g").isEmpty()


def test_textual_equals_the_pairwise_rule(spark):
    rnd = random.Random(2)
    said = ["I like tea", "I hate tea", "i don't like rain", "I like rain", "not ", "It is NOT so", "it is so, really", "hate", "like", "", None, "so"]
    rows = [(rnd.randrange(4), i, rnd.randrange(30), rnd.choice(said)) for i in range(150)]
    want = {}
    for ns, i, o, text in rows:
        low = (text or "").lower()
        if any(t in low for t in conflict.TRIGGERS):
            asks = [low.replace(a, b).strip(" ") for a, b in conflict.REWRITES if a in low]
            fit = [(o2, i2) for n2, i2, o2, t2 in rows if n2 == ns and o2 < o and t2 is not None and any(p in t2.lower() or t2.lower() in p for p in asks)]
            if fit:
                want[i] = min(fit)[1]
    df = spark.createDataFrame(rows, "namespace long, id long, ord long, text string")
    assert {r.id: r.other_id for r in conflict.textual(df).collect()} == want and want


def test_textual_in_crowded_namespaces_and_others(spark, tmp_path, monkeypatch):
    """Namespaces with few candidates make no rows of runs of characters, and nothing that a file's size hides is broadcast."""
    said = ["I like rain on day %d", "I hate rain on day %d", "don't go on day %d", "Go on day %d", "not now %d"]
    rows = [(ns, 1000 * ns + i, i if i % 9 else None, said[i % 5] % (i % 7)) for ns in range(3) for i in range(30 * (1 + ns))]
    spark.createDataFrame(rows, "namespace long, id long, ord long, text string").write.parquet(f"{tmp_path}/said")
    df = spark.read.parquet(f"{tmp_path}/said")
    split = {r.id: r.other_id for r in conflict.textual(df, direct=15).collect()}
    assert split == {r.id: r.other_id for r in conflict.textual(df, direct=0).collect()} and split
    monkeypatch.setattr(conflict, "contained", None)
    assert {r.id: r.other_id for r in conflict.textual(df).collect()} == split
    plan = conflict.textual(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan


def test_late_events_take_three_ways(spark, tmp_path):
    day = lambda d: T0 + timedelta(days=d)
    rows = [(1, day(500), day(500)), (2, day(500), day(530)), (3, day(500), day(530.5)), (4, day(500), day(865)), (5, day(500), day(866)), (6, day(900), day(865)), (7, None, day(865))]
    schema = "id long, timestamp timestamp, arrived timestamp"
    got = {r.id: r.route for r in ingest.routed(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "accept", 2: "accept", 3: "approve", 4: "approve", 5: "reject", 6: "accept", 7: "reject"}
    for part in (rows[:4], [*rows[4:], rows[4]], [rows[5]]):  # one is sent twice in a batch, one again in the next
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest.route_stream(source, str(tmp_path / "out"), str(tmp_path / "cp"), within="400 days").awaitTermination()
    for route in ingest.ROUTES:
        assert sorted(r.id for r in ingest.route_of(spark, str(tmp_path / "out"), route).collect()) == sorted(i for i, x in got.items() if x == route)


def test_crowded_namespaces_cut_no_other_texts_into_runs(spark, monkeypatch):
    """Only texts that begin and end as a candidate's parts do are looked for within candidates; all else is as in all pairs."""
    rows = [(i, f"i like rain on day {i}") for i in range(0, 40, 2)] + [(100 + i, f"my favorite colour is shade {i}") for i in range(30)] + [(200, "rain"), (201, "day 7"), (202, "i"), (203, "")]
    rows += [(300 + i, f"I hate rain on day {i}") for i in range(30)]
    df = spark.createDataFrame([(1, i, i, t) for i, t in rows], "namespace long, id long, ord long, text string")
    met, contained = [], conflict.contained
    monkeypatch.setattr(conflict, "contained", lambda inner, outer, *how: met.append({r.text for r in inner.collect()}) or contained(inner, outer, *how))
    got = {r.id: r.other_id for r in conflict.textual(df, direct=3).collect()}
    assert got == {r.id: r.other_id for r in conflict.textual(df, direct=1000).collect()} and len(got) == 30
    assert len(met) == 2 and not any(t.startswith("my favorite") for t in met[1]) and {"rain", "i", ""} <= met[1]
