"""Cases with known answers, and a plain-Python fold beside the closed form."""

import json
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from verifold.functions import text, truth
from verifold.operators import conflict, graph, history, identity, maintain, memory, retrieval, state

T0 = datetime(2024, 1, 1)


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_x")).select(column.alias("v")).first().v


def test_score_and_decay(spark):
    v = dict(confidence=1.0, authority=1.0, freshness=1.0, corroboration=0.0)
    assert one(spark, truth.score(), **v) == pytest.approx(3.0)
    assert one(spark, truth.score(), **(v | {"corroboration": 5.0})) == pytest.approx(3.0 + 0.6 * math.log(6))
    for kind, days, want in [("event", 10, 0.36788), ("fact", 100, 0.90484), ("identity", 365, 1.0), ("prediction", 500, 0.01), (None, 10, 0.81873)]:
        got = spark.range(1).select(truth.freshness(F.lit(1.0), F.lit(float(days)), F.lit(kind).cast("string")).alias("v")).first().v
        assert got == pytest.approx(want, abs=1e-4)


def test_sql_functions(spark):
    truth.register_sql(spark)
    row = spark.sql("SELECT truth_score(1D, 1D, 1D, 0D) AS s, decayed(1D, 10D, 'event') AS d, decayed(0.2D, 900D, 'identity') AS i").first()
    assert (row.s, row.d, row.i) == (pytest.approx(3.0), pytest.approx(math.exp(-1)), 1.0)


def test_merged_vectors(spark):
    rows = [(1, T0 + timedelta(days=i), i, c, a, f, r) for i, (c, a, f, r) in enumerate([(0.8, 0.9, 0.5, 0.0), (0.4, 0.2, 0.9, 1.0), (0.0, 0.1, 0.1, 0.0)])]
    got = truth.merged(spark.createDataFrame(rows, "object_id long, timestamp timestamp, id long, confidence double, authority double, freshness double, corroboration double")).first()
    first = (0.64 + 0.16) / 1.2
    assert (got.authority, got.freshness, got.corroboration) == (0.9, 0.9, 3.0)
    assert got.confidence == pytest.approx(first)


def plain_fold(events):
    """Event by event, as a loop over dictionaries."""
    out = {}
    for e in sorted(events, key=lambda e: (e[1], e[2])):
        own = out.setdefault(e[0], {})
        for k, v in json.loads(e[4]).items():
            number = isinstance(v, (int, float))
            if number and isinstance(own.get(k), (int, float)) and e[3] in ("ADD", "PLANT", "REMOVE"):
                own[k] = own[k] + (-v if e[3] == "REMOVE" else v)
            else:
                own[k] = v
    return out


def folded(spark, events):
    rows = spark.createDataFrame(events, "object_id long, timestamp timestamp, id long, action string, delta string")
    long = state.long_form(rows).select("object_id", "key", "timestamp", "id", "action", "num", "raw")
    return {(r.object_id, r.key): (r.num, r.raw) for r in state.fold(long).collect()}


def test_fold_matches_a_loop(spark):
    rnd = random.Random(8)
    values = [1, 2.5, -3, True, False, None, "text", [1, 2], {"a": 1}, 1000000]
    events = []
    for i in range(3000):
        delta = {k: rnd.choice(values if rnd.random() < 0.3 else [1, 2.5, 7]) for k in rnd.sample("abcd", rnd.randrange(1, 4))}
        events.append((rnd.randrange(30), T0 + timedelta(seconds=rnd.randrange(500)), i, rnd.choice(["PLANT", "ADD", "REMOVE", "UPDATE", "OBSERVE", "INFER"]), json.dumps(delta)))
    got, want = folded(spark, events), plain_fold(events)
    assert got.keys() == {(o, k) for o, own in want.items() for k in own}
    for (o, k), (num, raw) in got.items():
        v = want[o][k]
        if isinstance(v, (int, float)):
            assert num == pytest.approx(float(v), abs=1e-6)
        else:
            assert num is None and (raw is None and v is None or json.loads(raw or "null") == v)


def test_known_folds(spark):
    at = lambda i: T0 + timedelta(minutes=i)
    trees = [(1, at(i), i, a, json.dumps({"tree_count": n})) for i, (a, n) in enumerate([("UPDATE", 0), ("PLANT", 5000), ("ADD", 10), ("REMOVE", 20)])]
    more = [(2, at(0), 10, "REMOVE", '{"n": 4}'), (3, at(1), 11, "UPDATE", '{"status": "done", "n": 99}'), (3, at(0), 12, "UPDATE", '{"status": "new", "n": 1}'), (4, at(5), 13, "OBSERVE", '{"mood": "awake"}'), (4, at(2), 14, "OBSERVE", '{"mood": "asleep"}'), (5, at(0), 15, "ADD", None), (6, at(0), 16, "ADD", "[1]")]
    got = folded(spark, trees + more)
    assert got[1, "tree_count"][0] == 4990
    assert got[2, "n"][0] == 4  # a first REMOVE stores its value
    assert got[3, "n"][0] == 99 and got[3, "status"][1] == '"done"'
    assert got[4, "mood"][1] == '"awake"'
    assert not {5, 6} & {o for o, _ in got}


def test_repair_and_tail(spark):
    at = lambda i: T0 + timedelta(minutes=i)
    schema = "object_id long, key string, timestamp timestamp, id long, action string, num double, raw string"
    rows = lambda *x: spark.createDataFrame([(o, "n", at(m), i, a, float(v), str(v)) for o, m, i, a, v in x], schema)
    log, late = rows((1, 0, 1, "PLANT", 10), (1, 9, 2, "UPDATE", 50), (2, 0, 3, "ADD", 7)), rows((1, 5, 4, "ADD", 20))
    got = {r.object_id: (r.num, r.status) for r in state.repair(log, late, state.fold(log)).collect()}
    assert got == {1: (50.0, "repaired"), 2: (7.0, "kept")}
    seed = spark.createDataFrame([(1, "n", at(4), 30.0, None)], "object_id long, key string, timestamp timestamp, num double, raw string")
    assert state.tail_replay(seed, rows((1, 5, 9, "ADD", 5))).first().num == 35.0
    bad = state.compare(*(spark.createDataFrame([(1, "n", x, None)], "object_id long, key string, num double, raw string") for x in (20.0, 10.0)))
    assert [(r.expected, r.actual) for r in bad.collect()] == [(20.0, 10.0)]


def test_transfer_and_causes(spark):
    roots = spark.createDataFrame([(1, T0, 1, 2, 200.0), (2, T0, 1, 99, 5.0)], "id long, timestamp timestamp, object_id long, transfer_to long, qty double")
    known = spark.createDataFrame([(1,), (2,)], "object_id long")
    opening = spark.createDataFrame([(1, "inventory", T0 - timedelta(days=1), 0, "PLANT", 1000.0, "1000"), (2, "inventory", T0 - timedelta(days=1), 0, "PLANT", 0.0, "0")], "object_id long, key string, timestamp timestamp, id long, action string, num double, raw string")
    got = {r.object_id: r.num for r in state.fold(opening.unionByName(history.transfers(roots, known))).collect()}
    assert got == {1: 795.0, 2: 200.0}
    ev = spark.createDataFrame([("c", ["b"]), ("b", ["a"]), ("d", ["b", "a"])], "id string, antecedents array<string>")
    assert {(r.id, r.cause): r.depth for r in history.causes(ev).collect()} == {("c", "b"): 1, ("c", "a"): 2, ("b", "a"): 1, ("d", "b"): 1, ("d", "a"): 1}


def test_causes_have_no_depth_limit(spark):
    ev = spark.createDataFrame([(i, [i - 1] if i else []) for i in range(41)] + [(100, [40, 3]), (200, [201]), (201, [200])], "id long, antecedents array<long>")
    got = {(r.id, r.cause): r.depth for r in history.causes(ev).collect()}
    want = {(i, j): i - j for i in range(41) for j in range(i)} | {(100, j): 41 - j if j > 3 else 4 - j for j in range(41)}
    assert got == want | {(200, 201): 1, (201, 200): 1, (200, 200): 2, (201, 201): 2}


def test_consolidation(spark):
    acts = ["ADD", "ADD", "ADD", "REMOVE"]
    rows = [(1, T0 + timedelta(hours=i), i, "USER", a, "trees", json.dumps({"trees": 10 + i, "by": f"team {i}", "ok": [i]}), None, 0.9, 1.0, 1.0, 0.0) for i, a in enumerate(acts)]
    ev = spark.createDataFrame(rows, "object_id long, timestamp timestamp, id long, actor string, action string, keys string, delta string, consolidated_into string, confidence double, authority double, freshness double, corroboration double")
    at = F.lit(str(T0 + timedelta(days=1))).cast("timestamp")
    marked = maintain.islands(ev, at)
    assert [(r.n, r.action) for r in maintain.runs(marked).collect()] == [(3, "ADD")]
    s = maintain.summaries(marked).first()
    assert (json.loads(s.delta), s.n, s.actor, s.antecedents) == ({"trees": 33.0, "by": "team 2", "ok": [2]}, 3, "SYSTEM", ["0", "1", "2"])
    log = {r.id: r for r in maintain.consolidate(ev, marked).collect()}
    assert (log["summary-0"].action, log["summary-0"].timestamp, log["summary-0"].confidence, json.loads(log["summary-0"].delta)["trees"]) == ("ADD", T0 + timedelta(hours=2), 0.9, 33.0)
    assert maintain.consolidated_count(marked).first().consolidated == 3
    done = {k: r.consolidated_into for k, r in log.items()}
    assert done == {"0": "summary-0", "1": "summary-0", "2": "summary-0", "3": None, "summary-0": None}
    assert maintain.reduction(maintain.runs(marked)).first().saved == 2


def test_pruning(spark):
    at = F.lit(str(T0)).cast("timestamp")
    rows = [(1, T0, 100, 1.0, "active"), (2, T0 - timedelta(days=91), 0, 0.0, "active"), (3, None, None, None, "active"), (4, T0 - timedelta(days=900), 0, 0.0, "inactive")]
    st = spark.createDataFrame(rows, "id long, last_accessed timestamp, access_count long, authority double, status string")
    got = {r.id: r.s for r in st.select("id", maintain.pruning_score(at, F.col("last_accessed"), F.col("authority"), F.col("access_count")).alias("s")).collect()}
    assert got[1] == pytest.approx(1.0, abs=0.01) and got[2] == 0 and got[3] == pytest.approx(0.65)
    found = maintain.prunable(st, at)
    assert [r.id for r in found.collect()] == [2]
    assert {r.id: r.status for r in maintain.prune(st, found).collect()} == {1: "active", 2: "inactive", 3: "active", 4: "inactive"}


def test_conflicts(spark):
    rows = [(1, "k", T0 + timedelta(minutes=i), i, a, c, 1.0, float(i), 0.0) for i, (a, c) in enumerate([("USER", 0.9), ("AGENT", 0.7), ("USER", 1.0), ("USER", 1.0)])]
    c = spark.createDataFrame(rows, "object_id long, key string, timestamp timestamp, id long, actor string, confidence double, authority double, v double, corroboration double")
    assert conflict.winners(c, "v").first().id == 2
    assert [r.accepted for r in conflict.arbitration_log(c).orderBy("id").collect()] == [True, False, True, False]
    m = spark.createDataFrame([("n", 1, 1, "i like tea"), ("n", 2, 2, "I hate tea"), ("n", 3, 3, "nothing"), ("o", 4, 4, "i like tea")], "namespace string, id long, ord long, text string")
    assert [(r.id, r.other_id) for r in conflict.textual(m).collect()] == [(2, 1)]
    burst = spark.createDataFrame([(T0,)] * 20 + [(T0 + timedelta(seconds=5),)], "timestamp timestamp")
    assert [r.n for r in conflict.bursts(burst, 1, 10).collect()] == [20]
    assert spark.range(1).select(conflict.drifted(F.lit("A Game of trees"), F.lit("botany"), {"botany": ["game"]}).alias("v")).first().v


def test_identity(spark):
    v = [(1, "a", "John", 1, [1.0, 0.0]), (2, "a", "john", 2, [0.96, 0.28]), (3, "b", "x", 3, [1.0, 0.0]), (4, "a", "y", 4, [0.0, 1.0]), (5, "a", None, 5, None)]
    ents = spark.createDataFrame(v, "id long, kind string, name string, created_at long, vec array<float>")
    pairs = identity.duplicate_pairs(ents, 0.95)
    got = pairs.collect()
    assert {(r.source_id, r.target_id) for r in got} == {(2, 1)} and all("Exact name match" in r.reason for r in got)
    assert [(r.source_id, r.target_id) for r in identity.greedy(pairs).collect()] == [(2, 1)]
    assert identity.similar(ents, ents, 0.95, block=1).count() == identity.similar(ents, ents, 0.95).count() == 6
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "id long, merged_into long")
    assert {r.canonical_id for r in identity.canonical(chain).collect()} == {0}
    e = spark.range(1).select(identity.hash_embedding(F.lit("abc"), 20).alias("v")).first().v
    import hashlib

    b = hashlib.md5(b"abc").digest()
    assert e == [x / 128 - 1 for x in (b + b)[:20]]


def test_graph_and_text(spark):
    edges = spark.createDataFrame([("a", "b", "part_of", 0.9), ("b", "c", "part_of", 0.8), ("a", "d", "likes", 1.0), ("d", "c", "likes", 1.0), ("c", "a", "part_of", 0.5)], "source_id string, target_id string, relation_type string, confidence double")
    ask = spark.createDataFrame([("a", "c"), ("a", "a"), ("b", "zz")], "start string, goal string")
    assert {(r.start, r.goal): r.path for r in graph.shortest_paths(edges, ask).collect()} == {("a", "c"): "a>b>c", ("a", "a"): "a"}
    two = {(r.source_id, r.target_id): r.confidence for r in graph.transitive(edges).collect()}
    assert two["a", "c"] == pytest.approx(0.648)
    up = {(r.source_id, r.target_id): (r.confidence, r.is_inferred, r.writes) for r in graph.with_transitive(edges.unionByName(spark.createDataFrame([("a", "c", "part_of", 0.1)], edges.schema))).where("relation_type = 'part_of'").collect()}
    assert up["a", "c"] == (pytest.approx(0.648), False, 2) and up["b", "a"] == (pytest.approx(0.36), True, 1)
    t = spark.createDataFrame([(1, "I like green tea."), (2, "My name is X, not Y"), (3, "meet a@b.org at 10.0.0.1 or http://x.y/z"), (4, None)], "id long, text string")
    kinds = {r.id: (r.k, r.n) for r in t.select("id", text.memory_type(F.col("text")).alias("k"), text.is_negated(F.col("text")).alias("n")).collect()}
    assert kinds == {1: ("preference", False), 2: ("identity", True), 3: ("event", False), 4: ("event", False)}
    assert {(r.label, r.value) for r in text.entities(t).collect()} == {("EMAIL", "a@b.org"), ("IP", "10.0.0.1"), ("URL", "http://x.y/z")}
    assert [(r.id, r.object) for r in text.relation_patterns(t).collect()] == [(1, "green tea")]


def test_every_trigger_of_texts(spark):
    """Each phrase of each family, and texts that only look like one."""
    kinds = {"I am here": "identity", "so i'm told": "identity", "I live in X": "identity", "My name is Y": "identity", "I prefer tea": "preference", "my favorite tea": "preference", "I like tea": "preference", "i always walk": "preference", "I usually walk": "preference"}
    kinds |= {"i hate rain": "event", "they like it": "event", "I loved it": "event", "xi am": "event", "i amber": "event", "today i'm feeling fine": "identity", "": "event", "éi like": "event"}
    negated = {"not now": True, "I don't": True, "no longer": True, "he stopped": True, "quit it": True, "it isn't": True, "they aren't": True, "never": False, "doesn't": False, "knot": False, "notable": False, "énot": False}
    rows = spark.createDataFrame([(t,) for t in [*kinds, *negated]], "t string").select("t", text.memory_type(F.col("t")).alias("k"), text.is_negated(F.col("t")).alias("n")).collect()
    by = {r.t: r for r in rows}
    assert {t: by[t].k for t in kinds} == kinds and {t: by[t].n for t in negated} == negated
    found = spark.createDataFrame([(1, "a_b+c@x-y.co.uk. and x@y"), (2, "see https://a.b/c?d=(e), 1.2.3.4 v1.2.3.45 1.2.3.4567")], "id long, text string")
    assert {(r.id, r.label, r.value) for r in text.entities(found).collect()} == {(1, "EMAIL", "a_b+c@x-y.co.uk."), (2, "URL", "https://a.b/c?d=(e),"), (2, "IP", "1.2.3.4")}
    fields = spark.createDataFrame([("m a.b%c@d.e.org. on 2024-01-31 or 01/02/2024, 12024-01-31",), ("none",)], "t string").select(text.regex_fields(F.col("t")).alias("f"), text.extracted(F.col("t"), F.array(F.lit("Ann"))).alias("e")).collect()
    assert (fields[0].f.email, fields[0].f.date, fields[0].e.entities) == (["a.b%c@d.e.org"], ["2024-01-31", "01/02/2024"], ["Ann", "a.b%c@d.e.org"])
    assert (fields[1].f.email, fields[1].f.date, fields[1].e.entities) == (None, None, ["Ann"])
    named = [("PERSON", "Ann"), ("ORG", "Firm"), ("ORGANIZATION", "Org"), ("GPE", "Town"), ("LOC", "Lake"), ("LOCATION", "Place")]
    said = ["my name is", "I am ", "I'm ", "call me ", "work at", "work for", "working at", "employed at", "job at", "live in", "from ", "based in", "located in", "unlike", "I like", "I prefer", "i love", "I ENJOY"]
    docs = spark.createDataFrame([(i, f"{p} Thing.!") for i, p in enumerate(said)], "id long, text string")
    every = spark.createDataFrame([(i, *n) for i in range(len(said)) for n in named], "id long, label string, value string")
    got = {}
    for r in text.relation_patterns(docs, every).collect():
        got.setdefault(said[r.id], set()).add((r.relation, r.object))
    name, work, place, pref = {("HAS_NAME", "Ann")}, {("WORKS_AT", "Firm"), ("WORKS_AT", "Org")}, {("LOCATED_IN", x) for x in ("Town", "Lake", "Place")}, {("PREFERS", "Thing")}
    want = dict.fromkeys(said[:4], name) | dict.fromkeys(said[4:9], work) | dict.fromkeys(said[9:13], place) | dict.fromkeys(said[14:], pref)
    assert got == want
    long = spark.createDataFrame([(1, "I like " + "x" * 49), (2, "I like " + "x" * 50), (3, "I like  "), (4, "I enjoy what they like most")], "id long, text string")
    assert {r.id: r.object for r in text.relation_patterns(long).collect()} == {1: "x" * 49, 4: "most"}
    ways = {"short": "TRIVIAL", "INFO " + "word " * 20: "TRIVIAL", "7" * 60 + " w" * 20: "TRIVIAL", "mail a@b.org " + "zz " * 20: "STRUCTURED", "the and of to a in that is was he for it with": "NATURAL", "zz " * 100: "COMPLEX", "zz " * 70 + "a@b.org": "COMPLEX"}
    assert {r.t: r.w for r in spark.createDataFrame([(t,) for t in ways], "t string").select("t", text.route(F.col("t")).alias("w")).collect()} == ways
    assert len(text.NATURAL) == len(set(text.NATURAL))
    assert {r.gram: r.n for r in text.ngram_profile(spark.createDataFrame([(1, "The the CAT")], "id long, text string")).collect()} == {"the": 2, "cat": 1}


def plain_greedy(pairs):
    """The scan as a loop: what is proposed is done with, but who is scanning goes on."""
    done, out, scans = set(), [], {}
    for p in pairs:
        scans.setdefault((p["left_at"], p["left_id"]), []).append(p)
    for (_, left), hits in sorted(scans.items()):
        if left in done:
            continue
        for p in sorted(hits, key=lambda p: (-p["similarity"], p["right_id"])):
            if p["right_id"] not in done:
                out.append((p["source_id"], p["target_id"]))
                done |= {p["source_id"], p["target_id"]}
    return sorted(out)


def test_greedy_scan_matches_a_loop(spark):
    rnd = random.Random(3)
    at = {i: rnd.randrange(40) for i in range(60)}
    pairs = []
    for a in range(60):
        for b in rnd.sample([x for x in range(60) if x != a and x % 5 == a % 5], rnd.randrange(4)):
            newer, older = (a, b) if at[a] > at[b] else (b, a)
            pairs.append({"left_id": a, "right_id": b, "similarity": rnd.randrange(90, 100) / 100, "source_id": newer, "target_id": older, "reason": "", "left_at": at[a]})
    schema = "left_id long, right_id long, similarity double, source_id long, target_id long, reason string, left_at long"
    got = identity.greedy(spark.createDataFrame(pairs, schema).repartition(3)).collect()
    assert sorted((r.source_id, r.target_id) for r in got) == plain_greedy(pairs)
    two = [{"left_id": 1, "right_id": 2, "similarity": 0.99, "source_id": 2, "target_id": 1, "reason": "", "left_at": 1}, {"left_id": 3, "right_id": 1, "similarity": 0.98, "source_id": 3, "target_id": 1, "reason": "", "left_at": 3}]
    assert [(r.source_id, r.target_id) for r in identity.greedy(spark.createDataFrame(two, schema)).collect()] == [(2, 1)]


def test_replay_differences(spark):
    schema = "object_id long, key string, num double, raw string"
    old = spark.createDataFrame([(1, "t", None, '"a"'), (2, "t", None, '"a"'), (3, "n", 1.0, "1"), (4, "n", 1.0, None), (5, "x", None, "null"), (6, "n", 2.0, "2"), (7, "n", 1.0, "1")], schema)
    new = spark.createDataFrame([(1, "t", None, '"a"'), (2, "t", None, '"b"'), (3, "n", 1.00001, "1.00001"), (4, "n", 1.5, None), (5, "x", None, "null"), (6, "n", None, '"2"'), (8, "n", 1.0, "1")], schema)
    got = {r.object_id: (r.expected, r.actual, r.expected_raw, r.actual_raw) for r in state.compare(old, new).collect()}
    assert got == {2: (None, None, '"a"', '"b"'), 4: (1.0, 1.5, None, None), 6: (2.0, None, None, '"2"'), 7: (1.0, None, None, None), 8: (None, 1.0, None, None)}
    heads = "object_id long, confidence double, authority double, freshness double, corroboration double"
    diff = state.compare_vectors(spark.createDataFrame([(1, 1.0, 0.5, 1.0, 0.0), (2, 1.0, 1.0, 1.0, 0.0)], heads), spark.createDataFrame([(1, 1.0, 0.7, 1.00001, 0.0), (2, 1.0, 1.0, 1.0, 0.0)], heads)).collect()
    assert [(r.object_id, r.part, r.expected, r.actual) for r in diff] == [(1, "authority", 0.5, 0.7)]


def test_memory_facade(spark):
    rows = [(1, T0, "7", "My name is Ann", "user", 0.8, 0.5, "fact"), (2, T0 + timedelta(1), "7", "I like tea!", "user", 0.9, 0.95, "preference"), (3, T0, "8", "I like rain", "agent", 0.7, 0.5, "fact"), (4, T0, None, "no entity", "agent", 0.7, 0.5, "fact")]
    told = spark.createDataFrame(rows, "ord long, timestamp timestamp, entity_id string, content string, source string, confidence double, authority double, memory_type string")
    ev = memory.remembered(told, spark.createDataFrame([("8",)], "entity_id string"), "home")
    got = {r.ord: (r.action, r.actor, r.authority, json.loads(r.delta)) for r in ev.collect()}
    assert [got[i][:3] for i in (1, 2, 3, 4)] == [("ADD", "USER", 0.9), ("UPDATE", "USER", 0.95), ("UPDATE", "AGENT", 0.5), ("ADD", "AGENT", 0.5)]
    assert got[2][3] == {"content": "I like tea!", "type": "preference", "namespace": "home"}
    st = {r.object_id: (r.content, r.version) for r in memory.states(ev).collect()}
    assert st["7"] == ("I like tea!", 2) and len(st) == 3
    named = ev.where("ord = 1").select("id", F.lit("PERSON").alias("label"), F.lit("Ann").alias("value"))
    made = {(r.kind, r.content, r.confidence) for r in memory.derived(ev, named).collect()}
    assert made == {("relation", "USER HAS_NAME Ann", 0.95), ("relation", "USER PREFERS tea", 0.9), ("entity", "Ann", 0.9)}
    full = memory.states(ev).withColumn("namespace", F.lit("home"))
    assert memory.loaded(full, "home").count() == 3 and memory.loaded(full, "x").count() == 0 == memory.cleared(full, F.lit("home")).count()
    assert memory.truth_scores(full, spark.createDataFrame([("7",), ("zz",)], "object_id string")).first().score == pytest.approx(0.9 + 1.2 * 0.95 + 0.8)
    m = full.select(F.xxhash64("object_id").alias("id"), F.col("content").alias("text"), "confidence", "authority", "freshness", "corroboration")
    q = spark.createDataFrame([(1, "tea rain")], "query_id long, query string")
    assert retrieval.recall(m, q).count() == 1  # "tea!" is another word
    assert retrieval.keyword_recall(m, spark.createDataFrame([(1, "i like")], q.schema), top=1).first().total_found == 2


def test_recall_and_context(spark):
    m = spark.createDataFrame([(1, "green tea", 1.0, 1.0, 1.0, 0.0), (2, "black Tea pot", 0.1, 0.1, 0.1, 0.0), (3, "coffee", 1.0, 1.0, 1.0, 0.0)], "id long, text string, confidence double, authority double, freshness double, corroboration double")
    q = spark.createDataFrame([(7, "tea pot")], "query_id long, query string")
    got = [(r.id, r.relevance, r["rank"]) for r in retrieval.keyword_recall(m, q).orderBy("rank").collect()]
    assert got == [(1, 0.5, 1), (2, 1.0, 2)]
    hits = spark.createDataFrame([(1, 1, "abc", 0.9), (1, 2, "d" * 100, 0.5), (1, 3, "e", 0.4)], "query_id long, rank long, content string, confidence double")
    c = retrieval.context(hits, max_tokens=10).first()
    assert (c.lines, c.context) == (1, "1. [90% confidence] abc")
