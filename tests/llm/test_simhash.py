import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from verifold.llm import simhash
from verifold.llm.common import connected_components


def plain_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(rows):
    fps = {}
    for i, f in rows:
        fps.setdefault(f, []).append(i)
    keys, parent = list(fps), {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if (keys[a] ^ keys[b]).bit_count() <= 3:
                parent[find(keys[a])] = find(keys[b])
    low = {}
    for i, f in rows:
        if i is not None:
            low[find(f)] = min(low.get(find(f), i), i)
    return [(i, f, low.get(find(f))) for i, f in rows]


def check(spark, docs, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string, fp string").repartition(5)
    got = [(r.id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df, **how).collect()]
    want = plain_components([(i, plain_fingerprint(t)) for i, t, _ in docs])
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_matches_brute_force(spark):
    rnd = random.Random(5)
    vocab = ["the", "Of", "straße", "ÉTÉ", "lorem", "ipsum", "dolor", "sit", "amet", "q"]
    docs = []
    for i in range(150):
        w = [rnd.choice(vocab) + str(rnd.randrange(30)) for _ in range(rnd.choice([1, 2, 3, 40, 200]))]
        docs.append((i, " ".join(w), "x"))
        for _ in range(rnd.randrange(3)):
            v = list(w)
            v[rnd.randrange(len(v))] = "edit"
            docs.append((1000 + len(docs), "\n".join(v), None))
    docs += [(7, None, None), (8, "", "x"), (9, " \t\x0b", "x"), (None, "lone words here", "x"), (5, docs[5][1], "again"), (5, docs[5][1], "again"), (6000, "long " * 70000, "x")]
    check(spark, docs)


def test_hot_cell_is_split_and_whole(spark):
    rnd = random.Random(1)
    base = rnd.getrandbits(64)
    fps = {base}
    while len(fps) < 300:  # a chain of near fingerprints, most of them in the same cells
        fps.add(rnd.choice(sorted(fps)) ^ (1 << rnd.randrange(20)) ^ (1 << rnd.randrange(20)))
    fps |= {rnd.getrandbits(64) for _ in range(200)}
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = connected_components(simhash.fingerprint_links(df, block=16)).collect()
    roots = {r.node % (1 << 64): r.root for r in got}
    want = plain_components([(f % 10**15, f) for f in fps])
    by_want, by_got = {}, {}
    for i, f, c in want:
        by_want.setdefault(c, set()).add(f)
    for f in fps:
        by_got.setdefault(roots.get(f, simhash._signed(f)), set()).add(f)
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values()))


def test_one_large_group_meets_by_its_pivot(spark):
    """Near copies of one fingerprint: all but a few are linked to the pivot, and the rest still find each other."""
    rnd = random.Random(2)
    base = rnd.getrandbits(64)
    fps = {base} | {base ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a)}
    far = [base ^ 0b111111 << 40 ^ (1 << k) for k in range(12)]  # six bits away, some linked to each other by two
    fps |= set(far) | {far[0] ^ (1 << 50), base ^ 0b111 << 40}
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    links = simhash.fingerprint_links(df, block=32)
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 3 for r in links.collect())
    roots = {r.node % (1 << 64): r.root for r in connected_components(links).collect()}
    want = {f: c for _, f, c in plain_components([(f % 10**15, f) for f in fps])}
    by = {}
    for f in fps:
        by.setdefault(roots.get(f, simhash._signed(f)), set()).add(want[f])
    assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(want.values()))


def test_manhattan_is_a_lower_bound():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 2**64, 1000, dtype=np.uint64), r.integers(0, 2**64, 1000, dtype=np.uint64)
    plain = [sum(abs((int(x) >> k & 3).bit_count() - (int(y) >> k & 3).bit_count()) for k in range(0, 64, 2)) for x, y in zip(a, b)]
    assert simhash.manhattan(a, b).tolist() == plain
    assert (simhash.manhattan(a, b) <= np.bitwise_count(a ^ b)).all()


def test_empty_table_and_kept_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, fp string")
    assert simhash.near_duplicates(empty).count() == 0
    docs = [(3, "a b c d e f g", "1"), (1, "A b c d e f g", "2"), (1, "A b c d e f g", "2"), (2, "other words stand here now", "3"), (None, "x", "4")]
    kept = simhash.keep_first(spark.createDataFrame(docs, "doc_id long, text string, fp string"))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((r.doc_id or 0, r.fp) for r in kept.collect()) == [(0, "4"), (1, "2"), (2, "3")]


def test_components_of_chains(spark):
    n = 70
    e = [(i, i + 1) for i in range(n)] + [(1000, 1000), (2000, 2001), (2001, 2000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(e, "a long, b long").repartition(3)).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {2001: 2000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert spark.range(1).select(F.lit(1)).count() == 1


def five(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_guide(t):
    """Guide and wide bits of a text, counted bit by bit."""
    w = (t or "").encode().lower().split()
    if not w:
        return (0, 0, 0, 0, 0)
    m = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m
        return x ^ x >> 31

    def hashes(k):
        out = []
        for i in range(max(1, len(w) - k + 1)):
            h = min(k, len(w))
            for x in w[i : i + k]:
                h = mixed((h * 0x9E3779B97F4A7C15 + xxhash.xxh64_intdigest(x, 42)) & m)
            out.append(h)
        return out

    def bits(h):
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    return (bits(hashes(2)), *(bits([mixed((x + k + 1) & m) for x in hashes(5)]) for k in range(4)))


def test_near_copies_match_brute_force(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)] + ["the", "of", "and"] * 300
    docs, sims = [], []
    for i in range(60):
        w = [rnd.choice(vocab) for _ in range(rnd.choice([60, 150, 400]))]
        docs.append((10 * i, " ".join(w)))
        for k in range(rnd.randrange(4)):
            v = list(w)
            for _ in range(rnd.randrange(1, 1 + len(w) // 25)):
                v[rnd.randrange(len(v))] = "edit%d" % rnd.randrange(1000)
            docs.append((10 * i + 1 + k, "\n".join(v).upper() if k == 1 else " ".join(v)))
    docs += [(7000, None), (7001, ""), (7002, " \t"), (None, "lone words here"), (5, docs[0][1]), (5, docs[0][1]), (8000, "long " * 70000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, g string, component_id int").repartition(5)
    got = simhash.near_copies(df, block=16).collect()
    assert sorted(r.id or -1 for r in got) == sorted(i or -1 for i, _ in docs)
    own = {r.id: r.component_id for r in got}
    assert own[7000] == own[7001] == own[7002] == 7000 and own[None] is None and own[5] == own[0] == 0 and own[8000] == 8000
    marks = [(i, five(t)) for i, t in docs[: len(docs) - 7]]
    similar, caught = 0, 0
    reach = {i: {i} for i, _ in marks}
    for a in range(len(marks)):
        for b in range(a):
            (i, p), (j, q) = marks[a], marks[b]
            if len(p & q) >= 0.8 * len(p | q):
                similar, caught = similar + 1, caught + (own[i] == own[j])
                for z in reach[i] | reach[j]:
                    reach[z] = reach[i] | reach[j]
                    for u in reach[z]:
                        reach[u] = reach[z]
    assert similar > 15 and caught >= 0.95 * similar
    assert all(own[i] in reach[i] and own[i] <= i for i in reach)  # nothing is joined but through similarities of 0.8
    kept = simhash.keep_first(df, simhash.near_copies(df))
    assert kept.columns == df.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted({own[i] if i is not None else -1 for i, _ in docs})
    assert simhash.near_copies(df.limit(0)).count() == 0


def test_near_texts_below_the_similarity_stay_apart(spark):
    """Pairs at 0.6 to 0.75, which the bits alone often take for copies, and a group of many near copies."""
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(4000)]
    docs, want = [], {}
    for i in range(40):
        w = [rnd.choice(vocab) for _ in range(200)]
        v = list(w)
        for at in range(0, 200, 25 + i % 3):  # each edit costs five shingles of 196: some 0.65
            v[at] = f"other{rnd.randrange(9999)}"
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i + 1}
    base = [rnd.choice(vocab) for _ in range(300)]
    for i in range(1000, 1120):
        v = list(base)
        for _ in range(2):
            v[rnd.randrange(300)] = f"edit{rnd.randrange(9999)}"
        docs.append((i, " ".join(v)))
        want[i] = 1000
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for block in (4096, 64):
        assert {r.id: r.component_id for r in simhash.near_copies(df, block=block).collect()} == want


def test_candidates_beyond_the_nearest_are_checked(spark, monkeypatch):
    """Copies are found as well where few of a row's candidates, or none but a crowded cell's pivot, are checked at first."""
    rnd = random.Random(12)
    base = [rnd.choice([f"w{i}" for i in range(4000)]) for _ in range(300)]
    docs = []
    for i in range(60):  # near by their bits to all the others, each a copy of one of them alone
        v = list(base)
        for at in rnd.sample(range(300), 9):
            v[at] = f"own{rnd.randrange(9999)}"
        u = list(v)
        u[rnd.randrange(300)] = "edit"
        docs += [(2 * i, " ".join(v)), (2 * i + 1, " ".join(u))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = {r.id: r.component_id for r in simhash.near_copies(df, checked=1000).collect()}
    plain = lambda a, b: len(five(docs[a][1]) & five(docs[b][1])) >= 0.8 * len(five(docs[a][1]) | five(docs[b][1]))
    assert all(want[2 * i] == want[2 * i + 1] for i in range(60)) and all(plain(2 * i, 2 * i + 1) for i in range(60))
    for checked, block in ((0, 4096), (1, 4096), (0, 16)):
        assert {r.id: r.component_id for r in simhash.near_copies(df, checked=checked, block=block).collect()} == want


def test_groups_and_choices_grow_with_rows():
    assert simhash.groups_for(10**5, 3) == 6 < simhash.groups_for(10**10, 3)
    few, many = simhash.choices_for(1000), simhash.choices_for(10**10)
    size = lambda m: (m % (1 << 64)).bit_count() // 2
    assert size(few[0]) == 8 < size(many[0]) and len(few) < len(many) < 150


def test_loose_candidates_make_no_row_for_a_pair(spark):
    """A cell gives at most a forest of its roots, and blocks of a group find every link between roots as all pairs do."""
    cell = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([7] * 60, range(60), [1 << i % 9 for i in range(60)], *[[0] * 60] * simhash.WIDE, range(100, 160))], [str(i) for i in range(4 + simhash.WIDE)])
    pairs = [p for b in simhash._unjoined(iter([cell])) for p in b.to_pylist()]
    assert 0 < len(pairs) <= 59 and {r for p in pairs for r in p.values()} == set(range(100, 160))
    rnd = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(90):
        v = list(base)
        for at in rnd.sample(range(120), rnd.choice([1, 3, 6])):
            v[at] = f"own{rnd.randrange(60)}"
        docs.append((i, " ".join(v), i % 40 if i < 60 else 999))
    rows = spark.createDataFrame([(i, root, 5) for i, _, root in docs], "node long, root long, group long")
    texts = spark.createDataFrame([d[:2] for d in docs], "node long, text string")
    want = {(a, b) for a, x, r in docs for b, y, q in docs if r < q and len(five(x) & five(y)) >= 0.8 * len(five(x) | five(y)) for a, b in [(r, q)]}

    def parts(edges):
        at = {r: r for _, _, r in docs}
        for a, b in edges:
            at = {k: at[b] if v == at[a] else v for k, v in at.items()}
        return sorted(sorted(k for k in at if at[k] == v) for v in set(at.values()))

    for most in (4, 512):
        got = {(docs[r.a][2], docs[r.b][2]) for r in simhash.links_within(rows, texts, most=most).collect()}
        assert parts(got) == parts(want) and len(parts(want)) > 1 and got <= want | {(b, a) for a, b in want}
