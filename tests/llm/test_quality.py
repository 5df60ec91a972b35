import math
import random
import re

import pytest

from verifold.llm import quality

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_words(t):
    return [w for w in re.split(f"[{SPACES}]+", t or "") if w]


def plain_rules(t):
    t = t or ""
    w = plain_words(t)
    lines = [x for x in t.split("\n") if plain_words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    covered = set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), failed


def corpus():
    rnd = random.Random(3)
    out = []
    for i in range(120):
        v = ["alpha", "beta", "gamma", "délta", "𝒳ray", "the", "of"] if i % 3 else ["###", "x|y", "$$$", "THE!!", "&&"]
        sep = rnd.choice([" ", "  ", "\n", "\t ", " \x0b"])
        out.append((i, sep.join(str(rnd.randrange(40)) * (i % 2) + rnd.choice(v) for _ in range(rnd.choice([0, 1, 2, 3, 60, 200])))))
    out += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "same line here\n" * 40), (1004, "a b c " * 20000), (None, "x y z " * 30), (5, "again"), (5, "again"), (1005, "  nbsp stays words\n\nx")]
    return out


def plain_buckets(spark, words, n):
    ones, twos = list(words), list(zip(words, words[1:]))
    kinds = sorted({(w,) for w in ones} | set(twos))
    rows = spark.createDataFrame([(k[0], k[1] if len(k) > 1 else None, len(k)) for k in kinds], "a string, b string, n int")
    hashes = {(r.a,) if r.n == 1 else (r.a, r.b): r.h for r in rows.selectExpr("a", "b", "n", "if(n = 1, xxhash64(a), xxhash64(xxhash64(a), xxhash64(b))) as h").collect()}
    return [hashes[k] % n for k in [*((w,) for w in ones), *twos]]


def plain_llr(spark, docs, trusted, n, prior):
    """Scores of all documents from plain counts."""
    grams = [plain_buckets(spark, plain_words(t), n) if plain_words(t) else [] for _, t in docs]
    t, r = [0] * n, [0] * n
    for (i, _), g in zip(docs, grams):
        for b in g:
            r[b] += 1
            t[b] += i in trusted
    share = sum(t) / sum(r)
    weight = [round(math.log((a + prior) / (b * share + prior)), 3) if sum(t) else 0.0 for a, b in zip(t, r)]
    return weight, [sum(weight[b] for b in g) / len(g) if g else 0.0 for g in grams]


def some_labels(spark):
    rows = [(i, 1 if i % 3 else 0, 0) for i in range(120)] + [(None, 1, 0), (3, None, 0), (1, 1, 0), (4, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_rules_match_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, kept string").repartition(4)
    labels = some_labels(spark)
    got = quality.judge(df, labels).collect()
    assert sorted(((r.doc_id, r.text or ""), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got if r.doc_id is not None) == sorted(((i, t or ""), plain_rules(t)) for i, t in docs if i is not None)
    # scores and threshold, counted anew
    trusted = {r.doc_id for r in quality.trusted_ids(labels).collect()}
    fitting = {r.doc_id: r.good for r in quality.fitting_ids(labels).collect()}
    assert not trusted & set(fitting) and 4 not in trusted and 4 not in fitting and {i for i in range(120) if i % 3} - {4} <= trusted | set(fitting)
    assert {i for i, g in fitting.items() if not g} == set(range(0, 120, 3))
    _, scores = plain_llr(spark, docs, trusted, quality.BUCKETS, quality.PRIOR)
    assert sorted((r.doc_id or -1, r.text or "", round(r.llr, 4)) for r in got) == sorted((i or -1, t or "", pytest.approx(s, abs=1e-4)) for (i, t), s in zip(docs, scores))
    passed = [(fitting[i], s) for (i, t), s in zip(docs, scores) if i in fitting and not plain_rules(t)[-1]]
    cut = quality.cut(passed)
    share = lambda c: sum(g and v >= c for g, v in passed) / sum(g for g, _ in passed) - sum(not g and v >= c for g, v in passed) / sum(not g for g, _ in passed)
    assert share(cut) == pytest.approx(max(share(v) for _, v in passed))
    assert all(r.kept is (not r.base_failed and r.llr >= cut) for r in got if abs(r.llr - cut) > 1e-3)
    # caller's columns survive in the pipeline's form, whatever they are called
    plain = quality.accepted(df.withColumn("llr", df["doc_id"]).withColumn("_own_kept", df["text"]), labels)
    assert plain.columns == ["doc_id", "text", "kept", "llr", "_own_kept"]
    kept = plain.collect()
    assert {r.kept for r in kept} == {"clash"} and all(r.llr == r.doc_id and r._own_kept == r.text for r in kept)
    assert sorted(r.doc_id or -1 for r in kept) == sorted(r.doc_id or -1 for r in got if r.kept)


def test_cut():
    assert quality.cut([(True, 1.0), (False, 0.0)]) == 0.5
    assert quality.cut([(True, 1.0), (True, 2.0)]) == quality.cut([(False, 1.0)]) == quality.cut([]) == -math.inf
    assert quality.cut([(False, 0.0), (False, 0.2), (True, 0.1), (True, 0.4), (True, 0.6)]) == pytest.approx(0.3)
    assert quality.cut([(False, 0.5), (True, 0.5)]) == -math.inf  # ties can't be parted


def test_weights_shrink_where_little_is_known(spark):
    docs = [(1, "a b c a"), (2, "x y"), (3, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    trusted = spark.createDataFrame([(1,)], "doc_id long")
    weight, _ = plain_llr(spark, docs, {1}, 64, 0.5)
    assert quality.bucket_weights(df, trusted, 64) == pytest.approx(weight)
    assert quality.bucket_weights(df, trusted.limit(0), 64) == [0.0] * 64


def test_no_labels_and_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(empty, labels).count() == 0
    one = quality.judge(spark.createDataFrame([(1, " ".join(map(str, range(60))))], "doc_id long, text string"), labels).first()
    assert one.kept and one.llr == 0


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    plan = quality.with_rules(df, [0.0] * 8)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
