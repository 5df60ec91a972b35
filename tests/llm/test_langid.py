import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from verifold.llm import langid

VOCAB = {
    "aa": "the and of to with reading writing house water green".split(),
    "bb": "der die und mit für lesen schreiben häuser wasser grün".split(),
    "cc": "el la y con leer escribir casas agua verde niño".split(),
}


def doc(rnd, lang, n):
    return " ".join(rnd.choice(VOCAB[lang]) for _ in range(n))


def corpus():
    rnd = random.Random(1)
    out = [(i, doc(rnd, lang := rnd.choice(list(VOCAB)), rnd.choice([3, 20, 80])), lang) for i in range(500)]
    mixed = [(1000 + i, doc(rnd, "aa", 60) + "\n" + doc(rnd, "bb", 25), None) for i in range(20)]
    odd = [(2000, None, "aa"), (2001, "", "aa"), (2002, "123 456 !!", "aa"), (2003, "the " * 60000, "aa"), (None, "agua verde", "cc"), (3, out[3][1], out[3][2]), (2004, "wasser grün", None)]
    return out, mixed, odd


def test_held_out_accuracy_and_mixtures(spark):
    out, mixed, odd = corpus()
    df = spark.createDataFrame([(*r, "clash") for r in out + mixed + odd], "doc_id long, text string, lang string, score string").coalesce(1)
    got = langid.predict(df).collect()
    assert len(got) == len(out) + len(mixed) + len(odd)
    by = {r.doc_id: r for r in got}
    for i, _, lang in out:
        assert by[i].lang_pred == lang and 0 <= by[i].score <= 1
        assert by[i].held_out is (zlib.crc32(str(i).encode()) % 3 == 1)
    for i, _, _ in mixed:
        assert by[i].lang_pred == "aa" and by[i].score == pytest.approx(60 / 85, abs=0.08)
    assert [by[i].lang_pred for i in (2000, 2001, 2002, 2003, None, 2004)] == ["und", "und", "und", "aa", "cc", "bb"]
    assert [by[i].score for i in (2000, 2001, 2002)] == [0, 0, 0]


def test_held_out_rows_are_never_learned(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    df = spark.createDataFrame([(i, "zzz qqq", "held") for i in held] + [(i, "the and of", "aa") for i in range(400) if i not in held], "doc_id long, text string, lang string")
    assert langid.train(df)[0] == ["aa"]
    assert {r.lang_pred for r in langid.predict(df).collect()} == {"aa"}


def test_trigrams_match_a_loop():
    words = ["héllo", "a", "of", "𝒳y"]
    code, n = langid.trigrams(pa.array(words, pa.large_string()))
    assert n.tolist() == [len(f" {w} ".encode()) - 2 for w in words]
    alone = [langid.trigrams(pa.array([w], pa.large_string()))[0].tolist() for w in words]
    assert code.tolist() == [c for own in alone for c in own]


def test_em_matches_a_loop():
    rnd = np.random.default_rng(2)
    like = rnd.normal(-20, 5, (9, 3)).astype(np.float32)
    sizes = np.array([4, 5])
    share, value = langid.fit(like, np.array([0, 4]), np.repeat([0, 1], sizes), np.ones((2, 3)), 5)
    for d, own in enumerate((like[:4], like[4:])):
        p = np.full(3, 1 / 3)
        for _ in range(5):
            r = np.exp(own.astype(float)) * p
            r /= r.sum(1, keepdims=True)
            p = r.mean(0)
        assert share[d] == pytest.approx(p, rel=1e-4)
        assert value[d] == pytest.approx(np.log((np.exp(own.astype(float)) * p).sum(1)).sum(), rel=1e-5)


def plain_infer(like, rounds=langid.ROUNDS, penalty=langid.PENALTY):
    """Language and share of one document from its words' likelihoods: EM and the choice of the set by loops."""

    def em(langs):
        p = {k: 1 / len(langs) for k in langs}
        for _ in range(rounds):
            sums = dict.fromkeys(langs, 0.0)
            for row in like:
                top = max(row)
                part = {k: math.exp(row[k] - top) * p[k] for k in langs}
                whole = max(sum(part.values()), 1e-300)
                for k in langs:
                    sums[k] += part[k] / whole
            p = {k: v / len(like) for k, v in sums.items()}
        value = sum(math.log(max(sum(math.exp(row[k] - max(row)) * p[k] for k in langs), 1e-300)) + max(row) for row in like)
        return p, value

    n = len(like[0])
    single = [sum(row[k] for row in like) for k in range(n)]
    first = single.index(max(single))
    full, _ = em(range(n))
    order = [first, *sorted((k for k in range(n) if k != first), key=lambda k: (-full[k], k))]
    best = (single[first], first, 1.0)
    if n == 1 or full[order[1]] * len(like) < 1:
        return best[1], best[2]
    for size in range(2, n + 1):
        p, value = em(order[:size])
        value -= penalty * (size - 1) * math.log(len(like) + 1) / 2
        if value <= best[0]:
            break
        top = max(range(n), key=lambda k: (p.get(k, 0), -k))
        best = (value, top, p[top])
    return best[1], best[2]


def test_sets_match_a_loop():
    rnd = np.random.default_rng(4)
    docs = []
    for _ in range(60):  # words of two or three languages, or of one
        main = rnd.integers(0, 4, rnd.integers(1, 4))
        docs.append(np.array([rnd.normal(-20, 1, 4) + 4 * (np.arange(4) == rnd.choice(main)) for _ in range(rnd.integers(1, 40))], np.float32))
    sizes = np.array([len(d) for d in docs])
    lang, share, sets = langid.infer(np.concatenate(docs), sizes)
    assert sets.sum(1) == pytest.approx(np.ones(len(docs))) and sets.max(1) == pytest.approx(share) and ((sets > 0).sum(1) > 1).any()
    want = [plain_infer(d.astype(float).tolist()) for d in docs]
    assert lang.tolist() == [k for k, _ in want]
    assert share == pytest.approx([x for _, x in want], rel=1e-3)
    assert sum(x < 0.999 for x in share) > 10
    # words by their counts are the words themselves
    times = rnd.integers(1, 5, int(sizes.sum()))
    many = np.repeat(np.concatenate(docs), times, axis=0)
    own = np.repeat(np.arange(len(docs)), sizes)
    a, b = langid.infer(np.concatenate(docs), sizes, times=times), langid.infer(many, np.bincount(np.repeat(own, times)))
    assert a[0].tolist() == b[0].tolist() and a[1] == pytest.approx(b[1], rel=1e-4)


def test_small_batches_and_many_languages(spark, monkeypatch):
    out, mixed, odd = corpus()
    df = spark.createDataFrame(out + mixed + odd, "doc_id long, text string, lang string").coalesce(2)
    model = langid.train(df)
    texts = pa.array([t for _, t, _ in out + mixed + odd], pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([True] * len(texts)), texts], names=["a", "b", "c"])
    run = lambda cells: [r for b in langid.predictor(*model, langid.PENALTY, cells)([batch]) for r in b.to_pylist()]
    assert run(1 << 22) == run(60)
    # likelihoods, and so verdicts, are the same beside 297 more languages
    more = [(10_000 + 3 * k + j, " ".join("".join("bcdfghjklm"[int(c)] + "aeiou"[int(c) % 5] for c in f"{k * 7919 % 1000:03d}") for _ in range(30)), f"z{k:03d}") for k in range(297) for j in range(3)]
    names, table = langid.train(df.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string")))
    assert len(names) > 280 and len(table) == len(model[1]) == langid.BUCKETS
    assert np.array_equal(table[:, [names.index(n) for n in model[0]]], model[1])
    beside = [r for b in langid.predictor(names, table, langid.PENALTY)([batch]) for r in b.to_pylist()]
    alone = run(1 << 22)
    assert [r["lang_pred"] for r in beside[: len(out)]] == [r["lang_pred"] for r in alone[: len(out)]]
    assert all(r["languages"][:1] == [r["lang_pred"]] and abs(sum(r["shares"]) - 1) < 1e-6 for r in alone if r["lang_pred"] != "und")
    # 600 languages of a word each
    word = lambda k: "".join("bcdfghjklm"[int(c)] + "aeiou"[int(c) % 5] for c in f"{k * 7919 % 1000:03d}") + "x" * (k % 7)
    rows = [(3 * k + j, " ".join([word(k)] * 5), f"l{k:03d}") for k in range(600) for j in range(6)]
    many = spark.createDataFrame([(i, t, lang) for i, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    got = langid.predict(many).join(many, "doc_id").collect()
    assert len(got) == len(rows) and sum(r.lang_pred == r.lang for r in got) >= 0.9 * len(got)


def test_training_rows_are_the_lowest_hashes(spark):
    df = spark.createDataFrame([(i, f"text {i % 4000}", "aa" if i % 10 else "bb") for i in range(9000)] + [(1, "hot", "aa")] * 3000, "doc_id long, text string, lang string")
    got = langid.training_rows(df, most=40).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got}["bb"] == 40
    marks = df.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1").selectExpr("lang", "text", "xxhash64(doc_id, text) as m").distinct().collect()
    want = {(r.lang, r.text) for lang in ("aa", "bb") for r in sorted((r for r in marks if r.lang == lang), key=lambda r: r.m)[:40]}
    assert {(r.lang, r.text) for r in langid.training_rows(df, most=40).collect()} == want


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.predict(df).collect()] == [("und", 0)]
    assert langid.predict(df.limit(0)).count() == 0
