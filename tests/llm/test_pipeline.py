import random
from collections import Counter

import corpus_pipeline as cp

ITEM = "Which of these trees grows tallest in the northern woods of that country and why does it.\nThe old red pine of the hills does."


def write_tables(spark, path):
    rnd = random.Random(2)
    parts = "in ter na tion al or gan is a co der pre for mat re spon si bil i ty en vi ron ment con sid er struc ture".split()
    word = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, text(rnd.randrange(60, 200)), "en", rnd.choice(["a", "b", None])) for i in range(120)]
    good = docs[7][1]
    docs += [(200, good, "en", "a"), (201, good[0].upper() + good[1:], "en", "b")]  # copies
    docs += [(210, text(80) + "\n" + ITEM + "\n" + text(80), "en", "a")]  # a leak
    docs += [(220, text(80) + " password = hunter2hunter2 " + text(20), "en", "a")]  # a secret
    docs += [(230, "too short", "en", "a"), (231, "same words again " * 60, "en", "a"), (232, None, "en", "a"), (233, "", None, None)]  # rejected
    docs += [(240 + i, " ".join("#$%" + rnd.choice("###$$$%%%&&&") * 3 for _ in range(90)), "en", "b") for i in range(6)]  # junk
    rows = [(*d, len(d[1]) if d[1] is not None else None) for d in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)] + [(240, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs


def test_stages_keep_and_drop_what_they_should(spark, tmp_path):
    docs = write_tables(spark, str(tmp_path))
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen, columns = [], at.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, at, str(tmp_path))
        assert k == len(cp.STAGES) - 1 or out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id for r in at.select("doc_id").collect()})
    clean = set(range(120))
    assert seen[0] == clean | {200, 201, 210, 220}
    assert seen[1] == clean | {210, 220}
    assert seen[2] == clean | {220} == seen[3] == seen[4]
    texts = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert "hunter2" not in texts[220].text and texts[220].n_chars == len(texts[220].text)
    assert all(texts[i].text == docs[i][1] for i in clean)
    mix = spark.read.parquet(f"{tmp_path}/4").collect()
    taken, target = Counter(), {}
    for r in mix:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r["size"]
    assert all(abs(taken[s] - t) <= max(256, 0.05 * t) for s, t in target.items())
    whole = cp.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.taken) for r in whole) == sorted((r.doc_id, r.taken) for r in mix)


def test_columns_of_any_name_pass_through(spark, tmp_path):
    write_tables(spark, str(tmp_path))
    from pyspark.sql import functions as F

    more = ["kept", "llr", "n_words", "hex", "assign", "access", "markov", "fp", "g", "w0", "node", "component_id", "size", "_own_keep", "_id", "item_id", "a", "b"]
    at = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in more})
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k < len(cp.STAGES) - 1:
            assert out.schema == at.schema, name
            out.write.parquet(f"{tmp_path}/clash-{k}")
            at = spark.read.parquet(f"{tmp_path}/clash-{k}")
            assert all(r[c] == f"{c}{r.doc_id}" for r in at.collect() for c in more), name
    assert out.count() == at.count() > 100


def test_nulls_and_repeated_rows(spark, tmp_path):
    write_tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = docs.where("doc_id = 7").first()
    odd = spark.createDataFrame([(None, good.text, None, None, None), (7, good.text, good.lang, good.source, good.n_chars), (7, good.text, good.lang, good.source, good.n_chars), (500, None, None, None, None)], docs.schema)
    seen = []
    at = docs.unionByName(odd)
    for _, stage in cp.STAGES:
        at = stage(spark, at, str(tmp_path))
        seen.append([r.doc_id for r in at.select("doc_id").collect()])
    assert seen[0].count(7) == 3 and None in seen[0] and 500 not in seen[0]
    assert seen[1].count(7) == 1 == seen[1].count(None) and seen[4].count(7) == 1


def test_stages_survive_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in cp.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), str(tmp_path)).count() == 0
