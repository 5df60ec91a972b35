"""Streams leave what batches leave, and ingest sorts records as it should."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from verifold.operators import state
from verifold.streaming import ingest

T0 = datetime(2024, 1, 1)
SCHEMA = "object_id long, key string, timestamp timestamp, id long, action string, num double, raw string"


def rows(spark, n=200):
    acts = ["PLANT", "ADD", "REMOVE", "UPDATE", "OBSERVE"]
    return spark.createDataFrame([(i % 7, "v", T0 + timedelta(minutes=(i * 37) % 500), i, acts[(i * 5) % 5 if i % 3 else i % 5], float(i % 11), None) for i in range(n)], SCHEMA)


def test_micro_batches_repair_any_lateness(spark, tmp_path):
    r = rows(spark)
    r.repartition(5, F.col("id")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest.fold_batches(source, str(tmp_path / "states"), str(tmp_path / "log"), str(tmp_path / "cp"))
    q.awaitTermination()
    last = max(p["batchId"] for p in q.recentProgress)
    assert last >= 2
    got = {x.object_id: x.num for x in ingest.current_states(spark, str(tmp_path / "states")).collect()}
    assert got == {x.object_id: pytest.approx(x.num) for x in state.fold(r).collect()}
    # two versions of a bucket at most, and one entity's batch touches one bucket
    assert all(len(list(d.glob("epoch=*"))) <= 2 for d in (tmp_path / "states").glob("bucket=*"))
    r.where("object_id = 3").limit(1).withColumn("id", F.lit(9999).cast("long")).withColumn("timestamp", F.lit(str(T0 + timedelta(days=9))).cast("timestamp")).withColumn("action", F.lit("UPDATE")).withColumn("num", F.lit(100.0)).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.fold_batches(source, str(tmp_path / "states"), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert len([d for d in (tmp_path / "states").glob(f"bucket=*/epoch={last + 1}")]) == 1
    after = {x.object_id: x.num for x in ingest.current_states(spark, str(tmp_path / "states")).collect()}
    assert {k for k in after if after[k] != got[k]} == {3}


def test_what_comes_in_order_needs_no_log(spark, tmp_path):
    """Rows in order are folded onto the stored states, though the log is gone; equal times go by id."""
    sets = [
        [(1, "v", T0, 1, "PLANT", 10.0, None), (1, "v", T0, 2, "ADD", 1.0, None), (2, "t", T0, 3, "UPDATE", None, '"a"'), (3, "v", T0, 4, "ADD", 4.0, None), (None, "v", T0, 5, "ADD", 4.0, None)],
        [(1, "v", T0, 6, "ADD", 5.0, None), (2, "t", T0 + timedelta(1), 7, "ADD", 2.0, None), (1, "w", T0 - timedelta(9), 8, "REMOVE", 2.0, None)],
        [(1, "v", T0 + timedelta(1), 9, "REMOVE", 3.0, None), (2, "t", T0 + timedelta(2), 10, "OBSERVE", None, '"b"')],
    ]
    paths = [str(tmp_path / x) for x in ("states", "log", "cp")]
    for k, part in enumerate(sets):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 1:
            (tmp_path / "log").rename(tmp_path / "gone")
        ingest.fold_batches(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), *paths).awaitTermination()
        got = {(x.object_id, x.key): (x.num, x.raw) for x in ingest.current_states(spark, paths[0]).collect()}
        seen = spark.createDataFrame([r for p in sets[: k + 1] for r in p if r[0] is not None], SCHEMA)
        assert got == {(x.object_id, x.key): (x.num, x.raw) for x in state.fold(seen).collect()}
    assert got[1, "v"] == (13.0, None) and got[2, "t"] == (None, '"b"')


def test_stateful_fold_under_a_watermark(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = lambda m: T0 + timedelta(minutes=m)
    parts = [
        [(1, "v", at(5), 2, "ADD", 5.0, None), (1, "v", at(1), 1, "PLANT", 10.0, None), (2, "v", at(2), 3, "ADD", 7.0, None)],
        [(1, "v", at(3), 4, "REMOVE", 2.0, None), (9, "v", at(600), 5, "ADD", 1.0, None)],
        [(2, "v", at(1), 6, "ADD", 3.0, None), (9, "v", at(2000), 7, "ADD", 1.0, None)],
    ]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q = ingest.fold_stream(source.select("object_id", "timestamp", "id", "action", "num"), "1 hour").writeStream.outputMode("update").foreachBatch(lambda df, e: df.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    rows_ = spark.read.parquet(str(tmp_path / "out")).collect()
    done = {}
    for r in sorted(rows_, key=lambda r: r.version):
        done[r.object_id] = (r.value, r.version, r.last_event_id)
    assert done[1] == (13.0, 3, 2) and done[2] == (7.0, 1, 3) and 9 not in done  # in order; event 6 came behind the watermark, and of 9 one event still waits


def test_records_are_sorted(spark):
    records = ['{"action":"ADD","object_id":"7","delta":{"n":1}}', '{"action":"SOW","delta":{"n":1}}', "plain text I like", '{"broken', '{"delta":{"n":1}}', "x" * 70_000, None]
    got = ingest.checked(spark.createDataFrame([(i, r) for i, r in enumerate(records)], "id long, value string"))
    by = {r.id: (r.status, r.action, r.object_id) for r in got.collect()}
    assert by == {0: ("accepted", "ADD", "7"), 1: ("rejected", "SOW", None), 2: ("accepted", "UPDATE", None), 3: ("accepted", "UPDATE", None), 4: ("accepted", "UPDATE", None), 5: ("oversize", "UPDATE", None), 6: ("rejected", "UPDATE", None)}
    good, bad = ingest.split(got)
    assert (good.count(), bad.count()) == (4, 3)


def test_pressure(spark):
    p = spark.range(1).select(ingest.pressure(F.lit(2500), F.lit(0.02)).alias("a"), ingest.delay_ms(F.lit(0.9)).alias("b"), ingest.delay_ms(F.lit(0.6)).alias("c"), ingest.delay_ms(F.lit(0.1)).alias("d"), ingest.disk_pressure(F.lit(0), F.lit(2000)).alias("e")).first()
    assert tuple(p) == (0.5, 100, 10, 0, 0.5)
