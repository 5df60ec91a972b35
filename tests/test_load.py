"""A log played back arrives once and whole, at its rate and in bounded micro-batches, and a slow sink raises the delay."""

import time

import pytest
from pyspark.sql import functions as F

from verifold.streaming import ingest, load


@pytest.fixture
def recorded(spark, tmp_path):
    spark.dataSource.register(load.EventLoad)
    path = str(tmp_path / "log")
    spark.range(1000).select("id", (F.col("id") * 2).cast("string").alias("said")).repartition(3).write.option("parquet.block.row.count.limit", 150).parquet(path)
    return path


def run(spark, path, step, checkpoint, **options):
    source = spark.readStream.format("event_load").options(path=path, **{k: str(v) for k, v in options.items()}).load()
    return source, source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def test_all_rows_once_in_bounded_batches_over_a_restart(spark, recorded, tmp_path):
    out, sizes = str(tmp_path / "out"), []

    def put(batch, epoch):
        sizes.append(batch.count())
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    # 400 rows are due until the stop, the rest thereafter: the clock is set by the start of the log
    source, writer = run(spark, recorded, put, str(tmp_path / "cp"), rate=1, started=time.time() - 400, most=130, position=tmp_path / "at")
    assert source.columns == ["id", "said"]
    q = writer.start()
    q.processAllAvailable()
    q.stop()
    first = sum(sizes)
    assert 400 <= first < 1000 and max(sizes) <= 130
    _, writer = run(spark, recorded, put, str(tmp_path / "cp"), rate=1, started=time.time() - 5000, most=200, position=tmp_path / "at")
    q = writer.start()
    q.processAllAvailable()
    q.stop()
    assert max(sizes) == 200 and sum(sizes) == 1000
    got = spark.read.parquet(out)
    assert (got.count(), got.select("id").distinct().count()) == (1000, 1000)
    assert got.where("said <> cast(id * 2 as string)").count() == 0


def test_nothing_is_due_before_its_time(recorded):
    r = load.EventLoad({"path": recorded, "rate": "10", "started": str(time.time() + 100)}).streamReader(load.EventLoad({"path": recorded}).schema())
    assert r.initialOffset() == {"row": 0} == r.latestOffset() and r.partitions({"row": 0}, {"row": 0}) == []
    # any two ranges that follow each other give each row once
    cut = [0, 1, 149, 150, 151, 700, 1000]
    rows = [x for a, b in zip(cut, cut[1:]) for p in r.partitions({"row": a}, {"row": b}) for batch in r.read(p) for x in batch.column("id").to_pylist()]
    assert len(rows) == 1000 and sorted(rows) == list(range(1000))
    with pytest.raises(ValueError):
        r.__class__(load.EventLoad({"path": recorded}).schema(), {"path": recorded, "most": "5"})


def test_a_slow_sink_raises_the_delay(spark, recorded, tmp_path):
    gauge, waits = load.Gauge("slow", full_rows=1e9, full_seconds=6.0), []
    spark.streams.addListener(gauge)

    def sink(batch, epoch):
        batch.count()
        time.sleep(7.0 if epoch == 1 else 0.0)
        if epoch == 1:
            return
        time.sleep(0.5)

    try:
        _, writer = run(spark, recorded, load.paced(sink, gauge, waits.append), str(tmp_path / "cp"), rate=1000, started=time.time() - 60, most=300, position=tmp_path / "at")
        q = writer.queryName("slow").start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.streams.removeListener(gauge)
    assert gauge.peak == 1.0
    assert 0.1 in waits or gauge.level <= 0.5
    levels = [load.level_of(n, t) for n, t in [(2500, 0.02), (0, 0.0), (9000, 0.0), (0, 0.07)]]
    assert levels == [0.5, 0.0, 1.0, pytest.approx(0.7)]
    for level, want in [(0.9, 100), (0.6, 10), (0.1, 0)]:
        gauge.level = level
        assert spark.range(1).select(ingest.delay_ms(F.lit(level))).first()[0] == want == round(gauge.delay * 1000)
