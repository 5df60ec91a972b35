"""Ingest: raw records to events, in batches or streams, and the stateful fold of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as tx

SLAB_BYTES, HEAD_BYTES = 65_536, 4
ACTIONS = ("PLANT", "ADD", "REMOVE", "UPDATE", "OBSERVE", "INFER")


def checked(records: DataFrame, value: str = "value", slab: int = SLAB_BYTES) -> DataFrame:
    """records with status: oversize, or rejected for an unknown action, else accepted; and action, object_id, delta, memory_type.

    A record that is a JSON object with action and delta says what it does; any other text is an UPDATE of `content`. A
    null record is rejected.
    """
    raw = F.col(value)
    obj = F.when(F.ltrim(raw).startswith("{"), F.try_parse_json(raw))
    said, delta = F.try_variant_get(obj, "$.action", "string"), F.to_json(F.try_variant_get(obj, "$.delta", "variant"))
    full = said.isNotNull() & delta.isNotNull()
    action = F.when(full, said).otherwise("UPDATE")
    status = F.when(raw.isNull(), "rejected").when(F.octet_length(raw) + HEAD_BYTES > slab, "oversize").when(~action.isin(*ACTIONS), "rejected").otherwise("accepted")
    return records.select(
        "*", status.alias("status"), action.alias("action"), F.try_variant_get(obj, "$.object_id", "string").alias("object_id"),
        F.when(full, delta).otherwise(F.to_json(F.struct(raw.alias("content")))).alias("delta"), tx.memory_type(raw).alias("memory_type"),
    )


def identified(rows: DataFrame, key: str = "id", value: str = "value") -> DataFrame:
    """checked() rows with an object_id each: a record that names none is an entity of its own, by a hash of its key and text,
    so that a batch that is run again names it the same. Without key and text there is none."""
    own = F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), value), 256)
    return rows.withColumn("object_id", F.coalesce("object_id", F.when(F.col(key).isNotNull() | F.col(value).isNotNull(), own)))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted records, and the rest for a dead-letter table."""
    return rows.where("status = 'accepted'"), rows.where("status <> 'accepted'")


def pressure(queued: Column, seconds: Column) -> Column:
    """How far a micro-batch is behind: of 5,000 queued rows or 0.1 s, whichever is worse."""
    return F.greatest(F.least(F.lit(1.0), queued / 5000.0), F.least(F.lit(1.0), seconds / 0.1))


def disk_pressure(on_disk: Column, in_memory: Column) -> Column:
    return F.greatest(F.least(F.lit(1.0), on_disk / 5000.0), 0.5 * F.least(F.lit(1.0), in_memory / 1000.0))


def delay_ms(level: Column) -> Column:
    return F.when(level > 0.8, 100).when(level > 0.5, 10).otherwise(0)


# How late an event may be to be taken as it comes, and to be taken if someone approves.
ACCEPT_DAYS, APPROVE_DAYS = 30, 365
ROUTES = ("accept", "approve", "reject")


def routed(events: DataFrame, at: str = "timestamp", arrived: str = "arrived", accept: int = ACCEPT_DAYS, approve: int = APPROVE_DAYS) -> DataFrame:
    """events with days_late, how long after its time an event arrived, and route: accept, approve or reject.

    Events of the future are on time; without a time or an arrival there is nothing to go by, and an event is rejected.
    Works on streams and batches alike.
    """
    days = (F.unix_micros(F.col(arrived).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / F.lit(8.64e10)
    late = F.greatest(F.lit(0.0), days)
    return events.withColumn("days_late", F.when(days.isNotNull(), late)).withColumn("route", F.when(days.isNull() | (late > approve), "reject").when(late > accept, "approve").otherwise("accept"))


def route_stream(events: DataFrame, path: str, checkpoint: str, key: str = "id", at: str = "timestamp", arrived: str = "arrived", accept: int = ACCEPT_DAYS, approve: int = APPROVE_DAYS, within: str = "1 day", every: str | None = None):
    """A stream of events written by route below path, once per key: what may be folded, what waits for approval, what is turned away.

    An event that is sent again within the delay of its arrival is dropped, by a watermark on arrivals, so that state is
    kept for that long only; lateness is by event time, and no event is too late for a route. Returns the started query.
    Read one route with route_of().
    """
    once = routed(events.withColumn(arrived, F.col(arrived).cast("timestamp")), at, arrived, accept, approve).withWatermark(arrived, within).dropDuplicatesWithinWatermark([key])
    writer = once.writeStream.format("parquet").partitionBy("route").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def route_of(spark: SparkSession, path: str, route: str) -> DataFrame:
    """What route_stream() sent one way."""
    return spark.read.parquet(path).where(F.col("route") == route).drop("route")


class Fold(StatefulProcessor):
    """Per entity, events are kept until the watermark passes them, then folded in event order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "value double, version long, last_event_id long, last_us long")
        self.waiting = handle.getListState("waiting", "us long, id long, action string, num double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            for r in f.itertuples(index=False):
                self.waiting.appendValue((int(pd.Timestamp(r.timestamp).value // 1000), int(r.id), r.action, float(r.num)))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self.waiting.exists():
            self.handle.registerTimer(max(w[0] for w in self.waiting.get()) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        value, version, last, last_us = self.state.get() if self.state.exists() else (None, 0, None, 0)
        for us, i, action, num in sorted(tuple(w) for w in self.waiting.get()):
            if value is None or action in ("UPDATE", "OBSERVE", "INFER"):
                value = num
            else:
                value += -num if action == "REMOVE" else num
            version, last, last_us = version + 1, i, us
        self.waiting.clear()
        self.state.update((value, version, last, last_us))
        yield pd.DataFrame([(key[0], value, version, last)], columns=["object_id", "value", "version", "last_event_id"])

    def close(self) -> None:
        pass


FOLD_SCHEMA = "object_id long, value double, version long, last_event_id long"


def fold_stream(events: DataFrame, delay: str = "30 days") -> DataFrame:
    """Folded states of a stream of long-form rows. Events behind the watermark are dropped by Spark; where they must count, use fold_batches().

    Needs the RocksDB state store. Output in update mode: the last row of an entity is its state.
    """
    marked = events.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)
    return marked.groupBy("object_id").transformWithStateInPandas(Fold(), FOLD_SCHEMA, "update", "eventTime")


#: Log and states are kept in so many buckets of entities; a micro-batch reads and writes the buckets it touches.
BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _versions(states: DataFrame) -> dict[int, int]:
    """The newest epoch of each bucket, from the folders' names: at most as many rows as there are buckets."""
    return {r.bucket: r.epoch for r in states.groupBy("bucket").agg(F.max("epoch").alias("epoch")).collect()}


def current_states(spark: SparkSession, states_path: str, buckets: list[int] | None = None, until: int | None = None) -> DataFrame:
    """The states that fold_batches() left, of some buckets or all; until: as of that epoch."""
    rows = spark.read.parquet(states_path)
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    if until is not None:
        rows = rows.where(F.col("epoch") <= until)
    wanted = F.lit(False)
    for k, v in sorted(_versions(rows).items()):
        wanted = wanted | ((F.col("bucket") == k) & (F.col("epoch") == v))
    return rows.where(wanted).drop("bucket", "epoch")


def _with_last(rows: DataFrame) -> DataFrame:
    """state.fold() of rows with last_at and last_id, the time and id of the last of them."""
    from ..operators import state

    last = rows.groupBy("object_id", "key").agg(F.max(F.struct("timestamp", "id")).alias("_l"))
    return _by_key(state.fold(rows), last.select("object_id", "key", F.col("_l.timestamp").alias("last_at"), F.col("_l.id").alias("last_id")), "inner")


def _by_key(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """A join of both by entity and key, of which a null is one."""
    named = right.withColumnRenamed("object_id", "_o").withColumnRenamed("key", "_k")
    return left.join(named, (F.col("object_id") == F.col("_o")) & F.col("key").eqNullSafe(F.col("_k")), how).drop("_o", "_k")


def _refolded(log: DataFrame, own: DataFrame, old: DataFrame) -> DataFrame:
    """The states old after a micro-batch's own rows, which are in the log by then. A key whose first row of the batch isn't
    after its state's last event is late."""
    firsts = own.groupBy("bucket", "object_id", "key").agg(F.min(F.struct(F.col("timestamp").alias("last_at"), F.col("id").alias("last_id"))).alias("_first"))
    met = _by_key(firsts, old.select("object_id", "key", F.struct("last_at", "last_id").alias("_last")), "left")
    late = met.where(F.col("_first") <= F.col("_last")).select("bucket", "object_id", "key")
    touched, own = firsts.select("object_id", "key"), own.drop("bucket")
    seeds = _by_key(old, touched, "left_semi").select("object_id", "key", F.col("last_at").alias("timestamp"), F.lit(-1).cast("long").alias("id"), F.lit("UPDATE").alias("action"), "num", "raw")
    onto = _by_key(seeds.unionByName(own.select(*seeds.columns)), late.drop("bucket"), "left_anti")
    parts = [_by_key(old, touched, "left_anti"), _with_last(onto)]
    behind = [r.bucket for r in late.select("bucket").distinct().collect()]
    if behind:
        again = log.where(F.col("bucket").isin(behind)).drop("bucket", "epoch")
        parts.append(_with_last(_by_key(again, late.drop("bucket"), "left_semi")))
    out = parts[0].select("object_id", "key", "num", "raw", "last_at", "last_id")
    for more in parts[1:]:
        out = out.unionByName(more.select(*out.columns))
    return out


def fold_batches(events: DataFrame, states_path: str, log_path: str, checkpoint: str, buckets: int = BUCKETS, every: str | None = None):
    """A stream that keeps states right under any lateness: each micro-batch goes to the log; what is later than all that an
    entity's key has seen is folded onto its stored state, and keys with late events are folded anew from the log.

    Log and states lie in buckets of entities; only touched buckets of states are read and written, and of the log only
    those with late events are read. Events without an entity are logged, and have no state. A bucket's newest epoch counts,
    the one before it stays until the next, so that a batch that is run again finds what it found. every: a processing-time
    trigger like "10 seconds"; what is there at once (availableNow) unless given. Returns the started query.
    """

    def put(rows: DataFrame, path: str, epoch: int) -> None:
        own = rows.withColumn("bucket", F.pmod(F.xxhash64("object_id"), F.lit(buckets)).cast("int")).withColumn("epoch", F.lit(epoch))
        own.repartition("bucket").write.partitionBy("bucket", "epoch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        put(batch, log_path, epoch)
        if not _exists(spark, log_path):
            return
        kept = spark.read.parquet(log_path)
        own = kept.where((F.col("epoch") == epoch) & F.col("object_id").isNotNull())
        hit = [r.bucket for r in own.select("bucket").distinct().collect()]
        if not hit:
            return
        if _exists(spark, states_path):
            old = current_states(spark, states_path, hit, epoch - 1)
            fresh = _refolded(kept.where(F.col("epoch") <= epoch), own.drop("epoch"), old)
        else:
            fresh = _with_last(kept.where(F.col("bucket").isin(hit) & (F.col("epoch") <= epoch) & F.col("object_id").isNotNull()).drop("bucket", "epoch"))
        put(fresh, states_path, epoch)
        done = spark.read.parquet(states_path).where(F.col("bucket").isin(hit)).select("bucket", "epoch").distinct().collect()
        for k in hit:
            for old in sorted(r.epoch for r in done if r.bucket == k and r.epoch <= epoch)[:-2]:
                _drop(spark, f"{states_path}/bucket={k}/epoch={old}")

    writer = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def fingerprint_stream(events: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """A stream of events (id, object_id) whose micro-batches leave the set hash of what each brought, below path by batch.

    A batch that is run again overwrites its own part, so nothing counts twice; parts are added when they are read, by
    current_fingerprints(), and no list of ids is ever kept. Returns the started query.
    """
    from ..operators import history

    def step(batch: DataFrame, epoch: int) -> None:
        history.set_hash(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = events.select("object_id", "id").writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def current_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """What fingerprint_stream() has seen of each entity so far."""
    from ..operators import history

    return history.added(spark.read.parquet(path).drop("epoch"))


def messages(events: DataFrame) -> DataFrame:
    """(key, value) of events as a message sink takes them: the entity, and the event as JSON. Works on streams; a Kafka writer takes it as it is."""
    return events.select(F.col("object_id").cast("string").alias("key"), F.to_json(F.struct(*events.columns)).alias("value"))
