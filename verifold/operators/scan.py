"""Ordered operators whose groups may be of any size: rows are sorted by ranges, cut into runs, and runs hand on what follows needs.

A run is a bounded number of neighbours in the order of (keys, time), so one entity with most of the log is many runs of
work for many tasks. What a run hands on is one row per run at its edges: an associative summary, combined over runs by
windows on a table that is smaller by the size of a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.order import numbered
from ..sources.shared import frozen
from . import state

#: Rows in a run.
RUN = 4096
KEYS = ("object_id", "key")


def in_runs(rows: DataFrame, order: list[Column], run: int = RUN) -> DataFrame:
    """rows with position in the order and run, the number of their run."""
    return numbered(rows, order).withColumn("run", F.floor(F.col("position") / run))


def _resets(rows: DataFrame, run: int) -> DataFrame:
    """Long-form rows in runs with reset, as state.segments() has it: what came before a run's first row is the last row of the run before."""
    placed = in_runs(rows, [F.col("object_id"), F.col("key"), F.col("timestamp"), F.col("id")], run)
    inside = Window.partitionBy("run").orderBy("position")
    own = F.struct("object_id", "key", "num")
    ends = placed.groupBy("run").agg(F.max_by(own, "position").alias("_end")).select((F.col("run") + 1).alias("_next"), "_end")
    before = placed.withColumn("_before", F.lag(own).over(inside)).join(ends, F.col("run") == F.col("_next"), "left")
    known = F.coalesce("_before", "_end")
    same = F.coalesce((known["object_id"] == F.col("object_id")) & (known["key"] == F.col("key")), F.lit(False))
    reset = F.col("num").isNull() | ~same | known["num"].isNull() | F.col("action").isin(*state.REPLACES)
    marked = before.withColumn("reset", reset)
    part = F.when(F.col("reset"), F.col("num")).when(F.col("action") == "REMOVE", -F.col("num")).otherwise(F.col("num"))
    return marked.withColumn("part", part).drop("_before", "_end", "_next")


def _summaries(marked: DataFrame) -> DataFrame:
    """Per entity, key and run: whether it has a reset, and sum, number and text of the rows from its last reset on, or of all."""
    w = Window.partitionBy("run", *KEYS).orderBy("position")
    later = marked.withColumn("_left", F.sum(F.col("reset").cast("int")).over(w.rowsBetween(1, Window.unboundedFollowing)))
    tail = later.where(F.coalesce("_left", F.lit(0)) == 0)
    return tail.groupBy(*KEYS, "run").agg(F.max("reset").alias("cut"), F.sum("part").alias("total"), F.count(F.lit(1)).alias("n"), F.max("raw").alias("raw"))


def fold(rows: DataFrame, run: int = RUN) -> DataFrame:
    """(object_id, key, num, raw) as state.fold() gives it, an entity's rows spread over as many tasks as they have runs.

    A summary (cut, total, n) combines with the next as (cut or next's cut, next's total, plus its own unless that cuts).
    """
    parts = _summaries(_resets(rows, run))
    w = Window.partitionBy(*KEYS)
    last = parts.withColumn("_last", F.max(F.when(F.col("cut"), F.col("run"))).over(w)).where("run >= _last")
    return last.groupBy(*KEYS).agg(F.sum("total").alias("num"), F.when(F.sum("n") == 1, F.max("raw")).alias("raw"))


def timeline(rows: DataFrame, run: int = RUN) -> DataFrame:
    """rows with state, the number that the key holds after each of them, as state.timeline() gives it."""
    marked = frozen(_resets(rows, run), "resets")
    parts = _summaries(marked)
    w = Window.partitionBy(*KEYS).orderBy("run")
    grouped = parts.withColumn("_g", F.sum(F.col("cut").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    running = F.sum("total").over(Window.partitionBy(*KEYS, "_g").orderBy("run").rowsBetween(Window.unboundedPreceding, 0))
    handed = grouped.withColumn("_sum", running).withColumn("_carry", F.lag("_sum").over(w)).select(*[F.col(c).alias("_" + c) for c in (*KEYS, "run")], "_carry")
    inside = Window.partitionBy("run", *KEYS).orderBy("position")
    cut = marked.withColumn("_seg", F.sum(F.col("reset").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.sum("part").over(Window.partitionBy("run", *KEYS, "_seg").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    met = cut.withColumn("_own", own).join(handed, (F.col("run") == F.col("_run")) & (F.col("object_id") == F.col("_object_id")) & (F.col("key") == F.col("_key")), "left")
    value = F.col("_own") + F.when(F.col("_seg") == 0, F.coalesce("_carry", F.lit(0.0))).otherwise(F.lit(0.0))
    return met.withColumn("state", F.when(F.col("num").isNotNull(), value)).select(*rows.columns, "state")


def as_of(probes: DataFrame, facts: DataFrame, by: str = "object_id", at: str = "timestamp", inclusive: bool = False, run: int = RUN) -> DataFrame:
    """Each probe with fact, the latest row of facts of its `by` before its time, or at it if inclusive; null where there is none.

    Probes and facts are sorted together and the last fact seen is carried along, within a run and from run to run, so that
    the work is one sort however many facts an entity has. Of facts of one time the one that is last by all its columns
    counts. Probes without a key or a time have no fact; facts without one are nobody's. Both sides keep repeated rows.
    """
    rest = [c for c in facts.columns if c != by]
    one = probes.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(0 if not inclusive else 2).alias("_side"), F.struct(*probes.columns).alias("_probe"))
    two = facts.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(at, *[c for c in rest if c != at]).alias("_fact"))
    both = one.unionByName(two, allowMissingColumns=True)
    placed = in_runs(both, [F.col("_by"), F.col("_at"), F.col("_side"), F.col("_fact")], run)
    inside = Window.partitionBy("run", "_by").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    seen = placed.withColumn("_seen", F.last("_fact", ignorenulls=True).over(inside))
    # only an entity that begins a run can have facts in runs before it, and these are at the end of those
    edges = placed.groupBy("run").agg(F.min_by(F.struct("_by"), "position")["_by"].alias("_first"), F.max_by(F.struct("_by"), "position")["_by"].alias("_last"))
    ends = placed.where("_fact IS NOT NULL").groupBy("run", "_by").agg(F.max_by("_fact", "position").alias("_end"))
    carried = Window.partitionBy("_by").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    marks = edges.select("run", F.explode(F.array_distinct(F.array("_first", "_last"))).alias("_by")).where("_by IS NOT NULL")
    handed = marks.join(ends, ["run", "_by"], "left").withColumn("_carry", F.last("_end", ignorenulls=True).over(carried)).where("_carry IS NOT NULL").select(F.col("run").alias("_run"), F.col("_by").alias("_key"), "_carry")
    met = seen.where("_side <> 1").join(handed, (F.col("run") == F.col("_run")) & (F.col("_by") == F.col("_key")), "left")
    known = F.when(F.col("_by").isNotNull() & F.col("_at").isNotNull(), F.coalesce("_seen", "_carry"))
    return met.select("_probe.*", known.alias("fact"))
