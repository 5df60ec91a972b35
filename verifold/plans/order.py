"""A total order over a table without a task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import frozen


def numbered(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """rows with their position from 0 in an order, which should be total: a range sort numbers them within partitions, and
    a partition begins where those before it end, of which there are no more than partitions."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = frozen(rows.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("_numbered", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_numbered", 33).cast("int")
    before, first = 0, []
    for r in sorted(laid.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        first.append((r.part, before))
        before += r.n
    if not first:
        return laid.withColumn(name, F.lit(None).cast("long")).drop("_numbered")
    starts = laid.sparkSession.createDataFrame(first, "_numbered_part int, _numbered_first long")
    return laid.join(F.broadcast(starts), part == F.col("_numbered_part")).withColumn(name, F.col("_numbered_first") + F.col("_numbered").bitwiseAND((1 << 33) - 1)).drop("_numbered", "_numbered_part", "_numbered_first")
