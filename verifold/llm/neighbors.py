"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables, and an exact rerank.

A vector's direction is turned by fast Hadamard pseudo-rotations, three rounds of random signs and a Hadamard transform;
its hash is the signed axis nearest to the turned vector. A table joins two such hashes to one bucket. Every vector lies
in one bucket of each table; a query visits the buckets of a table in order of how far its turned vector is from their
axes, until they hold the rows of its budget, and what it finds is ranked by exact distances.

Distinct vectors are indexed once each, so that copies, however many, neither fill a bucket nor a budget; each carries the
smallest of its ids, as many as a result can name. Buckets are laid out in cells of a bounded number of vectors: small
buckets share one, a large bucket takes several, all of which are visited. Queries travel to the cells that they visit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frozen

TABLES = 2
#: Of a turned vector, so many axes count at most, so that a table has at most (2 * AXES) ** 2 buckets.
AXES = 64
#: A query's budget in vectors over all tables is FACTOR * n ** POWER, and never below LEAST: fitted on random directions,
#: which are the hardest, for a recall of 0.95; vectors with structure need less.
FACTOR, POWER, LEAST = 1.7, 0.88, 1000
#: Vectors in a cell, about, and queries that meet them in one task; with more queries, blocks of them meet the cell in turn.
CELL, ASKING = 4096, 16_384


def usable(vec: Column) -> Column:
    """Whether a vector takes part: it is neither null nor empty nor zero, and all of its components are finite."""
    v = vec.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def turned(vectors: np.ndarray, table: int, part: int) -> np.ndarray:
    """Unit vectors, filled up to a power of two and pseudo-rotated, as coordinates along the signed axes."""
    width = 1 << max(0, vectors.shape[1] - 1).bit_length()
    x = np.zeros((len(vectors), width))
    top = np.abs(vectors).max(axis=1, keepdims=True)  # first by the largest part, so that no square overflows
    x[:, : vectors.shape[1]] = vectors / top
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    signs = np.random.default_rng([width, table, part])
    for _ in range(3):
        x = _hadamard(x * signs.choice([-1.0, 1.0], width))
    x = x[:, :AXES]
    return np.concatenate([x, -x], axis=1)


def buckets(vectors: np.ndarray, table: int) -> np.ndarray:
    first, second = (np.argmax(turned(vectors, table, k), axis=1) for k in range(2))
    return first * min(2 * AXES, 2 << max(0, vectors.shape[1] - 1).bit_length()) + second


def visits(vectors: np.ndarray, table: int) -> np.ndarray:
    """Of each vector the table's buckets, those with the nearest axes first."""
    gaps = [(lambda x: (x.max(axis=1, keepdims=True) - x) ** 2)(turned(vectors, table, k)) for k in range(2)]
    return np.argsort((gaps[0][:, :, None] + gaps[1][:, None, :]).reshape(len(vectors), -1), axis=1, kind="stable")


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.asarray(pc.list_value_length(column))
    for n in np.unique(sizes):
        yield int(n), np.flatnonzero(sizes == n)


def distinct_vectors(vectors: DataFrame, most: int) -> DataFrame:
    """(ids, vec): every distinct usable vector with its `most` smallest ids. Spark prunes the copies before the shuffle."""
    key = F.xxhash64("vec")
    rows = vectors.where(usable(F.col("vec")) & F.col("id").isNotNull()).withColumn("_h", key)
    w = Window.partitionBy("_h", "vec").orderBy("id")
    few = rows.withColumn("_n", F.rank().over(w)).where(F.col("_n") <= most)
    return few.groupBy("_h", "vec").agg(F.slice(F.array_sort(F.collect_set("id")), 1, most).alias("ids")).select("ids", "vec")


class Layout:
    """Of each (length, table), by bucket: the first of its cells, how many cells it has, and how many vectors."""

    def __init__(self, sizes: dict[tuple[int, int], dict[int, int]], tables: int, cell: int):
        self.tables, self.first, self.parts, self.held, next_cell = tables, {}, {}, {}, 0
        for (length, table), found in sorted(sizes.items()):
            axes = min(2 * AXES, 2 << max(0, length - 1).bit_length())
            held = np.zeros(axes * axes, np.int64)
            for b, n in found.items():
                held[b] = n
            first, parts, room = np.zeros(len(held), np.int64), np.ones(len(held), np.int64), 0
            for b in np.flatnonzero(held):
                n = int(held[b])
                if n <= room:
                    first[b], room = next_cell - 1, room - n
                else:  # a new cell, or several for a large bucket
                    first[b], parts[b], room = next_cell, -(-n // cell), max(0, cell - n)
                    next_cell += int(parts[b])
            self.first[length, table], self.parts[length, table], self.held[length, table] = first, parts, held

    def budget(self, length: int) -> int:
        """Vectors that a query looks at in each table."""
        n = int(self.held[length, 0].sum())
        return -(-max(LEAST, int(FACTOR * n**POWER)) // self.tables)

    def share(self) -> float:
        """The largest share of the vectors of one length that a query looks at in a table."""
        return max((min(1.0, self.budget(n) / max(1, int(x.sum()))) for (n, t), x in self.held.items() if not t), default=0.0)


def _sizes(rows: DataFrame, tables: int) -> dict[tuple[int, int], dict[int, int]]:
    """How many vectors lie in each bucket: at most (2 * AXES) ** 2 buckets for each table and length of vectors."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], int] = {}
        for b in batches:
            for length, at in _by_length(b.column(0)):
                v = _matrix(b.column(0).take(pa.array(at)))
                for t in range(tables):
                    for bucket, n in zip(*np.unique(buckets(v, t), return_counts=True), strict=True):
                        key = (length, t, int(bucket))
                        total[key] = total.get(key, 0) + int(n)
        if total:
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in total], pa.int64()) for i in range(3)), pa.array(list(total.values()), pa.int64())], ["length", "t", "bucket", "n"])

    out: dict[tuple[int, int], dict[int, int]] = {}
    for r in rows.select("vec").mapInArrow(counted, "length long, t long, bucket long, n long").groupBy("length", "t", "bucket").agg(F.sum("n").alias("n")).collect():
        out.setdefault((r.length, r.t), {})[r.bucket] = r.n
    return out


def _placer(layout, tables: int) -> Callable:
    """Rows (ids, vec) in the cells of each table."""

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lay = layout.value
        for b in batches:
            for length, at in _by_length(b.column(1)):
                own = b.take(pa.array(at))
                v = _matrix(own.column(1))
                spread = np.array([ids[0] for ids in own.column(0).to_pylist()], np.int64)
                for t in range(tables):
                    bucket = buckets(v, t)
                    cell = lay.first[length, t][bucket] + spread % lay.parts[length, t][bucket]
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(bucket), *own.columns], ["cell", "bucket", "ids", "vec"])

    return placed


def _visitor(layout, tables: int) -> Callable:
    """Queries (id, vec) in the cells that they visit, with the buckets that they visit there."""

    def visiting(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lay = layout.value
        for b in batches:
            for length, at in _by_length(b.column(1)):
                if (length, 0) not in lay.held:
                    continue
                for k in range(0, len(at), 64):  # the orders of some queries at a time
                    own = b.take(pa.array(at[k : k + 64]))
                    v = _matrix(own.column(1))
                    who, cells, marks = [], [], []
                    for t in range(tables):
                        held, first, parts = lay.held[length, t], lay.first[length, t], lay.parts[length, t]
                        for q, order in enumerate(visits(v, t)):
                            seen = np.cumsum(held[order])
                            order = order[: 1 + int(np.searchsorted(seen, min(lay.budget(length), seen[-1])))]
                            order = np.sort(order[held[order] > 0]).astype(np.int32)  # buckets of one cell stand together
                            for inside in np.split(order, 1 + np.flatnonzero(np.diff(first[order]))):
                                for c in range(int(first[inside[0]]), int(first[inside[0]] + parts[inside[0]])):
                                    who.append(q), cells.append(c), marks.append(inside.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(marks, pa.binary()), *own.take(pa.array(who, pa.int64())).columns], ["cell_q", "marks", "query_id", "vec_q"])

    return visiting


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    away = np.abs(x - q)
    with np.errstate(over="ignore", under="ignore"):
        d = np.sqrt((away**2).sum(axis=1))
        odd = np.flatnonzero(~((d > 1e-150) & (d < 1e150)))  # squares that left the range of doubles
        top = away[odd].max(axis=1)
        d[odd] = top * np.sqrt(((away[odd] / np.where(top > 0, top, 1)[:, None]) ** 2).sum(axis=1))
    return d


def _reranker(most: int) -> Callable:
    def rerank(rows: pa.Table, asks: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not rows.num_rows or not asks.num_rows:
            return empty
        rows, asks = rows.combine_chunks(), asks.combine_chunks()
        x, ids, bucket = _matrix(rows.column(2).chunk(0)), rows.column(3).to_pylist(), rows.column(1).to_numpy()
        q, names, marks = _matrix(asks.column(3).chunk(0)), asks.column(2).to_pylist(), asks.column(1).to_pylist()
        out: list[tuple[int, int, float]] = []
        for k, name in enumerate(names):
            near = np.flatnonzero(np.isin(bucket, np.frombuffer(marks[k], np.int32)))
            d = _distances(x[near], q[k])
            best: dict[int, float] = {}
            for j in np.argsort(d, kind="stable"):
                if len(best) >= most and d[j] > limit:
                    break
                for i in ids[near[j]]:
                    if i != name:
                        best.setdefault(i, float(d[j]))
                if len(best) >= most:
                    limit = d[j]  # what is as near still counts, as ties go to the smaller id
            out += [(name, i, s) for s, i in sorted((s, i) for i, s in best.items())[:most]]
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    return rerank


def nearest(vectors: DataFrame, queries: DataFrame, most: int = 10, tables: int = TABLES, cell: int = CELL) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query (id, vec) the `most` nearest of vectors (id, vec) found, by Euclidean distance.

    Ids are longs. A query's candidates are all vectors of another id and of its length; ties go to the smaller id. Rows
    with a null id or a vector that isn't usable() take no part, as queries neither. Repeated rows count once; rows that
    share an id are one item, whose nearest vector counts, and as queries one query. With fewer than LEAST vectors of a
    length all are looked at, so that the result is exact. Directions are hashed: where lengths of vectors differ much,
    recall is of neighbours with a direction like the query's. An empty side gives no rows.
    """
    spark = vectors.sparkSession
    rows = frozen(distinct_vectors(vectors.select(F.col("id").cast("long").alias("id"), "vec"), most + 1), "vectors")
    sizes = _sizes(rows, tables)
    laid = Layout(sizes, tables, cell)
    layout = spark.sparkContext.broadcast(laid)
    kind = rows.schema["vec"].dataType.simpleString()
    asks = queries.where(usable(F.col("vec")) & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("vec").cast(kind).alias("vec")).distinct()
    blocks = max(1, math.ceil(asks.count() * laid.share() / ASKING))
    index = rows.mapInArrow(_placer(layout, tables), f"cell long, bucket long, ids array<bigint>, vec {kind}").select("cell", "bucket", "vec", "ids", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    there = asks.mapInArrow(_visitor(layout, tables), f"cell_q long, marks binary, query_id long, vec_q {kind}").withColumn("block_q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    found = index.groupBy("cell", "block").cogroup(there.groupBy("cell_q", "block_q")).applyInArrow(_reranker(most), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")
