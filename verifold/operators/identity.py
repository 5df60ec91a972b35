"""Entities, similarity, duplicate proposals and merges."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.order import numbered
from ..sources.shared import frozen

DIMENSIONS = 1536
#: So many vectors of a type meet in one task on each side at least; of short vectors more, up to so many components, as what
#: is sent grows with the square of the number of blocks. A task holds so many products at once.
BLOCK, COMPONENTS, PRODUCTS = 2048, 1 << 22, 1 << 21
#: Vectors whose angles to all others prune pairs of blocks, and the steps that an angle is taken in.
PIVOTS, STEPS = 32, 128
#: What a cosine may lose to doubles.
ROUNDING = 1e-12


def hash_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """The MD5 bytes of a text, repeated to the length asked for, each as byte / 128 - 1."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    sixteen = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 128 - 1)
    return F.slice(F.flatten(F.array_repeat(sixteen, -(-dimensions // 16))), 1, dimensions)


def entity_text(name: Column, kind: Column, attributes: Column) -> Column:
    return F.concat(name, F.lit(": "), kind, F.lit(" "), F.coalesce(attributes, F.lit("{}")))


def create_entities(rows: DataFrame, at: Column, dimensions: int = DIMENSIONS) -> DataFrame:
    """Entities of (name, entity_type, attributes) with ids by content and embeddings of name, type and attributes."""
    return rows.select(
        F.sha2(F.concat_ws("\x1f", "name", "entity_type", "attributes"), 256).alias("id"), F.lit("user").alias("namespace"), "entity_type", "name", "attributes",
        at.alias("created_at"), at.alias("updated_at"), F.lit(None).cast("string").alias("merged_into"),
        hash_embedding(entity_text(F.col("name"), F.col("entity_type"), F.col("attributes")), dimensions).alias("embedding"),
    )


def active(entities: DataFrame, kind: str | None = None) -> DataFrame:
    """Entities that were not merged, of one type or all."""
    found = entities.where(F.col("merged_into").isNull())
    return found if kind is None else found.where(F.col("entity_type") == kind)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of one length, in doubles; null for a zero vector."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def comparable(vectors: DataFrame, number: str = "double") -> DataFrame:
    """(kind, size, id, vec) of vectors (id, kind, vec) that can be compared: with an id, not empty, every component finite.

    size is the number of components; vectors of different sizes, as two models make them, never meet.
    """
    vec = F.col("vec").cast(f"array<{number}>")
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("id").isNotNull() & (F.size("vec") > 0) & F.coalesce(sound, F.lit(False))).select("kind", F.size("vec").alias("size"), "id", vec.alias("vec"))


def unsound(vectors: DataFrame) -> DataFrame:
    """The rows that comparable() leaves out, null and empty vectors among them, for a report."""
    vec = F.col("vec").cast("array<double>")
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(~(F.col("id").isNotNull() & F.coalesce((F.size("vec") > 0) & sound, F.lit(False))))


def _raw(vectors: pa.Array) -> np.ndarray:
    """Vectors of one size as rows of numbers as they come."""
    return pc.list_flatten(vectors).to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


class Units:
    """Rows of numbers whose units are made where they are used, so that a task holds no doubles of all of them."""

    def __init__(self, raw: np.ndarray):
        self.raw, self.step = raw, max(1, PRODUCTS // raw.shape[1])
        self.top, self.norm = np.zeros((2, len(raw), 1))
        for k in range(0, len(raw), self.step):
            part = raw[k : k + self.step].astype(np.float64)
            top = np.abs(part).max(axis=1, keepdims=True)  # first by the largest part, so that no square leaves the range of doubles
            top[top == 0] = 1
            self.top[k : k + self.step], norm = top, np.linalg.norm(part / top, axis=1, keepdims=True)
            self.norm[k : k + self.step] = np.where(norm > 0, norm, 1)

    def of(self, rows: np.ndarray | slice) -> np.ndarray:
        """Rows of length 1; a zero vector stays zero."""
        return self.raw[rows].astype(np.float64) / self.top[rows] / self.norm[rows]

    def parts(self) -> Iterator[np.ndarray]:
        return (self.of(slice(k, k + self.step)) for k in range(0, len(self.raw), self.step))

    def singles(self) -> np.ndarray:
        out, at = np.empty(self.raw.shape, np.float32), 0
        for part in self.parts():
            out[at : at + len(part)] = part
            at += len(part)
        return out


def _units(vectors: pa.Array) -> np.ndarray:
    """Vectors of one size as rows of length 1; a zero vector stays zero."""
    return Units(_raw(vectors)).of(slice(None))


def _half_up(v: np.ndarray, digits: int) -> np.ndarray:
    """v rounded as Spark and SQL do, times 10 ** digits."""
    return np.sign(v) * np.floor(np.abs(v) * 10.0**digits + 0.5)


def _dots(a: Units, b: Units, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of units i of a with units j of b, a bounded part at a time."""
    parts = [np.einsum("ij,ij->i", a.of(i[k : k + a.step]), b.of(j[k : k + a.step])) for k in range(0, len(i), a.step)]
    return np.concatenate(parts) if parts else np.empty(0)


def _spans(units: Units, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of the pivots they are near, and the least and largest angles to each pivot of every BLOCK of them."""
    angle = np.concatenate([np.arccos(np.clip(part @ pivots.T, -1, 1)) for part in units.parts()])
    order = np.lexsort((angle.min(axis=1), *np.argsort(angle, axis=1, kind="stable")[:, 1::-1].T))
    cuts = np.arange(0, len(order), BLOCK)
    return order, np.minimum.reduceat(angle[order], cuts), np.maximum.reduceat(angle[order], cuts)


def _once(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose products are those of x and y, with columns that repeat on both sides held once, times the root of their number."""
    same: dict[bytes, list[int]] = {}
    for c in range(x.shape[1] if len(x) * len(y) > PRODUCTS else 0):
        same.setdefault(x[:16, c].tobytes() + y[:16, c].tobytes(), []).append(c)
    if not same or len(same) > x.shape[1] // 2:
        return x, y
    first = {}  # a column, and the earlier one that it repeats
    for columns in same.values():
        for c in columns:
            first[c] = next((o for o in columns if first.get(o) == o and np.array_equal(x[:, o], x[:, c]) and np.array_equal(y[:, o], y[:, c])), c)
    kept, count = np.unique([first[c] for c in range(x.shape[1])], return_counts=True)
    return x[:, kept] * np.sqrt(count).astype(np.float32), y[:, kept] * np.sqrt(count).astype(np.float32)


def _true(marks: np.ndarray) -> np.ndarray:
    """Where marks, few of them, are true: eight are looked at at once."""
    whole = len(marks) // 8 * 8
    some = (np.flatnonzero(marks[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([some[marks[some]], np.flatnonzero(marks[whole:]) + whole])


def _above(x: np.ndarray, rows: np.ndarray, y: np.ndarray, least: float, most: int | None, slack: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows of x after others, and which of them have a product of `least` or more with which rows of y.

    Where only the best count, those below a row's `most`-th best so far, less a slack, are left out: y is met in spans, each
    four times as long as all before it, so that few products above the bound of the spans before are not above the last.
    """
    if most is None:
        step = max(1, PRODUCTS // len(y))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            yield part, *np.nonzero(x[part] @ y.T >= least)
        return
    wide = min(len(y), max(BLOCK, 2 * most))
    high = max(1, PRODUCTS // 8 // wide)
    room = np.empty(min(high, len(rows)) * wide, np.float32)
    for at in range(0, len(rows), high):
        part = rows[at : at + high]
        own, bound = x[part], np.full(len(part), least, np.float32)
        i, j, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        due = 0
        for a in range(0, len(y), wide):
            across = min(wide, len(y) - a)
            products = np.matmul(own, y[a : a + across].T, out=room[: len(part) * across].reshape(len(part), across))
            if not a and across > most:
                kth = np.partition(products, across - most, axis=1)[:, across - most]
                bound = np.maximum(bound, kth - np.float32(slack))
            some = np.flatnonzero(products.max(axis=1) >= bound)
            flat = _true((products[some] >= bound[some, None]).ravel())
            i, j, s = np.concatenate([i, some[flat // across]]), np.concatenate([j, flat % across + a]), np.concatenate([s, products[some[flat // across], flat % across]])
            due += 1
            if due >= 4 * (a // wide + 1 - due) or a + wide >= len(y):
                order = np.lexsort((-s, i))
                i, j, s = i[order], j[order], s[order]
                start = np.searchsorted(i, np.arange(len(part) + 1))
                full = np.flatnonzero(np.diff(start) >= most)
                bound[full] = np.maximum(bound[full], s[start[full] + most - 1] - np.float32(slack))
                good = s >= bound[i]
                i, j, s, due = i[good], j[good], s[good], 0
        yield part, i, j


def _matched(threshold: float, most: int | None, digits: int = 12, pivots: dict[int, np.ndarray] | None = None):
    names = ["left_id", "right_id", "similarity"]
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = (t.rename_columns(["id", "vec", "block", "other"]) for t in (left, right))
        a, b = (t.column("id").combine_chunks() for t in (left, right))
        if not len(a) or not len(b):
            return pa.table([a.slice(0, 0), b.slice(0, 0), pa.array([], pa.float64())], names)
        place = None
        if most is not None:  # of ids in order, for ties
            place = np.empty(len(b), np.int64)
            place[pc.sort_indices(b).to_numpy()] = np.arange(len(b))
        x, y = (Units(_raw(t.column("vec").combine_chunks())) for t in (left, right))
        del left, right
        size = x.raw.shape[1]
        slack = 1e-6 + 2.5e-7 * size  # what products of singles may be off by
        x32, y32 = _once(x.singles(), y.singles())
        if pivots:  # blocks of neighbours within the task, of which the triangle inequality rules pairs out
            own = pivots[size]
            (order_x, low, high), (order_y, low_r, high_r) = _spans(x, own), _spans(y, own)
            near = ((high[:, None] + reach >= low_r) & (high_r + reach >= low[:, None])).all(axis=2)
            pieces = ((order_x[n * BLOCK : (n + 1) * BLOCK], order_y[np.repeat(hit, BLOCK)[: len(order_y)]]) for n, hit in enumerate(near))
        else:
            pieces = iter([(np.arange(len(a)), None)])
        found = []
        for rows, cols in pieces:
            side = y32 if cols is None else y32[cols]
            if not len(side):
                continue
            for part, i, j in _above(x32, rows, side, threshold - slack, most, 2 * slack + 10.0**-digits):
                i, j = part[i], j if cols is None else cols[j]
                v = _dots(x, y, i, j)
                i, j, v = (z[v >= threshold - ROUNDING] for z in (i, j, v))
                if most is not None:  # of a left vector, no more hits than it may keep in the end; ties by the smaller id
                    order = np.lexsort((place[j], -_half_up(v, digits), i))
                    i, j, v = i[order], j[order], v[order]
                    nth = np.arange(len(i)) - np.searchsorted(i, i)
                    i, j, v = i[nth < most], j[nth < most], v[nth < most]
                found.append((i.astype(np.int32), j.astype(np.int32), v))
        i, j, v = (np.concatenate(z) for z in zip(*found)) if found else (np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0))
        return pa.table([a.take(pa.array(i)), b.take(pa.array(j)), pa.array(v)], names)

    return run


def _angles(pivots: dict[int, np.ndarray]):
    """Rows with their angles to the pivots of their size, the two nearest of them as a cell, and a step of the angle to the nearest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("size").to_numpy()
            for n in np.unique(size):
                own = b.take(pa.array(np.flatnonzero(size == n)))
                angle = np.arccos(np.clip(_units(own.column("vec")) @ pivots[int(n)].T, -1, 1))
                first, second = np.argsort(angle, axis=1, kind="stable")[:, :2].T
                cell, step = first * PIVOTS + second, (angle[np.arange(len(first)), first] * (STEPS / np.pi)).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(angle) + 1) * angle.shape[1], pa.int32()), pa.array(angle.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([*own.columns, flat, pa.array(cell.astype(np.int32)), pa.array(step)], [*own.schema.names, "angles", "cell", "step"])

    return run


def _blocks(marked: DataFrame, block: int) -> DataFrame:
    """marked rows with block, the name of their block within (kind, size), of about so many vectors at most.

    A cell of a quarter of a block or more has blocks of its own, by steps, so that their spans of angles stay narrow; smaller
    cells share blocks. A step of more vectors than a block holds is dealt out by ids. The table of steps is small.
    """
    steps = marked.groupBy("kind", "size", "cell", "step").agg(F.count(F.lit(1)).alias("_n"))
    own = F.sum("_n").over(Window.partitionBy("kind", "size", "cell")) >= block / 4
    upto = F.sum("_n").over(Window.partitionBy("kind", "size", "_own", F.when(F.col("_own"), F.col("cell"))).orderBy("cell", "step").rowsBetween(Window.unboundedPreceding, 0))
    laid = steps.withColumn("_own", own).withColumn("_b", F.floor((upto - F.col("_n")) / block)).withColumn("_parts", F.ceil(F.col("_n") / block))
    same = F.col("m.kind").eqNullSafe(F.col("l.kind")) & (F.col("m.size") == F.col("l.size")) & (F.col("m.cell") == F.col("l.cell")) & (F.col("m.step") == F.col("l.step"))
    dealt = F.when(F.col("l._parts") > 1, F.concat_ws(".", "l.cell", "l.step", F.pmod(F.xxhash64("m.id"), F.col("l._parts"))))
    return marked.alias("m").join(laid.alias("l"), same).select("m.*", F.concat_ws("/", F.when(F.col("l._own"), F.col("l.cell").cast("string")).otherwise("*"), "l._b", dealt).alias("block"))


def _bounds(blocks: DataFrame, pivots: int) -> DataFrame:
    ends = [f(F.get("angles", F.lit(i))).alias(f"{n}{i}") for i in range(pivots) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    return blocks.groupBy("kind", "size", "block").agg(F.count(F.lit(1)).alias("vectors"), *ends)


def _block_pairs(one: DataFrame, two: DataFrame, pivots: int, angle: float) -> DataFrame:
    """(block, other, near) of blocks of one kind and size. By the triangle inequality no two vectors are within an angle if
    their angles to some pivot differ by more; near tells whether the blocks' spans of angles let any pair be."""
    near = F.lit(True)
    for i in range(pivots):
        near = near & (F.col(f"a.hi{i}") + angle >= F.col(f"b.lo{i}")) & (F.col(f"b.hi{i}") + angle >= F.col(f"a.lo{i}"))
    met = _bounds(one, pivots).alias("a").join(_bounds(two, pivots).alias("b"), F.col("a.kind").eqNullSafe(F.col("b.kind")) & (F.col("a.size") == F.col("b.size")))
    return met.select(F.col("a.kind").alias("kind"), F.col("a.size").alias("size"), F.col("a.block").alias("block"), F.col("b.block").alias("other"), near.alias("near"))


def block_for(n: int, size: int) -> int:
    """Vectors of a block among n vectors of so many components: a sixteenth of them, as far as a task can hold it."""
    return max(BLOCK, min(n // 16, COMPONENTS // max(size, 1)))


def _laid_out(left: DataFrame, right: DataFrame, threshold: float, block: int | None, pivots: int) -> tuple[DataFrame, DataFrame, DataFrame, dict[int, np.ndarray]]:
    """Both sides in blocks, the pairs of blocks, and the pivots by size."""
    # numbers that are singles on both sides are sent and held as such; they become doubles where they are multiplied
    number = "float" if all(side.schema["vec"].dataType.simpleString() == "array<float>" for side in (left, right)) else "double"
    one, two = comparable(left, number), comparable(right, number)
    if block is None:
        block = block_for(*two.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(1))).first())
    angle = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    # pivots are a few vectors of each size, whatever their kind; below a right angle all pairs of blocks may matter
    chosen: dict[int, list] = {}
    if angle < math.pi / 2:
        w = Window.partitionBy("size").orderBy(F.xxhash64("vec"), "vec")
        nonzero = two.where(F.exists("vec", lambda x: x != 0)).select("size", "vec")
        for r in nonzero.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= pivots).collect():
            chosen.setdefault(r["size"], []).append(r.vec)
    count, known = pivots if chosen else 0, {}
    if not chosen:
        flat = [F.array().cast("array<float>").alias("angles"), F.lit(0).alias("cell"), F.pmod(F.xxhash64("id"), F.lit(STEPS)).cast("int").alias("step")]
        marked = [side.select("*", *flat) for side in (one, two)]
    else:
        # with fewer vectors than pivots the first is a pivot again; sizes that only one side has meet nothing
        known = {n: _units(pa.array((v * pivots)[:pivots])) for n, v in chosen.items()}
        schema = lambda side: f"kind {side.schema['kind'].dataType.simpleString()}, size int, id {side.schema['id'].dataType.simpleString()}, vec array<{number}>, angles array<float>, cell int, step int"
        marked = [frozen(side.where(F.col("size").isin(list(known))).mapInArrow(_angles(known), schema(side)), "angles") for side in ((one,) if left is right else (one, two))]
    blocks = [_blocks(m, block) for m in marked]
    blocks = blocks * 2 if len(blocks) == 1 else blocks
    return blocks[0], blocks[1], _block_pairs(blocks[0], blocks[1], count, angle), known


def block_counts(left: DataFrame, right: DataFrame, threshold: float, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """One row: how many pairs of blocks there are, and how many similar() visits."""
    return _laid_out(left, right, threshold, block, pivots)[2].agg(F.count(F.lit(1)).alias("pairs"), F.count_if("near").alias("visited"))


def similar(left: DataFrame, right: DataFrame, threshold: float, most: int | None = None, block: int | None = None, pivots: int = PIVOTS, digits: int = 12) -> DataFrame:
    """(left_id, right_id, similarity) of vectors (id, kind, vec) of one kind and size at a cosine of the threshold or above.

    Vectors of a kind and size stand in blocks of neighbours, by their angles to a few pivots; pairs of blocks that the
    triangle inequality rules out are not visited, any other is one task's matrix products, and only pairs at the threshold
    leave it, at most `most` per left vector, the best by the cosine at so many digits, ties by the smaller id. Ids may be of any type. Vectors that are null, empty or hold a null or a
    number that isn't finite match nothing; a zero vector has similarity 0 to all; null kinds are one kind; repeated rows
    match as often as they come. The result is exact, the cosine as it is, not rounded.
    """
    one, two, pairs, known = _laid_out(left, right, threshold, block, pivots)
    near = frozen(pairs.where("near").select("kind", "size", "block", "other", F.concat_ws("|", "kind", "size", "block", "other").alias("pair")), "block-pairs")

    def sent(side: DataFrame, own: str) -> DataFrame:
        same = F.col("v.kind").eqNullSafe(F.col("p.kind")) & (F.col("v.size") == F.col("p.size")) & (F.col("v.block") == F.col(f"p.{own}"))
        return side.alias("v").join(near.alias("p"), same).select("v.id", "v.vec", F.concat_ws("|", "p.size", "p.block", "p.other").alias("block"), F.col("p.kind").alias("other"))

    kinds = f"left_id {left.schema['id'].dataType.simpleString()}, right_id {right.schema['id'].dataType.simpleString()}, similarity double"
    # named anew, so that both sides may come from one frame
    a, b = sent(one, "block"), sent(two, "other").toDF("id_r", "vec_r", "block_r", "other_r")
    return a.groupBy("block", "other").cogroup(b.groupBy("block_r", "other_r")).applyInArrow(_matched(threshold, most, digits, known), kinds)


def duplicate_pairs(entities: DataFrame, threshold: float = 0.95, top: int = 5) -> DataFrame:
    """Proposals from entities (id, kind, name, created_at, vec): of each entity's `top` most similar of its type, itself among them, the others.

    Ranks go by the cosine as it is, but for what doubles leave of equal ones. The newer of the two is the source, the older
    the target; at one time the hit is the source. Rows that repeat are met once, but take ranks as often as they come: a hit
    takes one for each two rows of its ends, the entity itself the first. While vectors meet, numbers in order of the ids stand
    for these, as ids may be long texts. Of rows of one id and vector with other names or times, the least of these count.
    """
    once = entities.where(F.col("id").isNotNull()).groupBy("id", "kind", "vec").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("name", "created_at")).alias("_f"))
    rows = frozen(numbered(once, [F.asc("id"), F.asc("kind"), F.asc("vec")]), "entities")
    vectors = rows.select(F.col("position").alias("id"), "kind", "vec")
    hits = similar(vectors, vectors, threshold, top).where("left_id <> right_id").toDF("_l", "_r", "similarity")
    w = Window.partitionBy("_l").orderBy(F.desc(F.round("similarity", 12)), "_r")
    near = hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") < top).drop("_n")
    facts = lambda e: rows.select(F.col("position").alias(f"_{e}"), F.col("id").alias(f"{e}_id"), F.col("copies").alias(f"_{e}c"), F.col("_f.name").alias(f"_{e}n"), F.col("_f.created_at").alias(f"_{e}t"))
    both = near.join(facts("l"), "_l").join(facts("r"), "_r").withColumnsRenamed({"l_id": "left_id", "r_id": "right_id"}).where("left_id <> right_id")
    if not rows.where("copies > 1").isEmpty():
        before = F.coalesce(F.sum(F.col("_lc") * F.col("_rc")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        both = both.withColumn("_n", F.col("_lc") * F.col("_lc") + before).where(F.col("_n") < top)
    newer = F.col("_lt") > F.col("_rt")
    same = F.lower("_ln") == F.lower("_rn")
    return both.select(
        "left_id", "right_id", "similarity", F.when(newer, F.col("left_id")).otherwise(F.col("right_id")).alias("source_id"), F.when(newer, F.col("right_id")).otherwise(F.col("left_id")).alias("target_id"),
        F.concat(F.format_string("Vector similarity %.4f", "similarity"), F.when(same, " + Exact name match").otherwise("")).alias("reason"), F.col("_lt").alias("left_at"),
    )


def greedy(pairs: DataFrame) -> DataFrame:
    """Proposals that a sequential scan in order of left_at and left_id emits: both entities of a proposal are done with.

    What is done with neither scans nor is hit again, but an entity that is scanning goes on through its hits, the most
    similar first. The scan is sequential by nature, so each connected group of pairs is scanned by itself; groups are
    found from the pairs alone, which are few beside the entities.
    """
    from ..plans.graphs import components

    groups = components(pairs.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")))
    names = ["left_id", "right_id", "similarity", "source_id", "target_id", "reason"]

    def scan(f: pd.DataFrame) -> pd.DataFrame:
        done, out = set(), []
        for (_, left), own in f.sort_values(["left_at", "left_id", "similarity", "right_id"], ascending=[True, True, False, True]).groupby(["left_at", "left_id"], sort=True):
            if left in done:
                continue
            for row in own.itertuples(index=False):
                if row.right_id not in done:
                    out.append(row)
                    done |= {row.source_id, row.target_id}
        return pd.DataFrame(out, columns=f.columns)[names] if out else f.iloc[:0][names]

    return pairs.join(groups.select(F.col("node").alias("left_id"), "root"), "left_id").groupBy("root").applyInPandas(scan, ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in names))


def entity(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """The entities among ids (rows id), merged ones included; unknown ids give no row."""
    return entities.join(ids.select("id").distinct(), "id", "left_semi")


def band(similarity: Column, merge: float = 0.95, review: float = 0.85) -> Column:
    """auto above the merge bound, review down to the review bound, else reject."""
    return F.when(similarity > merge, "auto").when(similarity >= review, "review").otherwise("reject")


def merge(entities: DataFrame, proposals: DataFrame, at: Column) -> DataFrame:
    """entities with sources pointing at their targets; of several proposals for a source, the most similar, then the smallest target, counts."""
    best = proposals.groupBy(F.col("source_id").alias("_s")).agg(F.min_by("target_id", F.struct(-F.col("similarity"), "target_id")).alias("_t"))
    joined = entities.join(best, F.col("id") == F.col("_s"), "left")
    return joined.withColumn("merged_into", F.coalesce("_t", "merged_into")).withColumn("updated_at", F.when(F.col("_t").isNotNull(), at).otherwise(F.col("updated_at"))).drop("_s", "_t")


def live_vectors(vectors: DataFrame, entities: DataFrame) -> DataFrame:
    """vectors (id, …) without those of entities that were merged into others."""
    return vectors.join(entities.where(F.col("merged_into").isNotNull()).select("id"), "id", "left_anti")


def merge_log(proposals: DataFrame, at: Column) -> DataFrame:
    return proposals.select("source_id", "target_id", F.col("similarity").alias("confidence"), "reason", at.alias("timestamp"))


def canonical(merges: DataFrame, max_rounds: int = 32) -> DataFrame:
    """(id, canonical_id) for rows (id, merged_into): the end of each chain, by doubling the pointers. Chains that close end at their smallest id."""
    merges = frozen(merges.select("id", "merged_into"), "merges")
    at = merges.where("merged_into is not null").select("id", F.col("merged_into").alias("to"))
    size = at.count()
    for _ in range(min(max_rounds, max(1, size).bit_length() + 1)):
        at = frozen(at.join(at.select(F.col("id").alias("_i"), F.col("to").alias("_t")), F.col("to") == F.col("_i"), "left").select("id", F.coalesce("_t", "to").alias("to")), "merges")
    return merges.select("id").join(at, "id", "left").select("id", F.coalesce("to", "id").alias("canonical_id"))


def model_embeddings(rows: DataFrame, model, text_col: str = "text") -> DataFrame:
    """rows with vec from a plug-in: model takes a pandas Series of texts and returns a list of floats for each, a batch at a time."""

    @F.pandas_udf("array<double>")
    def embedded(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in model(texts.fillna(""))])

    return rows.withColumn("vec", embedded(F.col(text_col)))
