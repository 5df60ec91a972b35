"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact check.

A fingerprint's 64 bits fall into 32 segments of two; the embedding is the vector of the segments' popcounts. The
Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints. The 32 coordinates are
dealt to G groups; within distance 3, at least G - 3 groups agree in all their coordinates, so every linked pair meets
in a grid cell made of some G - 3 groups. Cells are an equi-join key; pairs in a cell are tested by the Manhattan bound
and then exactly. Of a cell only a spanning forest leaves the task, never all its pairs. In a cell of more than `block`
fingerprints those linked to one of them, its pivot, are spanned by that; only the others meet all, as pairs of blocks
that separate tasks compare.

Three bits of 64 are far less than a similarity of 0.8 between sets of five-word shingles allows: such texts differ in
about 15 of 100 bits. near_copies() is the same embedding and grid for that: a guide of 64 bits over pairs of words, which
edits touch least, is met in seeded choices of segments instead of all choices of groups, and what meets there and passes
the Manhattan bound is checked exactly on the guide and on 256 bits over five-word shingles.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import component_ids, connected_components, frozen, private, shuffle_width

LOW = 0x5555555555555555
SEED = 42

#: near_copies(): shingle widths of the guide and of the checked bits, 64-bit words of the latter, radii of both.
GUIDE_SHINGLE, SHINGLE, WIDE = 2, 5, 4
GUIDE_RADIUS, WIDE_RADIUS = 18, 60
#: The similarity of the shingles themselves that a link needs, and how many of its nearest rows a row is checked against.
LEAST_SIMILARITY, CHECKED = 0.8, 6
#: Links that one task checks.
LINKS = 4096
#: Rows of a block of loose candidates, and bytes of shingles that such a block holds on the mean.
MET, HELD = 512, 1 << 23
#: Share of a guide's bits that near copies typically differ in, and the recall that the number of cells is set for.
FLIP, CELL_RECALL = 0.12, 0.99
GUIDE = "g"
WORDS = tuple(f"w{k}" for k in range(WIDE))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text; no words: 0."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(w) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())), np.uint64, len(w) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = np.ascontiguousarray(h[at : at + 65536])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def embedding(fp: Column) -> Column:
    """32 popcounts of two-bit segments, two bits each, packed in a long."""
    x, y = fp.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW))
    return x.bitwiseXOR(y).bitwiseOR(F.shiftleft(x.bitwiseAND(y), 1))


def cell_masks(groups: int, radius: int) -> list[int]:
    """For each choice of groups - radius groups, the mask of their coordinates in the packed embedding."""
    masks = [0] * groups
    for k in range(32):
        masks[k % groups] |= 3 << (2 * k)
    return [_signed(sum(masks[g] for g in some)) for some in combinations(range(groups), groups - radius)]


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of packed embeddings: fields differ by one where the low bit of their xor is set, by two where only the high one is."""
    low = np.uint64(LOW)
    ea, eb = ((x & low) + ((x >> np.uint64(1)) & low) for x in (a, b))
    x = ea ^ eb
    one, two = x & low, (x >> np.uint64(1)) & low
    return np.bitwise_count(one).astype(np.int16) + 2 * np.bitwise_count(two & ~one).astype(np.int16)


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs that span the components of fingerprints at `radius` or fewer bits: one vectorised scan per node."""
    rest, out = np.arange(len(fps)), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            maybe = np.flatnonzero(manhattan(fps[rest], fps[at]) <= radius)
            near = maybe[np.bitwise_count(fps[rest[maybe]] ^ fps[at]) <= radius]
            if len(near):
                found = rest[near]
                out += [(at, int(x)) for x in found]
                queue += found.tolist()
                rest = np.delete(rest, near)
    return out


def _edges(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def settle(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
        size = ends - starts
        two = starts[size == 2]
        x, y = fp[two].view(np.uint64), fp[two + 1].view(np.uint64)
        near = manhattan(x, y) <= radius
        x, y = x[near], y[near]
        near = np.bitwise_count(x ^ y) <= radius
        a, b = [x[near]], [y[near]]
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
            own = np.unique(fp[s:e].view(np.uint64))
            if pairs := forest(own, radius):
                i, j = np.array(pairs).T
                a.append(own[i])
                b.append(own[j])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for x in batches:
            key, fp = np.concatenate((key, x.column(0).to_numpy())), np.concatenate((fp, x.column(1).to_numpy()))
            if len(key) and key[0] != key[-1]:
                last = int(np.searchsorted(key, key[-1]))  # the last cell may go on in the next batch
                yield settle(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
        if len(key):
            yield settle(key, fp)

    return run


def groups_for(n: int, radius: int) -> int:
    """Groups that leave a cell few of n fingerprints by chance: a coordinate carries 1.5 bits, a cell all but radius / groups of 48."""
    groups = radius + 3
    while groups < 16 and n > 64 * 2 ** (48 * (groups - radius) / groups):
        groups += 1
    return groups


def in_blocks(marked: DataFrame, columns: list[str], block: int) -> DataFrame:
    """(key, *columns) of rows (key, _near, *columns): keys of pairs of blocks of so many rows, so that under some new key each
    row that isn't near meets all rows of its old one. Rows that are near don't meet each other on purpose."""
    blocks = lambda c: F.ceil(F.count_if(c) / block).cast("int")
    sizes = marked.groupBy("key").agg(blocks(F.col("_near")).alias("_l"), blocks(~F.col("_near")).alias("_r"))
    own = lambda n: F.pmod(F.xxhash64(*columns), F.greatest(F.col(n), F.lit(1)).cast("long")).cast("int")
    each = lambda n, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1), f)).otherwise(F.array().cast("array<long>"))
    near = each("_r", lambda j: F.xxhash64("key", F.lit(0), own("_l"), j))
    far = F.concat(each("_l", lambda i: F.xxhash64("key", F.lit(0), i, own("_r"))), each("_r", lambda j: F.xxhash64("key", F.lit(1), F.least(j, own("_r")), F.greatest(j, own("_r")))))
    return marked.join(sizes, "key").select(F.explode(F.when(F.col("_near"), near).otherwise(far)).alias("key"), *columns)


def met_in_cells(rows: DataFrame, emb: Column, masks: list[int], columns: list[str], block: int, linked) -> tuple[DataFrame, DataFrame | None]:
    """(key, *columns), dealt by key and sorted: each row once for each mask; and edges that are already known. columns[0] is the node.

    A cell of more than `block` rows gets a pivot. Rows that linked(row, pivot) says are linked to it give that edge and
    need not meet each other; the others, few where the cell is one group of near copies, meet all rows of the cell, as
    pairs of blocks.
    """
    width, node = shuffle_width(rows.sparkSession), columns[0]
    cells = rows.select(F.explode(F.array(*[F.xxhash64(F.lit(i), emb.bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("key"), *columns)
    hot = frozen(cells.groupBy("key").count().where(F.col("count") > block).select("key"), "hot-cells")
    deal = lambda df: df.repartition(width, "key").sortWithinPartitions("key")
    if hot.isEmpty():
        return deal(cells), None
    inside = frozen(cells.join(hot, "key", "left_semi"), "hot-rows")
    pivots = inside.groupBy("key").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_p"))
    marked = frozen(inside.join(pivots, "key").withColumn("_near", linked(F.struct(*columns), F.col("_p"))), "near-pivots")
    split = in_blocks(marked, columns, block)
    star = marked.where(F.col("_near") & (F.col(node) != F.col("_p")[node])).select(F.col(node).alias("a"), F.col("_p")[node].alias("b"))
    return deal(cells.join(hot, "key", "left_anti").unionByName(split)), star


def with_known(found: DataFrame, known: DataFrame | None) -> DataFrame:
    return found if known is None else found.unionByName(known)


def fingerprint_links(fps: DataFrame, radius: int = 3, groups: int | None = None, block: int = 4096) -> DataFrame:
    """Edges (a, b) that span all links at `radius` or fewer bits among the distinct longs of column fp.

    More groups make more cells per fingerprint and fewer false meetings in each; unless given, their number follows
    from the number of fingerprints. `block` bounds the fingerprints that one task compares at once.
    """
    masks = cell_masks(groups or groups_for(fps.count(), radius), radius)
    linked = lambda x, y: F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= radius
    met, known = met_in_cells(fps, embedding(F.col("fp")), masks, ["fp"], block, linked)
    return with_known(met.mapInArrow(_edges(radius), "a long, b long"), known)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, groups: int | None = None, block: int = 4096) -> DataFrame:
    """Rows (id, fp, component_id), one for each row of docs.

    component_id is the smallest id reachable over links, the own one included. Equal texts have equal fingerprints and
    are joined once. A null or wordless text has fingerprint 0 and is linked like any other; null ids are passed over
    when the smallest id is sought (a component of null ids has a null component_id); repeated rows come back as often
    as they came; an empty table gives an empty result.
    """
    rows = frozen(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp")), "fingerprints")
    fps = frozen(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct-fingerprints")
    parts = connected_components(fingerprint_links(fps.select("fp"), radius, groups, block))
    named = frozen(component_ids(fps.select(F.col("fp").alias("node"), "first_id"), parts).withColumnRenamed("node", "fp"), "components")
    return rows.join(named, "fp").select("id", "fp", "component_id")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned longs; sums wrap."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of an array of word hashes; of fewer words, of the whole."""
    n = max(1, len(w) - k + 1)
    out = np.full(n, len(w) if len(w) < k else k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(k, len(w))):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n])
    return out


def majority_bits(h: np.ndarray) -> np.uint64:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = np.ascontiguousarray(h[at : at + 65536])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]


def guide_and_wide(w: np.ndarray) -> list[int]:
    """The guide and the WIDE words of a text's word hashes; all zero without words."""
    if not len(w):
        return [0] * (1 + WIDE)
    five = shingle_hashes(w, SHINGLE)
    return [int(majority_bits(h)) for h in (shingle_hashes(w, GUIDE_SHINGLE), *(_mixed(five + np.uint64(k + 1)) for k in range(WIDE)))]


def _word_hashes(texts: pa.Array) -> list[np.ndarray]:
    """Of each text the hashes of its words, A-Z lower-cased."""
    # lowered before the cast: ascii_lower misreads a slice that was cast
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string()))
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    d = pc.list_flatten(split).cast(pa.large_binary()).dictionary_encode()
    own = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in d.dictionary.to_pylist()), np.uint64, len(d.dictionary))
    empty = np.array([len(w) == 0 for w in d.dictionary.to_pylist()], bool)  # what splitting leaves at a text's edges
    code = d.indices.to_numpy()
    ends = np.cumsum(sizes)
    return [own[c[~empty[c]]] for c in (code[e - n : e] for n, e in zip(sizes.tolist(), ends.tolist()))]


def _guides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), *[(c, pa.int64()) for c in (GUIDE, *WORDS)]])
    for x in batches:
        for at in range(0, x.num_rows, 256):
            s = x.slice(at, 256)
            rows = [guide_and_wide(w) for w in _word_hashes(s.column(2))]
            bits = np.array(rows, np.uint64).reshape(len(rows), 1 + WIDE).view(np.int64)
            yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), *[pa.array(bits[:, k]) for k in range(1 + WIDE)]], schema=schema)


def choices_for(n: int) -> list[int]:
    """Masks of seeded choices of segments: so many in each that a cell holds some 500 of n guides by chance, and so many
    choices that guides which differ in FLIP of their bits agree in one with CELL_RECALL."""
    segments = min(30, max(8, math.ceil((math.log2(max(n, 2)) - 9) / 1.5)))
    same = ((1 - FLIP) ** 2 + FLIP**2 / 2) ** segments
    rnd = random.Random(SEED)
    return [_signed(sum(3 << (2 * k) for k in rnd.sample(range(32), segments))) for _ in range(math.ceil(math.log(1 - CELL_RECALL) / math.log(1 - same)))]


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows (guide, wide words): the Manhattan bound, then both exact distances."""
    out = manhattan(x[..., 0], y[..., 0]) <= GUIDE_RADIUS
    out[out] = np.bitwise_count(x[out, 0] ^ (y[out, 0] if y.ndim > 1 else y[0])) <= GUIDE_RADIUS
    out[out] = np.bitwise_count(x[out, 1:] ^ (y[out, 1:] if y.ndim > 1 else y[1:])).sum(1, dtype=np.int64) <= WIDE_RADIUS
    return out


def spanning(rows: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs that span the components of rows (guide, wide words)."""
    rest, out = np.arange(len(rows)), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.flatnonzero(_near(rows[rest], rows[at]))
            if len(near):
                found = rest[near]
                out += [(at, int(x)) for x in found]
                queue += found.tolist()
                rest = np.delete(rest, near)
    return out


def _candidates(few: int = 8):
    """Of rows (key, node, bits) that come by cells: pairs of nodes that are near by their bits, with their distance.

    In cells of a few rows all such pairs; in larger ones those that span the groups, and each grouped row with its nearest.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.int32())])

    def grouped(bits: np.ndarray) -> tuple[list[int], list[int]]:
        pairs = spanning(bits)
        own = np.unique(np.array(pairs, np.int64).ravel())
        for i in own.tolist():
            d = np.bitwise_count(bits[own, 1:] ^ bits[i, 1:]).sum(1, dtype=np.int64)
            d[np.searchsorted(own, i)] = 1 << 20
            j = int(own[d.argmin()])
            if _near(bits[j : j + 1], bits[i])[0]:
                pairs.append((i, j))
        kept = {(min(p), max(p)) for p in pairs}
        return [i for i, _ in kept], [j for _, j in kept]

    def settle(key: np.ndarray, node: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
        size = ends - starts
        a, b = [], []
        at = np.flatnonzero(np.repeat(size <= few, size))
        for k in range(1, min(few, int(size.max()))):  # small cells: all rows against those k places on
            at = at[at + k < len(key)]
            at = at[key[at + k] == key[at]]
            hit = at[_near(bits[at], bits[at + k])] if len(at) else at
            a += hit.tolist()
            b += (hit + k).tolist()
        for s, e in zip(starts[size > few].tolist(), ends[size > few].tolist()):
            one, two = grouped(bits[s:e])
            a += [s + i for i in one]
            b += [s + j for j in two]
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        d = np.bitwise_count(bits[x, 1:] ^ bits[y, 1:]).sum(1, dtype=np.int32) if len(x) else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y]), pa.array(d)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 3 + WIDE), np.int64)
        for x in batches:
            held = np.concatenate((held, np.stack([c.to_numpy() for c in x.columns], axis=1)))
            if len(held) and held[0, 0] != held[-1, 0]:
                last = int(np.searchsorted(held[:, 0], held[-1, 0]))  # the last cell may go on in the next batch
                yield settle(held[:last, 0], held[:last, 1], np.ascontiguousarray(held[:last, 2:]).view(np.uint64))
                held = held[last:]
        if len(held):
            yield settle(held[:, 0], held[:, 1], np.ascontiguousarray(held[:, 2:]).view(np.uint64))

    return run


def _unjoined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node, bits, root) that come by cells: pairs (x, y) of roots that span those which near rows of the cell connect."""

    def settle(held: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate(([0], np.flatnonzero(np.diff(held[:, 0])) + 1))
        ends = np.append(starts[1:], len(held))
        mixed = np.minimum.reduceat(held[:, -1], starts) != np.maximum.reduceat(held[:, -1], starts)
        for s, e in zip(starts[mixed].tolist(), ends[mixed].tolist()):
            root, bits = held[s:e, -1], np.ascontiguousarray(held[s:e, 2:-1]).view(np.uint64)
            if pairs := spanning(bits):
                x, y = root[np.array(pairs).T]
                if len(two := np.unique(np.sort(np.stack((x, y), axis=1)[x != y], axis=1), axis=0)):
                    yield pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1])], ["x", "y"])

    held = np.empty((0, 4 + WIDE), np.int64)
    for x in batches:
        held = np.concatenate((held, np.stack([c.to_numpy() for c in x.columns], axis=1)))
        if len(held) and held[0, 0] != held[-1, 0]:
            last = int(np.searchsorted(held[:, 0], held[-1, 0]))  # the last cell may go on in the next batch
            yield from settle(held[:last])
            held = held[last:]
    if len(held):
        yield from settle(held)


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles) of rows (node, text): the distinct hashes of a text's shingles, sorted."""
    for x in batches:
        for at in range(0, x.num_rows, 256):
            s = x.slice(at, 256)
            sets = [np.unique(shingle_hashes(w, SHINGLE)).tobytes() for w in _word_hashes(s.column(1))]
            yield pa.RecordBatch.from_arrays([s.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])


def _alike(least: float):
    """Links (a, b) among those of (key, a, b, shingles of a) whose shingles are as similar as that, with (key, b, shingles of b)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held = {b: np.frombuffer(x, np.uint64) for b, x in zip(right.column(1).to_pylist(), right.column(2).to_pylist(), strict=True)}
        kept = []
        for a, b, x in zip(*(left.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            one, two = np.frombuffer(x, np.uint64), held[b]
            both = len(np.intersect1d(one, two, assume_unique=True))
            if both >= least * (len(one) + len(two) - both):
                kept.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in kept], pa.int64()), "b": pa.array([b for _, b in kept], pa.int64())})

    return run


def checked_links(links: DataFrame, texts: DataFrame, least: float = LEAST_SIMILARITY, most: int = LINKS) -> DataFrame:
    """The links (a, b) whose texts have a Jaccard similarity of `least` or more in their five-word shingles.

    texts: (node, text), a text of each node. A node's shingles travel once for each of its links as a, and once for each
    task that checks links to it as b: the links of a node that many are linked to are dealt out.
    """
    wanted = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = frozen(texts.join(wanted, "node", "left_semi").mapInArrow(_shingle_sets, "node long, shingles binary").dropDuplicates(["node"]), "shingles")
    ends = links.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / most).alias("_parts"))
    tasks = max(1, math.ceil(links.count() / most))
    key = lambda b, salt: F.pmod(F.xxhash64(b, salt), F.lit(tasks))
    dealt = links.join(ends, "b").select("a", "b", key("b", F.pmod(F.xxhash64("a"), "_parts")).alias("key"))
    left = dealt.join(sets.select(F.col("node").alias("a"), "shingles"), "a").select("key", "a", "b", "shingles")
    each = ends.select("b", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1), lambda i: key("b", i))).alias("key_b")).distinct()
    right = each.join(sets.select(F.col("node").alias("b"), "shingles"), "b").select("key_b", F.col("b").alias("b_r"), F.col("shingles").alias("shingles_r"))
    return left.groupBy("key").cogroup(right.groupBy("key_b")).applyInArrow(_alike(least), "a long, b long")


def _alike_within(least: float):
    """Of rows (key, node, root, near, shingles) of one key: links (a, b) that span the roots which rows as similar as that connect.

    Where some rows are near, the others meet these only.
    """

    def run(t: pa.Table) -> pa.Table:
        node, root, near = (t.column(c).to_numpy() for c in ("node", "root", "near"))
        shingles = t.column("shingles").combine_chunks()
        size = pc.binary_length(shingles).to_numpy().astype(np.int64) // 8
        code = np.unique(np.frombuffer(b"".join(shingles.to_pylist()), np.uint64), return_inverse=True)[1]
        posted = np.repeat(np.arange(len(node)), size)[np.argsort(code, kind="stable")]
        start = np.concatenate(([0], np.cumsum(np.bincount(code))))
        ends, joined, links = np.cumsum(size), {}, []

        def end(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        for i in np.flatnonzero(~near).tolist():
            own = code[ends[i] - size[i] : ends[i]]
            held = start[own + 1] - start[own]
            both = np.bincount(posted[np.repeat(start[own] - np.cumsum(held) + held, held) + np.arange(int(held.sum()))], minlength=len(node))
            meets = (near if near.any() else np.arange(len(node)) > i) & (root != root[i])
            for j in np.flatnonzero(meets & (both >= least * (size[i] + size - both))).tolist():
                x, y = end(int(root[i])), end(int(root[j]))
                if x != y:
                    joined[x] = y
                    links.append((int(node[i]), int(node[j])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def links_within(rows: DataFrame, texts: DataFrame, least: float = LEAST_SIMILARITY, most: int = MET, held: int = HELD) -> DataFrame:
    """Links (a, b) that join all roots of a group which texts of a Jaccard similarity of `least` or more connect.

    rows: (node, root, group); texts: (node, text), a text of each node. Rows of different roots meet, those of a group's most
    frequent root the others only, as pairs of blocks of at most `most` rows or about `held` bytes; no row is made for a pair.
    """
    sizes = rows.groupBy("group", "root").agg(F.count(F.lit(1)).alias("_n"))
    top = sizes.groupBy("group").agg(F.max_by("root", F.struct("_n", "root")).alias("_top"), F.max("_n").alias("_most"))
    sets = texts.mapInArrow(_shingle_sets, "node long, shingles binary").dropDuplicates(["node"])
    # a group of single rows has no root that others share
    marked = rows.join(top, "group").join(sets, "node").select(F.xxhash64("group").alias("key"), ((F.col("root") == F.col("_top")) & (F.col("_most") > 1)).alias("_near"), "node", "root", "shingles")
    marked = frozen(marked.withColumn("near", F.col("_near")), "loose")
    mean = marked.agg(F.avg(F.length("shingles"))).first()[0] or 1
    met = in_blocks(marked, ["node", "root", "near", "shingles"], max(1, min(most, int(held / mean))))
    return met.groupBy("key").applyInArrow(_alike_within(least), "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 4096, checked: int = CHECKED) -> DataFrame:
    """Rows (id, component_id), one for each row of docs: near copies by five-word shingles at a similarity of 0.8 or more.

    Candidates meet in cells, their guides differing in GUIDE_RADIUS or fewer bits and their five-word bits in WIDE_RADIUS or
    fewer; of each row the `checked` nearest, and in a cell of more than `block` rows its pivot, are checked on the shingles
    themselves, so that no link is below the similarity, and only texts in a component through such links are copies. Then
    components that other candidates of the cells connect are held against each other whole, so that no candidate is lost;
    they meet in blocks, and no row is made for a pair of them. Nulls,
    wordless texts, ties, repeated rows and empty tables are as in near_duplicates(). Rows are known by a 64-bit hash of
    their fingerprints.
    """
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    bits = ", ".join(f"{c} long" for c in (GUIDE, *WORDS))
    rows = frozen(text.mapInArrow(_guides, f"id long, text_hash long, {bits}").withColumn("node", F.xxhash64(GUIDE, *WORDS)), "guides")
    kinds = frozen(rows.groupBy("node", GUIDE, *WORDS).agg(F.min("id").alias("first_id"), F.min(F.struct("id", "text_hash")).alias("one")), "distinct-guides")

    def linked(x: Column, y: Column) -> Column:
        bits = [F.bit_count(x[c].bitwiseXOR(y[c])) for c in (GUIDE, *WORDS)]
        return (bits[0] <= GUIDE_RADIUS) & (sum(bits[2:], bits[1]) <= WIDE_RADIUS)

    def shown(used: DataFrame) -> DataFrame:
        """A text of each of these nodes."""
        first = kinds.join(used, "node", "left_semi").select("node", "one")
        return text.join(first, F.col("id").eqNullSafe(F.col("one.id")) & (F.col("text_hash") == F.col("one.text_hash"))).select("node", "text")

    masks, own = choices_for(kinds.count()), kinds.drop("first_id", "one")
    met, pivots = met_in_cells(own, embedding(F.col(GUIDE)), masks, ["node", GUIDE, *WORDS], block, linked)
    pairs = frozen(met.mapInArrow(_candidates(), "a long, b long, d int"), "candidates")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).where("a <> b").distinct()
    w = Window.partitionBy("a").orderBy("d", "b")
    near = with_known(both.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= checked).select("a", "b"), pivots)
    once = frozen(near.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct(), "pairs")
    busy = once.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    weighed = once.join(busy.toDF("x", "_x"), "x").join(busy.toDF("y", "_y"), "y")
    more = F.col("_x") > F.col("_y")  # b is the end with more links, which are dealt out
    links = frozen(weighed.select(F.when(more, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(more, F.col("x")).otherwise(F.col("y")).alias("b")), "links")
    edges = frozen(checked_links(links, shown(links.select(F.explode(F.array("a", "b")).alias("node")).distinct())), "alike")
    parts = connected_components(edges)
    # what was passed over lies between rows that had a candidate each and that the checked links haven't joined
    some = with_known(pairs.select("a", "b"), pivots).select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = own.join(some, "node", "left_semi").join(parts.select(F.col("node").alias("_m"), "root"), F.col("node") == F.col("_m"), "left").drop("_m")
    labels = frozen(labels.withColumn("root", F.coalesce("root", "node")), "labels")
    again = met_in_cells(labels, embedding(F.col(GUIDE)), masks, ["node", GUIDE, *WORDS, "root"], block, lambda x, y: x["root"] == y["root"])[0]
    rest = frozen(again.mapInArrow(_unjoined, "x long, y long").distinct().toDF("a", "b"), "rest")
    if not rest.isEmpty():
        groups = connected_components(rest).toDF("_m", "group")
        groups = groups.unionByName(groups.select(F.col("group").alias("_m"), "group").distinct())
        loose = frozen(labels.join(groups, F.col("root") == F.col("_m")).select("node", "root", "group"), "grouped")
        found = frozen(links_within(loose, shown(loose.select("node"))), "more-links")
        parts = connected_components(edges.unionByName(found))
    named = frozen(component_ids(kinds.groupBy("node").agg(F.min("first_id").alias("first_id")), parts), "components")
    return rows.join(named, "node").select("id", "component_id")


def keep_first(docs: DataFrame, found: DataFrame | None = None, **how) -> DataFrame:
    """The rows of docs without near-duplicates: of each component, the row with the smallest doc_id stays.

    found: (id, component_id) of near_duplicates() or near_copies(); near_duplicates(docs, **how) unless given.

    Of rows that repeat that doc_id, one stays, the one with the smallest text; rows with a null id that no id
    represents stay, as nothing tells them apart.
    """
    width, p = shuffle_width(docs.sparkSession), private(docs)
    found = near_duplicates(docs, **how) if found is None else found
    firsts = found.where("id = component_id").select(F.col("id").alias(p + "keep")).distinct().repartition(width)
    kept = docs.join(firsts, docs["doc_id"] == F.col(p + "keep"), "left_semi")
    again = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias(p + "n")).where(F.col(p + "n") > 1).select(F.col("doc_id").alias(p + "again"))
    again = frozen(again, "repeated-ids")
    lone = docs.where(F.col("doc_id").isNull())
    if again.isEmpty():
        return kept.unionByName(lone)
    one = kept.join(again, kept["doc_id"] == F.col(p + "again"), "left_semi")
    rest = kept.join(again, kept["doc_id"] == F.col(p + "again"), "left_anti")
    cols = [c for c in docs.columns if c != "doc_id"]
    first = one.groupBy("doc_id").agg(F.min(F.struct(*[F.col(c) for c in ["text", *[c for c in cols if c != "text"]]])).alias(p + "r"))
    return rest.unionByName(first.select("doc_id", *[F.col(p + "r")[c].alias(c) for c in cols]).select(*docs.columns)).unionByName(lone)
