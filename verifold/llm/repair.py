"""Conversation structure repair: the cheapest edits that give a conversation its grammar, and the turns that they leave.

Roles must read (s?(ua)+)? by their initials. A backward pass over the rows gives, for each state of the grammar, the least
cost of making the rest right; a forward pass then takes, among the edits on a cheapest way, the one whose letter comes
first, so that of all cheapest edit lists the smallest by ASCII is found.

Rows are sorted by ranges of (conversation, turn), and a task walks its range, one conversation after another. A conversation
may lie in several ranges: then each range's piece is first summed up as a table of costs from state to state, and tables
combine by (min, +), so that no task ever holds the whole. At most two pieces of a range belong to conversations that go
on elsewhere; the driver sees a few numbers of each of these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frozen, shuffle_width

FOLDS = 20
DROPPED, EMPTIED, UNSTOPPED, REPEATED, USURPED = range(5)
RIGHT, BLANK, DUPLICATE, TRUNCATED, GONE = range(5)
#: States of the grammar: nothing yet, after s, after u, after a. What u or a leads on from each, and what s does.
START, SYSTEM, USER, ASSISTANT = range(4)
ONWARD = (USER, USER, ASSISTANT, USER)
ENDS = (START, ASSISTANT)
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
FAR = 1 << 40


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) after damage by a hash of conversation and turn; dropped rows stay as gone."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fold = F.crc32(F.concat_ws(":", one("conv_id"), one("turn")).cast("binary")) % FOLDS
    text = F.when(fold == EMPTIED, "").when(fold == UNSTOPPED, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(fold == REPEATED, 2).otherwise(1)))
    return conversations.select("conv_id", "turn", F.when(fold == USURPED, "user").otherwise(one("role")).alias("role"), text.alias("text"), (fold == DROPPED).alias("gone"), times.alias("_n")).drop("_n")


def placed(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, gone) sorted by conversation, turn, role and text over ranges of about one size: (part, pos, conv_id, turn, role, text, fault).

    fault knows of gone, blank and truncated rows; what repeats comes from repeats().
    """
    last = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(F.col("gone"), GONE).when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(RIGHT)
    order = ["conv_id", F.asc_nulls_first("turn"), "role"]
    ranged = rows.repartitionByRange(shuffle_width(rows.sparkSession), *order, F.left("text", F.lit(64))).sortWithinPartitions(*order, "text")
    numbered = ranged.withColumn("pos", F.monotonically_increasing_id()).withColumn("part", F.shiftright("pos", 33).cast("int"))
    return frozen(numbered.select("part", "pos", "conv_id", "turn", "role", "text", fault.alias("fault")), "turns")


def repeats(rows: DataFrame) -> DataFrame:
    """Marks (part, pos, conv_id) of placed rows whose role and text an earlier row of the conversation has, by hashes of the texts."""
    w = Window.partitionBy("conv_id", "role", "_text").orderBy("pos")
    light = rows.where(F.col("fault") != GONE).select("part", "pos", "conv_id", "role", F.sha2("text", 256).alias("_text"))
    return frozen(light.withColumn("_n", F.row_number().over(w)).where("_n > 1").select("part", "pos", "conv_id"), "repeats")


def kept(state: int, initial: str) -> int:
    """The state after a kept row, -1 if the grammar forbids it."""
    if initial == "s":
        return SYSTEM if state == START else -1
    if initial == "u":
        return USER if state != USER else -1
    return ASSISTANT if initial == "a" and state == USER else -1


def _inserted(cost: list[int]) -> list[int]:
    """Costs when turns may also be inserted first: no more than one is of use before a turn of one's own, or two at the start."""
    user, assistant = min(cost[USER], INSERT + cost[ASSISTANT]), min(cost[ASSISTANT], INSERT + cost[USER])
    return [min(cost[START], INSERT + user), min(cost[SYSTEM], INSERT + user), user, assistant]


def _before(initial: str, fault: int, cost: list[int]) -> list[int]:
    """Costs to go with a row still to come, from those after it."""
    if fault == GONE:
        return cost
    out = [DELETE + c for c in cost]
    if fault in (RIGHT, TRUNCATED):
        cut = CUT * (fault == TRUNCATED)
        for q in range(4):
            to = kept(q, initial)
            out[q] = min(out[q], cut + REROLE + cost[ONWARD[q]], cut + cost[to] if to >= 0 else FAR)
    return _inserted(out)


AT_END = _inserted([0 if q in ENDS else FAR for q in range(4)])


def _costs(piece: list[list], cost: list[int]) -> list[list[int]]:
    """Costs to go before each row of a piece and after the last."""
    out = [cost]
    for row in reversed(piece):
        out.append(_before(row[0], row[1], out[-1]))
    return out[::-1]


def _walk(piece: list[list], costs: list[list[int]], state: int, ends: bool) -> tuple[list[str], int]:
    """The edits before and at each row, from a state on, smallest letters first; what is inserted at the end is one more."""
    edits = []
    for k, row in enumerate([*piece, ("", -1)]):
        (initial, fault), own = row[:2], ""
        if fault == -1 and not ends:
            break
        while True:
            left, after = costs[k][state], costs[k + 1] if k + 1 < len(costs) else None
            if fault == GONE or fault == -1 and left == 0 and state in ENDS:
                break
            cut = CUT * (fault == TRUNCATED)
            to = kept(state, initial)
            if fault >= 0 and left == DELETE + after[state]:
                own += "D"
                break
            if left == INSERT + costs[k][ONWARD[state]]:
                own, state = own + "I", ONWARD[state]
            elif fault in (RIGHT, TRUNCATED) and to >= 0 and left == cut + after[to]:
                own, state = own + "K", to
                break
            else:
                own, state = own + "R", ONWARD[state]
                break
        edits.append(own)
    return edits, state


@dataclass
class Seam:
    """What a piece of a conversation has to know of the pieces around it."""

    ahead: list[int]  # costs to go at its end
    state: int = START  # where it begins
    ends: bool = True
    split: bool = False
    initial: str | None = None  # of the row before it
    turn: int | None = None


WHOLE = Seam(AT_END)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, list[list]]]:
    """(part, conv_id) and the rows [initial, fault, turn, ...] of rows (part, conv_id, initial, fault, turn, ...) that come sorted; a mark of fault DUPLICATE stands before the row that it is of."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, own in groupby(rows, key=lambda r: (r[0], r[1])):
        out, marked = [], False
        for r in own:
            if r[3] == DUPLICATE:
                marked = True
                continue
            out.append([r[2], DUPLICATE if marked and r[3] != BLANK else r[3], *r[4:]])
            marked = False
        yield key, out


def _edges(found: Iterator[tuple[tuple, list]]) -> Iterator[tuple[tuple, list]]:
    """The first and the last piece of each range."""
    held = None
    for key, rows in found:
        if held is None or held[0][0] != key[0]:
            if held and not held[2]:
                yield held[:2]
            held = (key, rows, True)
            yield key, rows
        else:
            held = (key, rows, False)
    if held and not held[2]:
        yield held[:2]


def _seam_tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range's first and last piece: cost tables from state to state, the initials and turns at its edges."""
    out, kind = [], pa.int64()
    for (part, conv), rows in _edges(_pieces(kind_of := _typed(batches))):
        table = [_costs(rows, [0 if q == end else FAR for q in range(4)])[0] for end in range(4)]
        there = [r for r in rows if r[1] != GONE]
        out.append((part, conv, table, there[-1][0] if there else None, there[-1][2] if there else None))
        kind = kind_of.kind
    cols = list(zip(*out, strict=True)) if out else [()] * 5
    kinds = [pa.int32(), kind, pa.list_(pa.list_(pa.int64())), pa.string(), pa.int64()]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "conv_id", "table", "initial", "turn"])


class _typed:
    """Batches, and the type of conversation ids in them."""

    def __init__(self, batches: Iterable[pa.RecordBatch]):
        self.batches, self.kind = batches, pa.int64()

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        for b in self.batches:
            self.kind = b.column(1).type
            yield b


def _exits(seams) -> Callable:
    """Of each piece of a split conversation, the state that it ends in for each that it may begin in."""

    def walked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, kind = [], pa.int64()
        for (part, conv), rows in _edges(_pieces(kind_of := _typed(batches))):
            seam = seams.value.get((part, conv))
            if seam:
                costs, kind = _costs(rows, seam.ahead), kind_of.kind
                out.append((part, conv, [_walk(rows, costs, q, seam.ends)[1] for q in range(4)]))
        if out:
            part, conv, exits = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(conv, kind), pa.array(exits, pa.list_(pa.int32()))], ["part", "conv_id", "exits"])

    return walked


def _rebuilt(rows: list[list], edits: list[str], state: int) -> Iterator[tuple[str, str, str]]:
    """The turns (edit, role, text) that edits leave of rows [initial, fault, turn, role, text]."""
    for k, own in enumerate(edits):
        for e in own:
            role, text = ("assistant" if state == USER else "user"), ""
            if e in "KR":
                text = rows[k][4]
            if e == "K":
                role = rows[k][3]
            if e != "D":
                state = kept(state, role[:1])
                yield e, role, text


def _reports(seams) -> Callable:
    def reported(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (part, conv), rows in _pieces(kinds := _typed(batches)):
            seam = seams.value.get((part, conv), WHOLE)
            costs = _costs(rows, seam.ahead)
            edits, state = _walk(rows, costs, seam.state, seam.ends)
            there = [r for r in rows if r[1] != GONE]
            initials = [seam.initial] * (seam.initial is not None) + [r[0] for r in there]
            turns = {r[2] for r in there if r[2] is not None}
            digest = None
            if not seam.split:
                digest = hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in _rebuilt(rows, edits, seam.state)).encode("utf-8", "surrogatepass")).hexdigest()
            spent = costs[0][seam.state] - (0 if seam.ends else seam.ahead[state])
            faults = [sum(r[1] == f for r in rows) for f in (BLANK, DUPLICATE, TRUNCATED)]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
            out.append((conv, part, seam.split, min(turns, default=None), max(turns, default=None), len(turns) - (seam.turn in turns), *faults, illegal, spent, "".join(edits), digest))
            if len(out) == 4096:
                yield _batch(out, kinds.kind)
                out = []
        if out:
            yield _batch(out, kinds.kind)

    return reported


REPORT = ["conv_id", "part", "split", "first_turn", "last_turn", "n_turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int32(), pa.bool_(), *[pa.int64()] * 8, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], REPORT)


def _turns(seams, split_only: bool) -> Callable:
    """Rebuilt turns (conv_id, part, pos, edit, role, text), pos counting within the piece."""

    def turned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, conv), rows in _pieces(kinds := _typed(batches)):
            seam = seams.value.get((part, conv), WHOLE)
            if split_only and not seam.split:
                continue
            edits, _ = _walk(rows, _costs(rows, seam.ahead), seam.state, seam.ends)
            made = list(_rebuilt(rows, edits, seam.state))
            for k in range(0, len(made), 4096):
                e, role, text = zip(*made[k : k + 4096], strict=True)
                n = len(e)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv] * n, kinds.kind), pa.array([part] * n, pa.int32()), pa.array(range(k, k + n), pa.int64()), *(pa.array(c, pa.string()) for c in (e, role, text))],
                    ["conv_id", "part", "pos", "edit", "role", "text"],
                )

    return turned


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of conversations whose turns (conv_id, role, text) come sorted: a hash can't be split, so that one task reads a conversation's turns one by one."""
    now, digest, found, kinds = None, None, [], _typed(b.select([0, 0, 1, 2]) for b in batches)
    for b in kinds:
        for conv, role, text in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
            if digest is None or conv != now:
                if digest:
                    found.append((now, digest.hexdigest()))
                now, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
    if digest:
        found.append((now, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], kinds.kind), pa.array([f[1] for f in found])], ["conv_id", "digest"])


class Repair:
    """The repair of rows (conv_id, turn, role, text, gone): report() has a row per conversation, turns() the rebuilt ones."""

    def __init__(self, rows: DataFrame):
        self.rows = placed(rows)
        self.marks = repeats(self.rows)
        self.kind = self.rows.schema["conv_id"].dataType.simpleString()
        self.seams = rows.sparkSession.sparkContext.broadcast(self._seams())

    def _stream(self, *more: str) -> DataFrame:
        """Rows of each range in order, marks before what they mark; a range is a task's work."""
        names = ["conv_id", "initial", "fault", "turn", *more]
        rows = self.rows.withColumn("initial", F.left("role", F.lit(1))).select("part", *names, "pos", F.lit(1).alias("k"))
        blank = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("initial", "turn", *more)]
        marks = self.marks.select("part", "pos", "conv_id", F.lit(DUPLICATE).alias("fault"), F.lit(0).alias("k"), *blank)
        both = rows.unionByName(marks).repartition(shuffle_width(rows.sparkSession), "part").sortWithinPartitions("part", "pos", "k")
        return both.select("part", *names)

    def _seams(self) -> dict[tuple, Seam]:
        """Of pieces of conversations that lie in several ranges: at most two a range come to the driver, with a few numbers each."""
        edges = self._stream().mapInArrow(_seam_tables, f"part int, conv_id {self.kind}, table array<array<bigint>>, initial string, turn bigint").collect()
        pieces: dict = {}
        for e in sorted(edges, key=lambda e: e.part):
            pieces.setdefault(e.conv_id, []).append(e)
        seams: dict[tuple, Seam] = {}
        for conv, own in pieces.items():
            if len(own) > 1:
                ahead = AT_END
                for k in reversed(range(len(own))):
                    seams[own[k].part, conv] = Seam(ahead, ends=k == len(own) - 1, split=True)
                    ahead = [min(own[k].table[end][q] + ahead[end] for end in range(4)) for q in range(4)]
                for k in range(1, len(own)):
                    before = [e for e in own[:k] if e.initial is not None]
                    if before:
                        seam = seams[own[k].part, conv]
                        seam.initial, seam.turn = before[-1].initial, before[-1].turn
        if seams:
            known = self.rows.sparkSession.sparkContext.broadcast(seams)
            exits = {(e.part, e.conv_id): e.exits for e in self._stream().mapInArrow(_exits(known), f"part int, conv_id {self.kind}, exits array<int>").collect()}
            for conv, own in pieces.items():
                state = START
                for e in own if len(own) > 1 else ():
                    seams[e.part, conv].state = state
                    state = exits[e.part, conv][state]
        return seams

    def report(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation."""
        kinds = "int, split boolean, first_turn long, last_turn long, n_turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
        pieces = self._stream("role", "text").mapInArrow(_reports(self.seams), f"conv_id {self.kind}, part {kinds}")
        gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0).cast("long")).alias("gaps")
        out = ["conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        if not self.seams.value:
            return pieces.select(*out)
        pieces = frozen(pieces, "pieces")
        sums = [F.sum(c).alias(c) for c in ("n_turns", "blank", "duplicate", "truncated", "illegal", "cost")]
        audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit")
        split = pieces.where("split").groupBy("conv_id").agg(F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"), *sums, audit)
        turns = self.turns(split_only=True).repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos").select("conv_id", "role", "text")
        digests = turns.mapInArrow(_hashed, f"conv_id {self.kind}, digest string").withColumnRenamed("conv_id", "_c")
        nothing = F.sha2(F.lit("").cast("binary"), 256)
        joined = split.join(digests, F.col("conv_id").eqNullSafe(F.col("_c")), "left").withColumn("repaired_sha256", F.coalesce("digest", nothing))
        return pieces.where("NOT split").select(*out).unionByName(joined.select(*out))

    def turns(self, split_only: bool = False) -> DataFrame:
        """(conv_id, part, pos, edit, role, text): the turns that are left, in order of part and pos, each with the edit that made it."""
        return self._stream("role", "text").mapInArrow(_turns(self.seams, split_only), f"conv_id {self.kind}, part int, pos long, edit string, role string, text string")


def repaired(conversations: DataFrame) -> Repair:
    """The repair of conversations (conv_id, turn, role, text) after damage.

    Nulls in role, text and in what is hashed are one space; a null turn comes first and counts in no gap; a null id is a
    conversation of its own; rows of one turn come by role and text. A role counts by its first character, an empty one by
    none, which the grammar forbids. Conversations of which nothing is left have zeros, no edits and the hash of nothing;
    an empty table has no rows. More columns are not read.
    """
    return Repair(damaged(conversations))
