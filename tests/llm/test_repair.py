"""Repair beside a search over all edit lists, and SQL."""

import hashlib
import heapq
import random
import re
import zlib
from pathlib import Path

import duckdb
import pytest

from verifold.llm import oracles, repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
AFTER = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def cheapest(own, faults):
    """Dijkstra over (cost, edits) with whole edit lists."""
    best, queue = {}, [(0, "", 0, 0, ())]
    while True:
        cost, edits, i, state, made = heapq.heappop(queue)
        if best.get((i, state), (1 << 60, "")) <= (cost, edits):
            continue
        best[i, state] = (cost, edits)
        if i == len(own) and state in (0, 3):
            return cost, edits, made
        ways = [(2, "I", i, role, "") for role in ("user", "assistant")]
        if i < len(own):
            _, role, text = own[i]
            heapq.heappush(queue, (cost + 3, edits + "D", i + 1, state, made))
            if faults[i] in ("", "t"):
                cut = faults[i] == "t"
                ways += [(cut, "K", i + 1, role, text)] + [(2 + cut, "R", i + 1, other, text) for other in ("user", "assistant")]
        for more, letter, at, role, text in ways:
            to = AFTER[state].get(role[:1])
            if to is not None:
                heapq.heappush(queue, (cost + more, edits + letter, at, to, (*made, (role, text))))


def plain(rows):
    found, out = {}, {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fold = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        own = found.setdefault(conv, [])
        text = "" if fold == 1 else re.sub("[.!?]", "", text) if fold == 2 else text
        own += [(turn, "user" if fold == 4 else role, text)] * {0: 0, 3: 2}.get(fold, 1)
    for conv, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, faults, seen = {r[0] for r in own} - {None}, [], set()
        for _, role, text in own:
            bare = text.strip(SPACE)
            faults.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, edits, made = cheapest(own, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in "bdt"), illegal, cost, edits, digest)
    return out


def reported(df):
    return {r.conv_id: tuple(r)[1:] for r in repair.repaired(df).report().collect()}


def test_random_conversations_over_many_ranges(spark):
    rnd = random.Random(5)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "agent"], ["a.", "b", "c!", "  ", "", None, "hé?", "d. ", "x\n.\n", "long " * 500 + "."]
    rows = [(rnd.choice([None, *range(12)]), rnd.choice([None, *range(60)]), rnd.choice(roles), rnd.choice(texts)) for _ in range(700)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        found = repair.repaired(spark.createDataFrame(rows, SCHEMA))
        assert len(found.seams.value) > 20  # conversations that lie in several ranges
        want = plain(rows)
        assert {r.conv_id: tuple(r)[1:] for r in found.report().collect()} == want
        left = {}
        for r in sorted(found.turns().collect(), key=lambda r: (r.part, r.pos)):
            left.setdefault(r.conv_id, []).append(r)
        for conv, own in left.items():
            assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in own))
            assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == want[conv][-1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_conversation_holds_most_rows(spark):
    rows = [(7, i, "user" if i % 3 else "assistant", f"t {i % 50}{'.' if i % 4 else ''}") for i in range(1500)] + [(8, i, "user", "x.") for i in range(4)]
    assert reported(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_nothing_left_and_empty(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert reported(spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA)) == {gone: (0, 0, 0, 0, 0, 0, "", nothing)}
    assert reported(spark.createDataFrame([], SCHEMA)) == {}


def test_clashing_columns_are_not_read(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("user", "a."), ("assistant", "b."), ("user", "a.")])]
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.selectExpr("*", "1 AS part", "2 AS pos", "3 AS fault", "'x' AS gone", "4 AS _n", "5 AS _text", "6 AS initial")
    assert reported(more) == reported(df) == plain(rows)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the driver's tables")
def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    want = {r[0]: tuple(r[1:]) for r in con.execute(oracles.OP11_SQL).fetchall()}
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert reported(df) == want == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
