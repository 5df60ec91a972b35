"""Quotation linking: quote levels, hashed passages, reply order. DataFrame functions only.

A line's quote level is the number of > signs before its text. A passage is a run of lines of one level without a blank
line between; it is normalised (lower case, white space collapsed) and hashed, and so is each line of a longer one, so
that a part quoted alone is found too. Quoted passages meet the messages of the conversation that hold them as their own
text; a message replies to the earlier one that matches most of its quotes of the lowest level. Depth and root of a reply come
from doubling the parent pointers, and the messages come back without quotes in the order of conversation, root, depth
and turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frozen, shuffle_width
from .quality import let

PREFIX = r"^[ \t]*(?:>[ \t]?)+"
ATTRIBUTION = r"(?i)^\s*(on\b.*\bwrote|le\b.*\ba écrit|am\b.*\bschrieb.*|el\b.*\bescribió)\s*:\s*$"
LEAST_CHARS = 1
#: A passage that more messages of a conversation hold is met by combinations.
FEW = 16


def parsed_lines(text: Column) -> Column:
    """The lines of a text as structs (level, body)."""

    def line(x: Column) -> Column:
        prefix = F.regexp_extract(x, PREFIX, 0)
        return F.struct(F.length(F.regexp_replace(prefix, "[^>]", "")).alias("level"), x.substr(F.length(prefix) + 1, F.length(x)).alias("body"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), line)


def normalised(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(body), r"[\x20\x09-\x0D ]+", " "))


def units(lines: Column, least: int = LEAST_CHARS) -> Column:
    """Hashed passages, and the lines of passages that have more than one, as structs (level, hash, chars)."""
    blank = lambda i: F.coalesce(normalised(F.get(lines, i)["body"]) == "", F.lit(True))
    begins = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: ~blank(i) & (F.when(i > 0, blank(i - 1) | (F.get(lines, i - 1)["level"] != F.get(lines, i)["level"])).otherwise(F.lit(True))))

    def unit(level: Column, text: Column) -> Column:
        return F.struct(level.alias("level"), F.xxhash64(text).alias("hash"), F.length(text).cast("long").alias("chars"))

    def of(starts: Column) -> Column:
        def passage(s: Column, k: Column) -> Column:
            own = F.filter(F.transform(F.slice(lines, s + 1, F.coalesce(F.get(starts, k + 1), F.size(lines)) - s), lambda x: normalised(x["body"])), lambda b: b != "")
            level = F.get(lines, s)["level"]
            whole = F.array(unit(level, F.array_join(own, " ")))
            return F.when(F.size(own) > 1, F.concat(whole, F.transform(own, lambda b: unit(level, b)))).otherwise(whole)

        return F.filter(F.flatten(F.transform(starts, passage)), lambda u: u["chars"] >= least)

    return let(begins, of)


def own_text(lines: Column) -> Column:
    """A message without its quotes and the lines that announce them."""
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(x["body"].rlike(ATTRIBUTION) & F.coalesce(F.get(lines, i + 1)["level"] > 0, F.lit(False))))
    return F.trim(F.array_join(F.transform(kept, lambda x: x["body"]), "\n"), F.lit("\n"))


def parse(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, msg, body, max_level, units): one row for each message. msg is a hash of the four columns."""
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("_t"))
    cut = rows.withColumn("_l", parsed_lines(F.col("_t")))
    lines = F.col("_l")
    return cut.select(
        "conv_id", "turn", "role", F.xxhash64("conv_id", "turn", "role", "_t").alias("msg"), own_text(lines).alias("body"),
        F.array_max(F.transform(lines, lambda x: x["level"])).alias("max_level"), units(lines).alias("units"),
    )


def reply_links(parsed: DataFrame, few: int = FEW) -> DataFrame:
    """(msg, parent, parent_turn) for each distinct message whose quotes an earlier message of its conversation holds.

    Of the earlier messages, those matched at the lowest level go first, then the one that matches most characters, then
    the earliest. All holders of a passage that at most `few` messages of the conversation hold are candidates. Of a
    passage that more of them hold, the first message of each combination of such passages is: later ones with the same
    combination match no more, unless by a rarer passage, which makes them candidates anyway. Each candidate is then
    credited for all that is quoted of it, so that the choice is that over all pairs, without their being made. Messages
    without a conversation or a turn neither link nor are linked to.
    """
    width = shuffle_width(parsed.sparkSession)
    known = parsed.where("conv_id is not null and turn is not null")
    each = known.select("conv_id", "turn", "msg", F.explode("units").alias("u")).select("conv_id", "turn", "msg", "u.level", "u.hash", "u.chars")
    quoted = frozen(each.where("level > 0").distinct(), "quoted")
    asked = quoted.select("conv_id", "hash").distinct()
    # what nobody quotes makes no candidate
    own = each.where("level = 0").select("conv_id", "hash", F.col("turn").alias("parent_turn"), F.col("msg").alias("parent")).distinct().join(asked, ["conv_id", "hash"], "left_semi")
    counts = own.groupBy("conv_id", "hash").agg(F.count(F.lit(1)).alias("held"))
    held = frozen(own.join(counts, ["conv_id", "hash"]), "holders")
    often = held.where(F.col("held") > few)
    combined = often.groupBy("conv_id", "parent_turn", "parent").agg(F.xxhash64(F.array_sort(F.collect_set("hash"))).alias("both"))
    firsts = combined.groupBy("conv_id", "both").agg(F.min(F.struct("parent_turn", "parent")).alias("f")).select("conv_id", F.col("f.parent").alias("parent")).distinct()
    some = held.where(F.col("held") <= few).drop("held").unionByName(often.drop("held").join(firsts, ["conv_id", "parent"], "left_semi"))
    # dealt anew, so that adaptive execution can split the rows of a phrase quoted very often
    met = quoted.join(some.repartition(width), ["conv_id", "hash"]).where("parent_turn < turn").select("conv_id", "msg", "level", "parent", "parent_turn").distinct()
    credit = met.join(quoted.select("msg", "level", "hash", "chars").distinct(), ["msg", "level"]).join(held.select("conv_id", "hash", "parent", "parent_turn"), ["conv_id", "hash", "parent", "parent_turn"], "left_semi")
    summed = credit.groupBy("msg", "level", "parent", "parent_turn").agg(F.sum("chars").alias("chars"))
    best = summed.groupBy("msg").agg(F.max(F.struct(-F.col("level"), F.col("chars"), -F.col("parent_turn"), F.bitwise_not("parent"), F.col("parent"), F.col("parent_turn"))).alias("b"))
    return best.select("msg", F.col("b.parent").alias("parent"), F.col("b.parent_turn").alias("parent_turn"))


def depths(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(msg, root, root_turn, depth) of each linked message, by pointer doubling: a round doubles the distance covered."""
    at = frozen(links.select("msg", F.col("parent").alias("root"), F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth")), "pointers")
    for _ in range(max_rounds):
        up = at.select(F.col("msg").alias("_m"), F.col("root").alias("_root"), F.col("root_turn").alias("_turn"), F.col("depth").alias("_more"))
        moved = at.join(up, at["root"] == up["_m"], "left")
        after = frozen(
            moved.select("msg", F.coalesce("_root", "root").alias("root"), F.coalesce("_turn", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.col("_m").isNotNull().alias("moved")),
            "pointers",
        )
        at = after.drop("moved")
        if after.where("moved").isEmpty():
            return at
    raise RuntimeError(f"reply chains did not end in {max_rounds} rounds")


def threads(messages: DataFrame, **columns: str) -> DataFrame:
    """One row per message: conv_id, turn, role, body, n_quotes, max_level, reply_to_turn, root_turn, depth.

    Rows are range-sorted by conversation, root, depth and turn, so that a conversation is a stretch of the result, each
    message after the one it replies to, and no task holds a conversation. A message that replies to none is its own
    root at depth 0. A null text is empty; rows that repeat are all returned, alike; a message whose quotes nobody wrote
    is a root; an empty table stays empty; extra columns are not read.
    """
    parsed = frozen(parse(messages, **columns), "messages")
    quotes = F.size(F.filter("units", lambda u: u["level"] > 0)).cast("long").alias("n_quotes")
    slim = parsed.select("conv_id", "turn", "role", "msg", "body", quotes, "max_level")
    plain = slim.where("max_level = 0").select("conv_id", "turn", "role", "body", "n_quotes", "max_level", F.lit(None).cast("long").alias("reply_to_turn"), F.col("turn").cast("long").alias("root_turn"), F.lit(0).alias("depth"))
    quoting = slim.where("max_level > 0")
    links = frozen(reply_links(parsed), "replies")
    placed = frozen(links.join(depths(links), "msg").select("msg", "parent_turn", F.col("root_turn").alias("_root"), F.col("depth").alias("_depth")), "placed")
    linked = quoting.join(placed, "msg", "left").select(
        "conv_id", "turn", "role", "body", "n_quotes", "max_level", F.col("parent_turn").cast("long").alias("reply_to_turn"),
        F.coalesce("_root", "turn").cast("long").alias("root_turn"), F.coalesce("_depth", F.lit(0)).alias("depth"),
    )
    return plain.unionByName(linked).orderBy("conv_id", "root_turn", "depth", "turn")
