"""Secret scans: three fixed patterns, then character Markov models. DataFrame functions only.

Two first-order Markov chains over characters are trained from labelled samples, one of random strings, one of ordinary
identifiers. What the patterns leave of a candidate token is a secret if the mean log-likelihood ratio of its character
pairs reaches a threshold; else those of its stretches are that reach it, so that a name or path before a secret does not
hide it. Positions are code points, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_bound, private, words
from .quality import let, numbers

# Fixed values of the contract: kinds, in order, and their patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 6

#: A candidate of the method; long enough for the ratio to tell.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Generated random strings of 20 characters score 2.5 or more in 99 of 100 cases, ordinary words and identifiers below 1.
THRESHOLD = 2.5
#: A stretch is long enough from LEAST characters on. It goes on while the ratios, less FLOOR each, sum to more than 0 and
#: to no more than DROP below their peak, where it ends; a piece of up to SNAP characters to the next separator is its own.
LEAST, FLOOR, DROP, SNAP = 20, 1.0, 10.0, 4
#: Bounds of the labelled samples.
RANDOM_ROWS, DOC_ROWS, WORD_ROWS = 4000, 2000, 20_000

#: The states of the chains: start, then the characters; anything else shares the last state.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
STATES = len(ALPHABET) + 2


def matches(text: Column, pattern: str, keep=None) -> Column:
    """Leftmost non-overlapping matches as (s, e, m): code points and the matched text.

    A text is cut at its matches; the lengths of the pieces and of the matches give the places, in one pass each.
    """

    def spans(found: Column) -> Column:
        def placed(pieces: Column) -> Column:
            zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))
            lens = F.transform(found, lambda m, i: F.struct(F.length(F.get(pieces, i)).alias("gap"), m.alias("m")))
            step = lambda a, x: F.struct(
                (a["at"] + x["gap"] + F.length(x["m"])).alias("at"),
                F.array_append(a["out"], F.struct((a["at"] + x["gap"]).alias("s"), (a["at"] + x["gap"] + F.length(x["m"])).alias("e"), x["m"].alias("m"))).alias("out"),
            )
            return F.aggregate(lens, zero, step, lambda a: a["out"])

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), placed)).otherwise(no_spans())

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def no_spans() -> Column:
    return F.array().cast("array<struct<s:int,e:int,m:string>>")


def kind_spans(text: Column) -> list[Column]:
    """The spans of the three fixed kinds; each pattern only runs where a cheap test finds what it needs."""
    lower = F.lower(text)
    keyed = lower.contains(KEYWORDS[0])
    for k in KEYWORDS[1:]:
        keyed = keyed | lower.contains(k)
    long_value = lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= ASSIGN_LEAST
    assign = F.when(keyed, F.filter(matches(text, ASSIGN), long_value)).otherwise(no_spans())
    access = F.when(text.contains("AKIA"), matches(text, ACCESS)).otherwise(no_spans())
    hexa = F.when(text.rlike(HEX), matches(text, HEX)).otherwise(no_spans())
    return [assign, access, hexa]


def state_of(c: Column) -> Column:
    """1 + the place of a character in the alphabet; the last state for any other."""
    at = F.instr(F.lit(ALPHABET), c)
    return F.when(at > 0, at).otherwise(F.lit(STATES - 1))


def pairs(s: Column) -> Column:
    """Transition numbers of a string, from the start state on."""
    at = lambda i: state_of(F.substring(s, i, 1))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.when(i > 1, at(i - 1)).otherwise(F.lit(0)) * STATES + at(i))


def random_strings(spark: SparkSession, rows: int = RANDOM_ROWS, seed: int = 42) -> DataFrame:
    """A labelled sample of random strings: base64, hex, and letters and digits in one or both cases."""
    raw = F.sha2(F.concat_ws(":", F.lit(seed), "id"), 512)
    sixty_four = F.regexp_replace(F.base64(F.unhex(raw)), "[\r\n]", "")
    alnum = F.regexp_replace(sixty_four, "[+/=]", "")
    form = F.pmod(F.col("id"), F.lit(4))
    token = F.when(form == 0, F.substring(sixty_four, 1, 40)).when(form == 1, F.substring(raw, 1, 40)).when(form == 2, F.substring(alnum, 1, 36)).otherwise(F.substring(F.upper(alnum), 1, 32))
    return spark.range(rows).select(token.alias("sample"), F.lit(True).alias("random"))


def identifiers(docs: DataFrame, doc_rows: int = DOC_ROWS, word_rows: int = WORD_ROWS) -> DataFrame:
    """A labelled sample of ordinary identifiers: words of at most `doc_rows` documents, alone and joined as code and paths join them.

    The documents are those whose ids hash lowest, the words those that hash lowest. Ids are chosen without their texts,
    which then stay where they are until they are cut into words.
    """
    known = docs.select("doc_id", "text").where("text is not null")
    some = known.where(F.xxhash64("doc_id") <= hash_bound(known, ["doc_id"], doc_rows))
    plain = some.select(F.explode(words(F.col("text"))).alias("w")).where(F.col("w").rlike("^[A-Za-z]{2,40}$")).distinct().orderBy(F.xxhash64("w")).limit(word_rows)
    low, form = F.lower("w"), F.pmod(F.xxhash64(F.lit(7), "w"), F.lit(6))
    half = F.substring(low, 1, 12)
    joined = (
        F.when(form == 0, F.col("w")).when(form == 1, F.concat(low, F.lit("_"), F.reverse(half))).when(form == 2, F.concat(low, F.initcap(low)))
        .when(form == 3, F.concat(F.lit("/"), low, F.lit("/"), low)).when(form == 4, F.concat(F.upper("w"), F.lit("_"), F.upper(half))).otherwise(F.concat(low, F.lit("-"), low, F.lit("-2024")))
    )
    return plain.select(joined.alias("sample"), F.lit(False).alias("random"))


def chain_ratio(samples: DataFrame) -> list[float]:
    """log(P_random(b | a) / P_identifier(b | a)) for each pair of states, from rows (sample, random).

    Both chains have STATES^2 transitions, which bounds what the driver gets. Without samples of a label its chain is
    uniform. Null samples are passed over.
    """
    counts = samples.where("sample is not null and random is not null").select("random", F.explode(pairs(F.col("sample"))).alias("t")).groupBy("t").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("i")).collect()
    seen = [[0] * (STATES * STATES), [0] * (STATES * STATES)]
    for x in counts:
        seen[0][x["t"]], seen[1][x["t"]] = x["r"], x["i"]
    random, plain = (transitions(c) for c in seen)
    return [math.log(r) - math.log(i) for r, i in zip(random, plain)]


def transitions(counts: list[int], prior: float = 5.0) -> list[float]:
    """P(b | a) of a chain: what follows a state, backed by `prior` draws from what follows any, itself smoothed by 1/2."""
    follows = [0.5 + sum(counts[b::STATES]) for b in range(STATES)]
    whole, out = sum(follows), []
    for a in range(STATES):
        row = counts[a * STATES : (a + 1) * STATES]
        n = sum(row) + prior
        out += [(c + prior * f / whole) / n for c, f in zip(row, follows)]
    return out


def mean_ratio(s: Column, ratio: list[float]) -> Column:
    return F.aggregate(pairs(s), F.lit(0.0), lambda a, t: a + F.get(numbers(ratio), t)) / F.greatest(F.length(s), F.lit(1))


def outside(spans: list[Column], x: Column) -> Column:
    clear = F.lit(True)
    for own in spans:
        clear = clear & ~F.exists(own, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
    return clear


def left_over(spans: list[Column], x: Column) -> Column:
    """The parts of a candidate that no span covers, where they are long enough."""
    own = F.sort_array(F.concat(*[F.transform(F.filter(k, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])), lambda y: F.struct(y["s"].alias("s"), y["e"].alias("e"))) for k in spans]))
    part = lambda s, e: F.struct(s.alias("s"), e.alias("e"), F.substring(x["m"], s - x["s"] + 1, e - s).alias("m"))
    zero = F.struct(x["s"].alias("at"), no_spans().alias("out"))
    step = lambda a, y: F.struct(F.greatest(a["at"], y["e"]).alias("at"), F.when(y["s"] - a["at"] >= LEAST, F.array_append(a["out"], part(a["at"], y["s"]))).otherwise(a["out"]).alias("out"))
    rest = F.aggregate(own, zero, step, lambda a: F.when(x["e"] - a["at"] >= LEAST, F.array_append(a["out"], part(a["at"], x["e"]))).otherwise(a["out"]))
    return F.when(outside(spans, x), F.array(x)).otherwise(rest)


def stretches(v: Column) -> Column:
    """Where the ratios v of a string's pairs stay high, as (s, e); one pass."""
    span = lambda a: F.when((a["peak"] > 0) & (a["e"] - a["s"] >= LEAST - 2 * SNAP), F.array_append(a["out"], F.struct(a["s"].alias("s"), a["e"].alias("e")))).otherwise(a["out"])

    def step(a: Column, r: Column) -> Column:
        over = (a["now"] <= 0) | (a["now"] < a["peak"] - DROP)
        now, peak = F.when(over, F.lit(0.0)).otherwise(a["now"]) + r - FLOOR, F.when(over, F.lit(0.0)).otherwise(a["peak"])
        return F.struct(
            (a["i"] + 1).alias("i"), now.alias("now"), F.greatest(peak, now).alias("peak"), F.when(over, a["i"]).otherwise(a["s"]).alias("s"),
            F.when(now > peak, a["i"] + 1).when(over, a["i"]).otherwise(a["e"]).alias("e"), F.when(over, span(a)).otherwise(a["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("now"), F.lit(0.0).alias("peak"), F.lit(0).alias("s"), F.lit(0).alias("e"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    return F.aggregate(v, zero, step, span)


def random_parts(x: Column, ratio: list[float], threshold: float) -> Column:
    """A candidate as a whole if its mean ratio reaches the threshold, else its stretches that do."""

    def judged(v: Column) -> Column:
        mean = lambda s, e: F.aggregate(F.slice(v, s + 1, e - s), F.lit(0.0), lambda a, r: a + r) / F.greatest(e - s, F.lit(1))

        def snapped(y: Column) -> Column:
            before = F.length(F.regexp_extract(F.substring(x["m"], F.lit(1), y["s"]), "[^/=_-]*$", 0))
            after = F.length(F.regexp_extract(F.substring(x["m"], y["e"] + 1, F.length(x["m"])), "^[^/=_-]*", 0))
            s, e = y["s"] - F.when(before <= SNAP, before).otherwise(F.lit(0)), y["e"] + F.when(after <= SNAP, after).otherwise(F.lit(0))
            return F.struct(s.alias("s"), e.alias("e"))

        high = F.filter(F.transform(stretches(v), snapped), lambda y: (y["e"] - y["s"] >= LEAST) & (mean(y["s"], y["e"]) >= threshold))
        placed = F.transform(high, lambda y: F.struct((x["s"] + y["s"]).alias("s"), (x["s"] + y["e"]).alias("e"), F.substring(x["m"], y["s"] + 1, y["e"] - y["s"]).alias("m")))
        return F.when(mean(F.lit(0), F.size(v)) >= threshold, F.array(x)).otherwise(placed)

    return let(F.transform(pairs(x["m"]), lambda t: F.get(numbers(ratio), t)), judged)


def with_spans(docs: DataFrame, ratio: list[float], text_col: str = "text", threshold: float = THRESHOLD, prefix: str = "") -> DataFrame:
    """docs with assign, access, hex and markov: arrays of (s, e, m) beside their own columns.

    A null text is empty and has no spans. Rows are judged one by one; repeated rows, ties and null ids change nothing.
    `prefix` goes before the new names; a column of docs with one of them is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    based = docs.withColumns({prefix + k: v for k, v in zip(KINDS, kind_spans(text))})
    base = [F.col(prefix + k) for k in KINDS[:3]]
    rest = F.flatten(F.transform(matches(text, CANDIDATE), lambda x: left_over(base, x)))
    found = F.flatten(F.transform(rest, lambda x: random_parts(x, ratio, threshold)))
    return based.withColumn(prefix + "markov", F.when(text.rlike(CANDIDATE), found).otherwise(no_spans()))


def listed(kinds: tuple[str, ...], prefix: str = "") -> Column:
    """kind:start:end of all spans, by start, then kind as listed, comma-joined."""

    def of(n: int, kind: str) -> Column:
        return F.transform(F.col(prefix + kind), lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("n"), F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")).alias("t")))

    each = [of(n, kind) for n, kind in enumerate(kinds)]
    return F.array_join(F.transform(F.sort_array(F.concat(*each)), lambda x: x["t"]), ",")


def scan(docs: DataFrame, threshold: float = THRESHOLD, ratio: list[float] | None = None, prefix: str = "") -> DataFrame:
    """with_spans() under a model trained from generated random strings and from identifiers of docs themselves."""
    if ratio is None:
        ratio = chain_ratio(random_strings(docs.sparkSession).unionByName(identifiers(docs)))
    return with_spans(docs, ratio, threshold=threshold, prefix=prefix)


def redacted(docs: DataFrame, mark: str = "[SECRET]", **how) -> DataFrame:
    """docs with every span of the scan replaced by `mark` in text, and n_chars set anew where text changed.

    Spans that overlap are replaced as one. A null text stays null, repeated rows stay, an empty table stays empty. The
    other columns of docs keep their values, whatever they are called.
    """
    p = private(docs)
    spans = scan(docs, prefix=p, **how)
    every = F.sort_array(F.concat(*[F.transform(F.col(p + k), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in KINDS]))
    # pieces of text between spans, from left to right
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        fresh = F.array_append(F.array_append(a["out"], F.col("text").substr(a["at"] + 1, F.greatest(x["s"] - a["at"], F.lit(0)))), F.lit(mark))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] >= a["at"], fresh).otherwise(a["out"]).alias("out"))

    def join(a: Column) -> Column:
        return F.concat(F.array_join(a["out"], ""), F.col("text").substr(a["at"] + 1, F.length("text")))

    clean = F.when(F.size(every) > 0, F.aggregate(every, zero, step, join)).otherwise(F.col("text"))
    out = spans.withColumn(p + "clean", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(p + "clean").eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(p + "clean").cast(docs.schema["n_chars"].dataType)))
    return out.withColumn("text", F.col(p + "clean")).select(*docs.columns)
