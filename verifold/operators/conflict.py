"""Contradictions, arbitration, integrity and bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import truth
from ..sources.shared import frozen
from . import identity

# What makes a text a denial, and what each denial is turned into before texts are compared.
TRIGGERS = ("not ", "don't", "hate")
REWRITES = (("hate", "like"), ("don't", ""), ("not", ""))


def flips(rows: DataFrame) -> DataFrame:
    """Long-form rows whose boolean differs from the boolean that the key held before; other changes are no contradiction."""
    w = Window.partitionBy("object_id", "key").orderBy("timestamp", "id")
    now, before = F.lower("raw"), F.lower(F.lag("raw").over(w))
    return rows.withColumn("was", before).where(now.isin("true", "false") & F.col("was").isin("true", "false") & (now != F.col("was")))


def denials(text: Column) -> Column:
    """What a text would say without its denial: one candidate per rewrite that applies; none without a trigger."""
    low = F.lower(text)
    trigger = low.contains(TRIGGERS[0])
    for t in TRIGGERS[1:]:
        trigger = trigger | low.contains(t)
    each = F.array(*[F.when(low.contains(a), F.trim(F.replace(low, F.lit(a), F.lit(b)))) for a, b in REWRITES])
    return F.when(trigger, F.filter(each, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


#: Namespaces of at most so many distinct denied texts compare each of their texts with all of these.
DIRECT = 256
#: Texts meet by the rarest of their runs of so many characters.
GRAM = 4
#: So many distinct runs are broadcast at most; more are merged.
GRAMS = 1 << 18


def runs_of(text: Column, n: int) -> Column:
    """The runs of n characters of a text, the text itself if it is shorter."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (n - 1))), lambda i: F.substring(text, i, F.lit(n)))


def contained(inner: DataFrame, outer: DataFrame, by: str, size: int = GRAM) -> DataFrame:
    """(by, inner, outer) of distinct texts (by, text) of one group where the first is a part of the second.

    A text is known by one run of characters, the one that fewest of all outer texts have; it meets those of its group that
    have the run, and only these are compared. Of outer texts only such runs are sent, not all that they have. Texts shorter than a run are known by all they are, an empty one is a part of
    every text. Null texts are part of nothing; null groups are no group.
    """
    have = outer.where(F.col("text").isNotNull() & F.col(by).isNotNull()).select(by, "text").distinct()
    asks = inner.where(F.col("text").isNotNull() & F.col(by).isNotNull()).select(by, "text").distinct()
    tried = asks.select(by, "text", F.explode(F.array_distinct(runs_of(F.col("text"), size))).alias("gram"))
    # shorter runs, and the empty one, only where a group asks for a text that short
    short = asks.where(F.length("text") < size).select(by).distinct()
    less = F.array_distinct(F.concat(F.array(F.lit("")), *[runs_of(F.col("text"), n) for n in range(1, size)]))
    outers = have.select(by, F.col("text").alias("outer"), F.explode(F.array_distinct(runs_of(F.col("text"), size))).alias("gram")).where(F.length("gram") == size)
    posted = outers.unionByName(have.join(short.hint("merge"), by, "left_semi").select(by, F.col("text").alias("outer"), F.explode(less).alias("gram")))
    small = lambda df: F.broadcast(df) if df.count() <= GRAMS else df.hint("merge")
    counts = frozen(posted.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")), "grams")
    # a text with a run that nobody has is a part of nothing
    known = tried.join(small(counts), "gram", "left").groupBy(by, "text").agg(F.min_by(F.struct("gram", "_n"), F.struct(F.coalesce("_n", F.lit(0).cast("long")), "gram")).alias("_g"))
    known = frozen(known.where("_g._n IS NOT NULL").select(by, "text", F.col("_g.gram").alias("gram")), "known")
    wanted = posted.join(small(known.select("gram").distinct()), "gram", "left_semi")
    met = known.withColumnRenamed("text", "inner").join(wanted.hint("merge"), [by, "gram"])
    return met.where(F.col("outer").contains(F.col("inner"))).select(by, "inner", "outer")


def textual(memories: DataFrame, by: str = "namespace", direct: int = DIRECT) -> DataFrame:
    """Denials and the first earlier text of their namespace that says the denied: (namespace, id, other_id).

    Only denials look back, and only within a namespace; of the earlier texts that contain or are contained in a
    candidate, the first by order counts. memories: namespace, id, ord, text; what has no order is earlier than nothing.
    A namespace's texts meet its distinct candidates as they are while these are at most `direct`; in other namespaces
    only texts that share a rare run of characters are compared.
    """
    said = memories.where(F.col("text").isNotNull() & F.col(by).isNotNull() & F.col("ord").isNotNull()).select(F.col(by).alias("_b"), "id", "ord", F.col("text").alias("_raw"), F.lower("text").alias("text"))
    asks = frozen(said.where(F.size(denials(F.col("_raw"))) > 0).select("_b", "id", "ord", F.explode(denials(F.col("_raw"))).alias("p")), "asks")
    wants = asks.select("_b", "p").distinct()
    counts = wants.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    busy = frozen(counts.where(F.col("_n") > direct).select("_b"), "busy")
    texts = said.groupBy("_b", "text").agg(F.min(F.struct("ord", "id")).alias("_f"))
    # merged, not broadcast: Parquet files say little about the size of what is made of them
    crowded = not busy.isEmpty()
    texts = frozen(texts, "texts") if crowded else texts
    few = wants.join(busy.hint("merge"), "_b", "left_anti") if crowded else wants
    # an ask needs the first time alone that its candidate is met: if that isn't earlier, none is; so texts that repeat count once
    found = texts.join(few.hint("merge"), "_b").where(F.col("text").contains(F.col("p")) | F.col("p").contains(F.col("text"))).groupBy("_b", "p").agg(F.min("_f").alias("_f"))
    if crowded:
        own = frozen(texts.join(busy.hint("merge"), "_b", "left_semi").select("_b", "text"), "crowded")
        many = wants.join(busy.hint("merge"), "_b", "left_semi").select("_b", F.col("p").alias("text"))
        both = contained(many, own, "_b").select("_b", F.col("inner").alias("p"), F.col("outer").alias("t"))
        # a part of a candidate begins and ends with runs of its namespace's candidates; few texts do, and no others are cut into runs
        runs = frozen(many.select("_b", F.explode(runs_of(F.col("text"), GRAM)).alias("gram")).distinct(), "runs")
        parts = own.where(F.length("text") >= GRAM).withColumns({"first": F.left("text", F.lit(GRAM)), "last": F.right("text", F.lit(GRAM))})
        for end in ("first", "last"):
            parts = parts.join(runs.withColumnRenamed("gram", end).hint("merge"), ["_b", end], "left_semi")
        parts = parts.select("_b", "text").unionByName(own.where(F.length("text") < GRAM))
        both = both.unionByName(contained(parts, many, "_b").select("_b", F.col("outer").alias("p"), F.col("inner").alias("t"))).distinct()
        found = found.unionByName(both.join(texts.withColumnRenamed("text", "t").hint("merge"), ["_b", "t"]).groupBy("_b", "p").agg(F.min("_f").alias("_f")))
    met = asks.join(found, ["_b", "p"]).where(F.col("_f.ord") < F.col("ord"))
    return met.groupBy(F.col("_b").alias(by), "id").agg(F.min_by("_f.id", "_f").alias("other_id"))


def arbitration_score(rows: DataFrame) -> Column:
    """Of a claim as it comes in: its confidence, authority 1 for users and 0.5 for others, fresh, uncorroborated."""
    return truth.score(F.col("confidence"), F.when(F.col("actor") == "USER", 1.0).otherwise(0.5), F.lit(1.0), F.lit(0.0))


def winners(claims: DataFrame, value: str, digits: int = 6) -> DataFrame:
    """The claim that stands per entity and key: the best score, of equal ones the first."""
    scored = claims.withColumn("score", F.round(arbitration_score(claims), digits))
    best = F.max_by(F.struct("id", value, "score"), F.struct("score", -F.unix_micros(F.col("timestamp").cast("timestamp")), -F.col("id")))
    return scored.groupBy("object_id", "key").agg(best.alias("_b")).select("object_id", "key", F.col("_b.id").alias("id"), F.col(f"_b.{value}").alias(value), F.col("_b.score").alias("score"))


def arbitration_log(claims: DataFrame, digits: int = 6) -> DataFrame:
    """claims with score, best_before and accepted: a claim replaces what stands only if it scores strictly more."""
    w = Window.partitionBy("object_id", "key").orderBy("timestamp", "id").rowsBetween(Window.unboundedPreceding, -1)
    scored = claims.withColumn("score", F.round(arbitration_score(claims), digits)).withColumn("best_before", F.max("score").over(w))
    return scored.withColumn("accepted", F.col("best_before").isNull() | (F.col("score") > F.col("best_before")))


def precedence(claims: DataFrame, value: str) -> DataFrame:
    """The claim with most authority, then the newest, then the best corroborated."""
    best = F.max_by(F.struct("id", value), F.struct("authority", "timestamp", "corroboration", "id"))
    return claims.groupBy("object_id", "key").agg(best.alias("_b")).select("object_id", "key", F.col("_b.id").alias("id"), F.col(f"_b.{value}").alias(value))


def drifted(text: Column, domain: Column, forbidden: dict[str, list[str]]) -> Column:
    """Whether a text of a domain uses one of the domain's forbidden terms."""
    out = F.lit(False)
    for name, terms in forbidden.items():
        for t in terms:
            out = out | ((domain == name) & F.lower(text).contains(t))
    return out


def _sound() -> Column:
    """Whether vec has components, all of them finite."""
    each = F.forall(F.col("vec").cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size("vec") > 0) & each, F.lit(False))


def _sums(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., dims, pos, total, n) of the vectors in rows: partial sums per task, so that a shuffle carries as many numbers as there are centroids."""
    each = rows.where(_sound()).select(*by, F.size("vec").alias("dims"), F.posexplode(F.col("vec").cast("array<double>")).alias("pos", "x"))
    return each.groupBy(*by, "dims", "pos").agg(F.sum("x").alias("total"), F.count(F.lit(1)).alias("n"))


def _vector(value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", value.alias("x")))), lambda e: e["x"])


def past_centroids(rows: DataFrame) -> DataFrame:
    """(domain, dims, window, n, now, before_n, before) of rows (domain, window, vec): the centroid of each window of a
    domain, and that of all its windows before, null in the first. Windows may be of any type that has an order.

    Vectors of different lengths are different domains; those that are null or empty or hold anything not finite take no part.
    """
    w = Window.partitionBy("domain", "dims", "pos").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    run = _sums(rows, ["domain", "window"]).withColumn("past", F.sum("total").over(w)).withColumn("past_n", F.sum("n").over(w))
    g = run.groupBy("domain", "dims", "window").agg(F.max("n").alias("n"), _vector(F.col("total") / F.col("n")).alias("now"), F.max("past_n").alias("before_n"), _vector(F.col("past") / F.col("past_n")).alias("before"))
    return g.withColumn("before", F.when(F.col("before_n").isNotNull(), F.col("before")))


def centroid_drift(rows: DataFrame, most: float = 0.3) -> DataFrame:
    """(domain, dims, window, n, distance, drifted): how far, by cosine distance, a window's centroid is from that of all before it.

    A domain's first window has no distance and hasn't drifted; nor has one whose centroid, or that before it, is zero.
    """
    d = past_centroids(rows).withColumn("distance", F.when(F.col("before").isNotNull(), 1 - identity.cosine(F.col("now"), F.col("before"))))
    return d.select("domain", "dims", "window", "n", "distance", F.coalesce(F.col("distance") > most, F.lit(False)).alias("drifted"))


def strays(rows: DataFrame, most: float = 1.0) -> DataFrame:
    """rows (domain, window, vec, ...) with distance, from the centroid of their domain's earlier windows, and quarantined if that is above `most`.

    Rows of a first window, and those whose vector takes no part, have no distance and pass.
    """
    past = past_centroids(rows).where("before is not null").select(F.col("domain").alias("_d"), F.col("window").alias("_w"), F.col("dims").alias("_n"), F.col("before").alias("_past"))
    met = rows.join(past, (F.col("domain") == F.col("_d")) & (F.col("window") == F.col("_w")) & (F.size("vec") == F.col("_n")), "left")
    far = F.when(F.col("_past").isNotNull() & _sound(), 1 - identity.cosine(F.col("vec"), F.col("_past")))
    return met.withColumn("distance", far).withColumn("quarantined", F.coalesce(F.col("distance") > most, F.lit(False))).drop("_d", "_w", "_n", "_past")


def violations(state: DataFrame, keys: list[str]) -> DataFrame:
    """State rows (object_id, key, num) that are negative where they must not be."""
    return state.where(F.col("key").isin(keys) & (F.col("num") < 0))


def bursts(events: DataFrame, seconds: int = 1, most: float = 5000.0) -> DataFrame:
    """(start, n, per_second) of tumbling windows with more events a second than `most`; works on streams too."""
    ts = F.col("timestamp").cast("timestamp")
    g = events.groupBy(F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), "n", (F.col("n") / seconds).alias("per_second")).where(F.col("per_second") > most)
