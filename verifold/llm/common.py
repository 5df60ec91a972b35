"""What the training-data operators share: tables, the shared folder, words, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graphs import connected_components  # noqa: F401
from ..sources.shared import frozen, shared_path  # noqa: F401

shared_folder = shared_path

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_bound(df: DataFrame, columns: list[str], most: int) -> int:
    """The most-th lowest xxhash64 of the distinct values of some columns; the largest long if there are no more of them.

    Only hashes below a share of the range that holds some 2 * most of them are sorted, so no task gathers more than that
    from all partitions; the share grows until it suffices, and the result is exact.
    """
    hashes = df.select(F.xxhash64(*columns).alias("h"))
    n = hashes.agg(F.approx_count_distinct("h")).first()[0]
    share = 2 * most / max(1, n)
    while share < 1:
        low = hashes.where(F.col("h") <= -(1 << 63) + int(share * 2**64)).distinct().orderBy("h").limit(most)
        found, last = low.agg(F.count(F.lit(1)), F.max("h")).first()
        if found == most:
            return last
        share *= 4
    found, last = hashes.distinct().orderBy("h").limit(most).agg(F.count(F.lit(1)), F.max("h")).first()
    return last if found == most else (1 << 63) - 1


def private(df: DataFrame) -> str:
    """A prefix that no column of df begins with, whatever its case."""
    p = "_own_"
    while any(c.lower().startswith(p) for c in df.columns):
        p = "_" + p
    return p


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id is fold 0 of the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def component_ids(kinds: DataFrame, parts: DataFrame, salts: int = 64) -> DataFrame:
    """(node, component_id) for rows (node, first_id) and the components (node, root) among them: the smallest first_id of a component.

    A component may hold a third of all nodes, so the nodes meet their component's row under a salt; one of a single node
    has one row.
    """
    own = parts.select(F.col("node").alias("_n"), "root")
    rooted = kinds.join(own, F.col("node") == F.col("_n"), "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(salts))
    sizes = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("_size"))
    every = F.when(F.col("_size") > 1, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(salt("root")))
    roots = sizes.select(F.col("root").alias("_root"), "component_id", F.explode(every).alias("_salt"))
    met = rooted.join(roots, (F.col("root") == F.col("_root")) & (salt("node") == F.col("_salt")))
    return met.select("node", "component_id")
