"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secret scans, source mix.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept, and returns a DataFrame that is written
as Parquet and read again. All but the last return the columns of documents, more columns included and whatever they are
called; the last returns what the mix takes. An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verifold.llm import decontaminate, mixing, quality, secret_scan, simhash
from verifold.llm.common import frozen, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and the n-gram likelihood ratio; the ratio is fitted on docs themselves.

    A null or wordless text is rejected; a null id is judged like any other; repeated rows are judged alike.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id: five-word shingles, a similarity of 0.8.

    Rows with a null id that no id represents stay; of repeated rows one stays; wordless texts are copies of each other.
    """
    return simhash.keep_first(docs, simhash.near_copies(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no question and answer of a benchmark item.

    A null text holds none and stays; repeated rows go or stay together; rows with a null id go if one of them holds an item.
    """
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark. A null text stays null; repeated rows stay alike."""
    return secret_scan.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and taken, the words that the mix takes of it.

    A null text has size 0 and is taken 0 times; a null source is a source of its own; repeated rows are documents of their own.
    """
    laid, placements = mixing.mix(docs)
    return mixing.taken(laid, placements).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("source mix", mixing_stage),
]

#: SQL can express neither hashed n-gram ratios and fingerprints nor the mix's draws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = frozen(docs, f"stage-{k}")
    return docs
