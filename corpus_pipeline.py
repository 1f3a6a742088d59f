"""A corpus from raw documents: rules, near-dedup, decontamination, redaction, mixing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the documents that go
on, with the columns of documents. The last adds how many copies of each document the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wedgeworks.llm.common import discard, stored, table
from wedgeworks.llm.decontamination import drop_contaminated
from wedgeworks.llm.mixing import mix
from wedgeworks.llm.near_dedup import keep_one
from wedgeworks.llm.pii import redact
from wedgeworks.llm.quality_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects; short ones are as good as long ones, only wordless ones go."""
    return keep_good(docs, min_words=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their number of copies and their source's target."""
    return mix(docs).where(F.col("copies") > 0)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("mixing", mixing),
]
#: Near-dedup, labelers and the order of draws have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = stored(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
