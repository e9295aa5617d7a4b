"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Every stage takes an empty table, null and empty texts, null and repeated ids, repeated rows and very long texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm.common import read_table, stage_table
from tomewright.llm.decontaminate import decontaminate
from tomewright.llm.mixing import mix_sources
from tomewright.llm.quality_rules import keep_by_rules
from tomewright.llm.simhash_dedup import simhash_dedup
from tomewright.llm.substring_dedup import rewrite_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep, each row by its own text; null and empty texts go."""
    return keep_by_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least id: every row that has it. Of rows with a null id those
    stay that are like no other id's."""
    return simhash_dedup(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without words of 20-word windows that also start earlier; n_chars follows the text. Every row stays, if
    with an empty text; a null text stays null."""
    out = rewrite_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found, each row by its own text; null and empty texts stay."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes: none of a null or empty text; a null source is one more."""
    return mix_sources(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Fingerprints, latent retrieval and keyed permutations have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
