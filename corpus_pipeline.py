"""A training-data pipeline over `documents`: STAGES, run() and its SQL.

Stages: reject poor documents, drop lines that many documents repeat, keep one document of each group
of near copies, reject contaminated documents, encode and decode the rest.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm import bpe_tree, decontaminate, line_dedup, ngram_jaccard, quality
from strandflow.llm.common import cut, table
from strandflow.llm.registry import RANKS


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents and their labels, does not reject."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that at least five hold, but for the largest one's; n_chars follows."""
    kept = line_dedup.dedup(docs).drop("n_lines", "n_dropped")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each component of near copies."""
    return ngram_jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less than a twentieth of whose words lie in passages of the benchmark."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return bpe_tree.digests(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", bpe_stage),
]

#: A fitted classifier and a byte-pair encoder have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
