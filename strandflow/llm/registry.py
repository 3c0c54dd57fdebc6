"""Queries of this subpackage, opN_<name>, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandflow.llm import bpe_tree, decontaminate, html_text, licenses, line_dedup, media, ngram_jaccard, prefix_trie, quality, spelling, sql, substring_dedup, token_blocks, winnowing
from strandflow.llm.common import table

TOKENIZER, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.join(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.texts(table(spark, sf_dir, "pages"))


def op4_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op7_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.digests(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_substring_dedup, op3_html_text, op4_bpe_tree, op5_media_columns, op6_line_dedup, op7_token_blocks, op8_quality, op9_decontamination, op10_license_scan, op11_spelling_variants, op12_winnowing, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": sql.OP1, "op2_substring_dedup": sql.OP2, "op6_line_dedup": sql.OP6, "op9_decontamination": sql.OP9, "op10_license_scan": licenses.oracle(), "op11_spelling_variants": sql.OP11, "op13_prefix_trie": sql.OP13}
