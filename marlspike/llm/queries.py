"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, exact, feistel, langid, passages, simhash, template, urlfilter, warc
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.materialised(table(spark, sf_dir, "documents"))


def op3_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extracted(table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.scored(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), urlfilter.SEEDS)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_owners(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_training_order": op2_training_order,
    "op3_html_template": op3_html_template,
    "op4_bpe": op4_bpe,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_url_filter": op6_url_filter,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_simhash": op8_simhash,
    "op9_language_id": op9_language_id,
    "op10_warc": op10_warc,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op5_repeated_passages": passages.oracle(),
    "op6_url_filter": urlfilter.oracle(),
    "op7_exact_dedup": """
        SELECT doc_id, owner_id
        FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS owner_id FROM documents WHERE text IS NOT NULL)
        WHERE doc_id IS DISTINCT FROM owner_id""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
