"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, htmlextract, langid, linededup, media, mixing, pii, simhash, toxicity
from .common import table


#: The key of op6's query where the session sets none in ``spark.hunkwise.pii.key``; no secret, so for trials only.
SAMPLE_KEY = "pii-1"


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(table(spark, sf_dir, "conversations"))


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), spark.conf.get("spark.hunkwise.pii.key", SAMPLE_KEY))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlextract.extract(table(spark, sf_dir, "pages"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mixing, op2_language_id, op3_media_columns, op4_line_dedup, op5_chat_formatting, op6_pii_pseudonyms,
        op7_decontamination, op8_html_extraction, op9_simhash_dedup, op10_toxicity,
    )
}
ORACLE_SQL: dict[str, str] = {"op1_source_mixing": mixing.SQL.format(docs="documents")}
