"""The corpus pipeline: documents to a training mix, one written table per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hunkwise.llm import decontam, linededup, mixing, simhash, toxicity
from hunkwise.llm.common import free, scratch_until_done, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and nearly equal lines the first stays; documents left without a word go."""
    return linededup.clean(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document that it takes, with the number of its copies."""
    taken = mixing.mix(docs).where("copies > 0")
    return taken.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("source_mixing", mix_sources),
]

#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next stage's input. What a stage has
    read and written for itself is deleted when its result stands."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch_until_done(spark):
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        if before is not None:
            free(before)
        before = docs
    return docs
