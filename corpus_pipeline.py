"""The corpus pipeline: each stage works on all rows that the stage before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; `run` writes each result as Parquet to
the shared folder and reads it back as the next stage's documents. All but the last return the
columns of documents. There is no SQL: byte-pair encoding has no SQL form, so the pipeline is
tested against a brute-force version instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymill.llm import bpe, decontaminate, ngram_join, quality_rules, substring_dedup
from tallymill.llm.common import give_package, table
from tallymill.session import cut_points, durable

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or whose host is rejected go."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that reach each other by links one stays, that with the smallest id.

    Five-word shingles at a similarity of 0.8, as for all near duplicates on word shingles.
    """
    return ngram_join.one_of_each(docs, size=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are taken out of the texts."""
    return substring_dedup.without_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed), their number, and digests of ids and decoded text."""
    return bpe.round_trip(docs, ["doc_id", "lang", "source"])


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", without_benchmark),
    ("bpe_encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    give_package(spark)
    *stages, (_, last) = STAGES
    with cut_points(spark) as cut:  # results of earlier stages go at the end
        docs = table(spark, sf_dir, "documents")
        for _, stage in stages:
            docs = cut(stage(spark, docs, sf_dir))
        return durable(last(spark, docs, sf_dir))
