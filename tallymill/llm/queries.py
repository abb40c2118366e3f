"""Registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import bpe, decontaminate, exact_dedup, hard_negatives, html_text, ngram_join, quality_rules, substring_dedup, token_counts, toxicity, url_filter, warc, whitening
from tallymill.llm.common import give_package, table

Query = Callable[[SparkSession, str], DataFrame]

# The rules of the url query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.removed(table(spark, folder, "documents"))


def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.linked_documents(table(spark, folder, "documents"))


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), ["doc_id"]).drop("ids")


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA)
    return url_filter.judge(table(spark, folder, "pages").select("page_id", "url"), rules).drop("url")


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(table(spark, folder, "documents"), ["doc_id"])


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return warc.archived(pages).select(
        F.col("id").cast(pages.schema["page_id"].dataType).alias("page_id"), "payload_bytes",
        "payload_digest", "record_type", F.col("refers_to").cast(
            pages.schema["page_id"].dataType).alias("refers_to"))


def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def op11_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.copies(table(spark, folder, "documents"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), anchors=F.col("id") % 50 == 0)


def _with_package(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        give_package(spark)
        return query(spark, folder)

    return run


def all_queries() -> dict[str, Query]:
    return {f.__name__: _with_package(f) for f in (
        op1_token_counts, op2_substring_dedup, op3_ngram_join, op4_bpe, op5_url_filter,
        op6_quality_rules, op7_toxicity, op8_decontaminate, op9_warc, op10_html_text, op11_exact_dedup, op12_whitening,
        op13_hard_negatives)}
