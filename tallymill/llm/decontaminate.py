"""Benchmark items inside documents, by size-partitioned MinHash containment, built-ins only.

Texts are A-Z lower-cased; a shingle is five words (a text of fewer words is one shingle). An
item leaks into a document that holds at least `percent` of its distinct shingles.

Items are partitioned by size, in powers of two. An item's signature is the k smallest digests
of its shingles, where k is one more than the shingles that an item of its partition's upper size
may miss: a document that holds enough of the item then holds at least one of them, so the
search misses nothing. Long documents are not sketched whole (their minima would drown a short
item): every digest below the greatest signature value takes part in the join. Candidates hold
enough signature values; they are verified by exact containment of shingle texts.

Null and empty texts on either side have no shingles and match nothing. Rows that repeat a
doc_id or item_id are compared one by one and reported once per pair of ids; `clean` drops those
that hold an item, not others with their id. Null ids are reported as null. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import if_small, lower_ascii, words_of
from tallymill.session import cut_points, durable

SHINGLE = 5
PERCENT = 80


def _shingles(words: Column, of) -> Column:
    """`of(start, length)` for each shingle of a word array; null without words."""
    count = F.size(words)
    return F.when(count >= SHINGLE, F.transform(
        F.sequence(F.lit(0), count - SHINGLE), lambda i: of(i, SHINGLE)))


def _digests(df: DataFrame, words: str) -> Column:
    w = F.col(words)
    whole = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))
    return F.coalesce(_shingles(w, lambda i, n: F.xxhash64(*[F.get(w, i + k) for k in range(n)])),
                      whole)


def _texts(words: Column) -> Column:
    whole = F.when(F.size(words) > 0, F.array(F.array_join(words, " ")))
    return F.array_distinct(F.coalesce(
        _shingles(words, lambda i, n: F.array_join(F.slice(words, i + 1, n), " ")), whole))


def signatures(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(item key, digest, needed): the signature values, and how many of them a leak must hold."""
    df = items.withColumn("w", words_of(lower_ascii(F.col("text"))))
    df = df.withColumn("d", F.array_sort(F.array_distinct(_digests(df, "w")))).where("d is not null")
    size = F.size("d")
    upper = F.pow(F.lit(2), F.ceil(F.log2(size))).cast("int")
    misses = lambda n: F.floor(n * (100 - percent) / 100)
    df = df.withColumns({"k": F.least(size, misses(upper) + 1).cast("int"),
                         "misses": misses(size).cast("int")})
    return df.select("item_key", F.explode(F.slice("d", 1, F.col("k"))).alias("digest"),
                     (F.col("k") - F.col("misses")).alias("needed"))


def _keyed(df: DataFrame, key: str, id_column: str) -> DataFrame:
    """Rows named by id and text, so that rows sharing an id stay apart."""
    return df.select(F.xxhash64(F.col(id_column), F.col("text")).alias(key),
                     F.col(id_column).alias(id_column), "text")


def leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found): each item that a document holds, written."""
    with cut_points(docs.sparkSession) as cut:
        return durable(_leaks(_keyed(docs, "doc_key", "doc_id"),
                              _keyed(items, "item_key", "item_id").distinct(), percent, cut).groupBy(
            "doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"),
                                     F.max("n_found").alias("n_found")))


def _leaks(docs: DataFrame, items: DataFrame, percent: int,
           cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    wanted = cut(signatures(items, percent))
    bound = wanted.agg(F.max("digest"))
    probes = docs.withColumn("w", words_of(lower_ascii(F.col("text"))))
    probes = probes.withColumn("d", _digests(probes, "w")).withColumn("bound", bound.scalar())
    probes = probes.select("doc_key", F.explode(F.filter(
        "d", lambda h: h <= F.col("bound"))).alias("digest"))
    found = probes.join(if_small(wanted), "digest").groupBy("doc_key", "item_key").agg(
        F.count_distinct("digest").alias("n"), F.first("needed").alias("needed"))
    pairs = cut(found.where("n >= needed").select("doc_key", "item_key"))
    whole = items.withColumn("shingles", _texts(words_of(lower_ascii(F.col("text"))))).select(
        "item_key", "item_id", "shingles")
    # The word lists of candidates only: texts of other documents leave the scan here.
    texts = docs.join(if_small(pairs), "doc_key").withColumn(
        "w", words_of(lower_ascii(F.col("text"))))
    texts = texts.select("doc_key", "doc_id", "item_key", _texts(F.col("w")).alias("held"))
    checked = texts.join(whole, "item_key").select(
        "doc_key", "doc_id", "item_id", F.size("shingles").cast("long").alias("n_shingles"),
        F.size(F.array_intersect("shingles", "held")).cast("long").alias("n_found"))
    return checked.where(F.col("n_found") * 100 >= F.col("n_shingles") * percent)


def clean(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` that hold no item, each judged by its own id and text."""
    with cut_points(docs.sparkSession) as cut:
        held = durable(_leaks(_keyed(docs, "doc_key", "doc_id"),
                              _keyed(items, "item_key", "item_id").distinct(), percent, cut).select(
            F.col("doc_key").alias("__leaked")).distinct())
    return docs.join(if_small(held), F.xxhash64("doc_id", "text") == F.col("__leaked"), "left_anti")
