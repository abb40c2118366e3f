"""URL rules by hashed host-suffix and path-prefix expressions, with built-in functions only.

A rule is (host, path): it fits its host and every subdomain, if the url's path starts with the
rule's. Each distinct (host, path) is expanded into its host suffixes times those path prefixes
whose lengths occur among the rules; expressions meet rules by an equi-join on four digest
bytes, the full SHA-256 then confirms. Of the fitting rules the longest wins (host and path
together), then the longer host, then `block` before `allow`. Urls without a rule are allowed
(`default`).

Null urls and urls without `://` have empty host and path and fit no rule. Repeated rows and null
ids are judged one by one. Empty tables of urls or rules are no special case. Repeated rules count
once; a rule given with both verdicts blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import lower_ascii

KEY_CHARS = 8
DEFAULT = "allow"
RULE_SCHEMA = "rule_host string, rule_path string, rule_verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, "(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "(?s)^[^?#]*", 0)
    return lower_ascii(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    """Of host and path with the host's length before them, so that no other pair reads alike."""
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(" "), host, path), 256)


def _hashed(df: DataFrame, host: str, path: str) -> DataFrame:
    df = df.withColumn("digest", _digest(F.col(host), F.col(path)))
    return df.withColumn("key", F.substring("digest", 1, KEY_CHARS))


def expressions(places: DataFrame, lengths: DataFrame) -> DataFrame:
    """(host, path) rows times host suffixes at label borders and path prefixes of `lengths`.

    `lengths` is one row with the array of path lengths that rules have.
    """
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    df = places.withColumn("lengths", lengths.scalar()).withColumn("suffix", F.explode(suffixes))
    fitting = F.filter("lengths", lambda k: k <= F.length("path"))
    df = df.withColumn("k", F.explode(fitting))
    return _hashed(df.select("host", "path", "suffix", F.expr("left(path, k)").alias("prefix")),
                   "suffix", "prefix")


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """`urls` with host, path, rule (host and path as one text, else null) and verdict.

    Columns of `urls` with these names are replaced.
    """
    host, path = host_and_path(F.col(url))
    placed = urls.withColumns({"host": host, "path": path}).drop("rule", "verdict")
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    lengths = rules.agg(F.array_sort(F.collect_set(F.length("rule_path"))))
    known = _hashed(rules, "rule_host", "rule_path").withColumnRenamed("digest", "rule_digest")
    # One expansion for each distinct place: a hot host or page is summed before it is shuffled.
    found = expressions(placed.select("host", "path").distinct(), lengths).join(known, "key").where(
        F.col("digest") == F.col("rule_digest"))
    best = found.groupBy("host", "path").agg(F.max(F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"),
        F.length("rule_host").alias("host_size"), "rule_verdict", "rule_host", "rule_path",
    )).alias("best")).select(
        F.col("host").alias("__host"), F.col("path").alias("__path"),
        F.concat("best.rule_host", "best.rule_path").alias("rule"),
        F.col("best.rule_verdict").alias("__verdict"))
    joined = placed.join(best, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")),
                         "left")
    return joined.withColumn("verdict", F.coalesce("__verdict", F.lit(default))).drop(
        "__host", "__path", "__verdict")
