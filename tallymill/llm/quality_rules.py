"""Quality rules per document and a verdict per host, with built-in functions only.

Every document is measured: words, word characters, symbols, repeated lines and words in
repeated 5-word windows. Failures of the base rule are summed by host (`source`), each host's
rate is shrunk towards a beta prior fitted to the rates of all hosts, and documents of hosts
whose shrunk rate is above `limit` are rejected together.

Null text counts as empty: no words, so the base rule rejects it. A null host is a host of its
own. Repeated rows are judged one by one. An empty table gives an empty result. Columns of the
input named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import if_small, words_of
from tallymill.session import durable

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
HOST_LIMIT = 0.5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VERDICTS = ["base_failed", "kept"]
# Working columns.
_WORDS, _LINES, _WINDOWS, _ORDERED, _PLACES = (
    "__words", "__lines", "__windows", "__ordered", "__places")


def _neighbours(array: str, step) -> Column:
    """`step(a, b)` for each two neighbours of an array column."""
    count = F.greatest(F.size(array) - 1, F.lit(0))
    return F.zip_with(F.slice(array, 1, count), F.slice(array, 2, count), step)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with MEASURES and `base_failed`.

    Repeated windows: their digests are sorted with their places, so that repeats are
    neighbours; each place then covers min(5, distance to the next place) words.
    """
    body, words = F.coalesce(F.col(text), F.lit("")), F.col(_WORDS)
    count = F.size(words)
    df = docs.withColumn(_WORDS, words_of(F.col(text)))
    df = df.withColumns({
        _LINES: F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
        _WINDOWS: F.when(count >= WINDOW, F.transform(
            F.sequence(F.lit(0), count - WINDOW),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))),
        "n_words": count.cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(body, "[^#*$%&|<>]+", "")).cast("long"),
    }).drop(_WORDS)
    df = df.withColumns({
        "n_dup_lines": (F.size(_LINES) - F.size(F.array_distinct(_LINES))).cast("long"),
        _ORDERED: F.when(
            F.size(F.array_distinct(_WINDOWS)) < F.size(_WINDOWS),
            F.array_sort(F.transform(
                _WINDOWS, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    }).drop(_LINES, _WINDOWS)
    df = df.withColumn(_PLACES, F.array_sort(F.array_distinct(F.flatten(F.filter(
        _neighbours(_ORDERED, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))),
        lambda x: x.isNotNull()))))).drop(_ORDERED)
    covered = F.aggregate(_neighbours(_PLACES, lambda a, b: F.least(b - a, F.lit(WINDOW))),
                          F.lit(WINDOW), lambda total, x: total + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(_PLACES)
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))


def host_rates(measures: DataFrame, host: str = "source") -> DataFrame:
    """Per host: `n_docs`, `n_failed` and `rate`, shrunk by a beta prior.

    The prior is fitted to the hosts' own rates (mean and variance). Where the hosts do not
    differ, or there is only one, it weighs as much as one document with the mean rate.
    """
    hosts = measures.groupBy(host).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("spread"))
    weight = F.greatest(F.col("mean") * (1 - F.col("mean")) / F.nullif("spread", F.lit(0.0)) - 1,
                        F.lit(1.0))
    prior = moments.select("mean", F.coalesce(weight, F.lit(1.0)).alias("weight"))
    one = prior.select(F.struct("mean", "weight"))
    return hosts.withColumn("__prior", one.scalar()).select(
        host, "n_docs", "n_failed",
        ((F.col("n_failed") + F.col("__prior.mean") * F.col("__prior.weight"))
         / (F.col("n_docs") + F.col("__prior.weight"))).alias("rate"))


def rejected_hosts(measures: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The hosts that go, written: Spark broadcasts them while they are few."""
    return if_small(durable(host_rates(measures, host).where(F.col("rate") > limit).select(
        F.col(host).alias("__host"), F.lit(True).alias("__rejected"))))


def judged(docs: DataFrame, columns: list[str], text: str = "text", host: str = "source",
           limit: float = HOST_LIMIT) -> DataFrame:
    """`columns` of `docs` with MEASURES, `base_failed` and `kept`.

    The measures are written once; hosts are summed from them and joined back.
    """
    wanted = list(dict.fromkeys([*columns, host, text]))
    rows = measured(docs.select(*wanted), text)
    if text not in columns:
        rows = rows.drop(text)
    rows = durable(rows)
    bad = rejected_hosts(rows.select(host, "base_failed"), host, limit)
    joined = rows.join(bad, F.col(host).eqNullSafe(F.col("__host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("__rejected").isNull()).select(
        *columns, *MEASURES, *VERDICTS)


def passing(docs: DataFrame, text: str = "text", host: str = "source",
            limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of `docs` that are kept, all columns as they were.

    Rows of whole hosts go only after all failures are known. Until then, rows that fail the
    base rule are carried without their text.
    """
    kept = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias(text),
                       F.col(host).alias(host))
    rows = measured(kept, text).select(
        F.when(~F.col("base_failed"), F.col("row")).alias("row"), host, "base_failed")
    rows = durable(rows)
    bad = rejected_hosts(rows.select(host, "base_failed"), host, limit)
    return rows.where(~F.col("base_failed")).join(
        bad, F.col(host).eqNullSafe(F.col("__host")), "left_anti").select("row.*")
