"""Pages of a list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import accumulate
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.operators.ordinals import PART, ROW, in_ranges
from tallymill.session import durable

PAGE_SIZE = 50
# Rows that a task may keep to find a page.
DEEP = 100_000


def row_count(df: DataFrame) -> DataFrame:
    """One row with `count`."""
    return df.agg(F.count(F.lit(1)).alias("count"))


def page(df: DataFrame, keys: Sequence[str], number: int = 1, size: int = PAGE_SIZE,
         deep: int = DEEP) -> DataFrame:
    """Page `number` (from 1) in key order, with the count of the whole list on each row.

    The order makes pages repeatable and lets Spark keep only the first `number * size` rows of
    each task. Pages beyond `deep` rows are found by counts instead (`_deep_page`).
    """
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    if number * size > deep:
        return _deep_page(df, keys, (number - 1) * size, size)
    rows = df.orderBy(*keys).offset((number - 1) * size).limit(size)
    return rows.withColumn("total_count", row_count(df).scalar())


def _deep_page(df: DataFrame, keys: Sequence[str], offset: int, size: int) -> DataFrame:
    """The rows after `offset`: the list is sorted by range and written, the driver gets the number of
    rows of each range, and only the ranges that hold the page are read again."""
    rows = durable(in_ranges(df.orderBy(*keys)))
    counts = sorted(rows.groupBy(PART).agg(F.count(F.lit(1)).alias("n")).collect())
    starts = dict(zip((c[PART] for c in counts), accumulate((c.n for c in counts), initial=0)))
    held = {c[PART]: starts[c[PART]] for c in counts
            if starts[c[PART]] < offset + size and starts[c[PART]] + c.n > offset}
    start = F.lit(0)
    for part, before in held.items():
        start = F.when(F.col(PART) == part, F.lit(before)).otherwise(start)
    place = start + F.col(ROW)
    return rows.where(F.col(PART).isin(list(held))).where(
        (place >= offset) & (place < offset + size)).drop(PART, ROW).orderBy(*keys).withColumn(
        "total_count", F.lit(sum(c.n for c in counts)).cast("long"))


def page_after(df: DataFrame, last: Mapping[str, Any], size: int = PAGE_SIZE) -> DataFrame:
    """The page after the row whose key columns, in key order, have the values `last`.

    Rows up to that key are filtered out, so a page costs `size` rows of each task however deep it
    lies. Keys must not be null.
    """
    if size < 1:
        raise ValueError("page size starts at 1")
    keys = list(last)
    beyond = reduce(
        lambda rest, k: (F.col(k) > F.lit(last[k])) | ((F.col(k) == F.lit(last[k])) & rest),
        reversed(keys), F.lit(False))
    # Implied by `beyond`, and in a form that scans use to skip rows.
    rows = df.filter(F.col(keys[0]) >= F.lit(last[keys[0]])).filter(beyond)
    return rows.orderBy(*keys).limit(size)
