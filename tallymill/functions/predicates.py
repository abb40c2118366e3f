"""Optional filters: a parameter left out adds nothing to the plan."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.functions.text import matches_search


def where_equal(df: DataFrame, column: str, value: Any) -> DataFrame:
    return df if value is None else df.filter(F.col(column) == F.lit(value))


def where_member(df: DataFrame, column: str, values: Iterable[Any] | None) -> DataFrame:
    return df if values is None else df.filter(F.col(column).isin(list(values)))


def where_search(df: DataFrame, search: str | None, *columns: str) -> DataFrame:
    return df if search is None else df.filter(matches_search(search, *map(F.col, columns)))
