"""Wide tables: one column per period."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present_values(df: DataFrame, column: str) -> list[Any]:
    """Distinct values of a period column, sorted.

    The only place where values reach the driver: a wide table must know its columns.
    Periods are the months of the asked years, so there are few.
    """
    return sorted(row[0] for row in df.select(column).distinct().collect())


def wide(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[Any],
         cell: Column, empty: Any, how: Callable[[Column], Column] = F.max,
         extra: Sequence[Column] = ()) -> DataFrame:
    """One row per key, one column per value; cells without rows hold `empty`.

    Rows with a missing key part are left out. Each cell is a conditional aggregate, so
    `extra` aggregates come out of the same single pass.
    """
    cells = [
        F.coalesce(how(F.when(F.col(column) == v, cell)), F.lit(empty)).alias(str(v))
        for v in values
    ]
    rows = df.dropna(subset=list(keys))
    aggregates = [*cells, *extra]
    return rows.groupBy(*keys).agg(*aggregates) if aggregates else rows.select(*keys).distinct()
