"""Summing measures of several facts over shared keys with one shuffle.

A full or left outer join of two aggregates on the same key says the same as one
aggregate over the stacked rows. Stacking needs no join, shuffles partial sums only,
and a key that holds most of the rows is summed up on the map side first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stacked_sums(frames: Sequence[DataFrame], keys: Sequence[str | Column],
                 measures: Sequence[str]) -> DataFrame:
    """Group the union of `frames` by `keys` and sum `measures`.

    A frame that lacks a measure adds nothing to it. A sum over no value is null, so
    a measure that marks rows with 1 tells whether any row was there.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
