"""Set-based upserts by key.

Rows of one batch that share a key act as if applied one after the other: the first makes
the row, the later ones change only the listed update columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERTED, UPDATED, KEPT = "inserted", "updated", "kept"


def one_row_per_key(new: DataFrame, key: str, place: Column, without: Sequence[str] = (),
                    update_columns: Sequence[str] = (),
                    cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """First row of each key by `place`, update columns from the key's last row.

    `place` is a long that no two rows of a key share. `new` is read several times: write it first.
    Keys are reduced to their first and last place by hash, on the map side too. Only keys that
    have several places are joined. `cut` writes these, so that their size is known: if they are
    few, Spark broadcasts them and no row is shuffled; else rows meet them by key, and skewed
    partitions are split. Rows without key or place, and the columns `without`, are left out.
    """
    placed = new.withColumn("__place", place).where(F.col(key).isNotNull() & F.col("__place").isNotNull())
    names = [c for c in new.columns if c not in without]
    several = placed.groupBy(key).agg(F.min("__place").alias("__first"), F.max("__place").alias("__last")).where(
        "__first < __last")
    if update_columns:
        last = placed.select(key, F.col("__place").alias("__last"), F.struct(*update_columns).alias("__row"))
        several = (cut(several) if cut else several).join(last, [key, "__last"])
    if cut:
        several = cut(several)
    first = F.col("__first").isNull() | (F.col("__place") == F.col("__first"))
    return placed.join(several.drop("__last"), key, "left").where(first).select(*[
        F.when(F.col("__row").isNotNull(), F.col(f"__row.{c}")).otherwise(F.col(c)).alias(c)
        if c in update_columns else F.col(c) for c in names])


def upsert(current: DataFrame, new: DataFrame, key: str,
           update_columns: Sequence[str]) -> DataFrame:
    """All rows after the upsert, with `change` = inserted, updated or kept.

    Both sides hold one row per key. A matched row keeps its columns but for the update
    columns, which come from `new`, null included. `new` may lack columns, which are then
    null in inserted rows. One full outer join.
    """
    a, b = current.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    was, comes = F.col(f"a.{key}").isNotNull(), F.col(f"b.{key}").isNotNull()
    columns = []
    for c in current.columns:
        take_new = comes if c in update_columns else ~was
        value = F.col(f"b.{c}") if c in new.columns else F.lit(None)
        columns.append(F.when(take_new, value).otherwise(F.col(f"a.{c}")).alias(c))
    change = F.when(was & comes, UPDATED).when(was, KEPT).otherwise(INSERTED)
    return joined.select(*columns, change.alias("change"))


def insert_absent(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` whose key is not in `current`; `new` holds one row per key.

    Stored tables are bucketed by their key, so `new` alone is shuffled; few stored keys are broadcast.
    """
    return new.join(current.select(key), key, "left_anti")
