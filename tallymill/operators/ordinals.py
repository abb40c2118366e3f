"""Running numbers over distributed rows without gathering a group in one task.

A plain `row_number()` per key sends all rows of a key to one task. Here rows are numbered
within (key, chunk), where a chunk is a bounded run of the source order, and the number of
rows in the key's earlier chunks is added. Only chunk sizes are ever gathered per key, and
only keys that span several chunks take part in the join: where chunks are files or file
blocks those are few, and Spark broadcasts them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.session import durable

PART, ROW = "__part", "__row"


def ordinal_in_key(df: DataFrame, key: Sequence[str], chunk: str, row: str,
                   name: str) -> DataFrame:
    """Add `name`: 1, 2, ... within the `key` columns in the order of (`chunk`, `row`).

    The key must not be null. `chunk` must sort in source order and depend on the source row
    alone, so that both readings of the source agree on it.
    """
    inside = Window.partitionBy(*key, chunk).orderBy(row)
    earlier = Window.partitionBy(*key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    before = df.groupBy(*key, chunk).agg(F.count(F.lit(1)).alias("chunk_rows")).select(
        *key, chunk, F.sum("chunk_rows").over(earlier).alias("rows_before")
    ).filter(F.col("rows_before").isNotNull())
    numbered = df.withColumn(name, F.row_number().over(inside).cast("bigint"))
    return numbered.join(before, [*key, chunk], "left").withColumn(
        name, F.col(name) + F.coalesce("rows_before", F.lit(0))).drop("rows_before")


def number_after(df: DataFrame, column: str, start: Column, name: str,
                 buckets: int = 1024) -> DataFrame:
    """Add `name`: `start` + 1, + 2, ... without gaps, rows ordered by hash bucket and `column`.

    The unpartitioned window sees one row per bucket.
    """
    bucketed = df.withColumn("bucket", F.pmod(F.xxhash64(column), F.lit(buckets)))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("bucket_rows")).select(
        "bucket", F.coalesce(F.sum("bucket_rows").over(earlier), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("bucket").orderBy(column)
    return bucketed.withColumn("place", F.row_number().over(inside)).join(before, "bucket").withColumn(
        name, start + F.col("rows_before") + F.col("place")
    ).drop("bucket", "rows_before", "place")


def in_ranges(ordered: DataFrame) -> DataFrame:
    """A sorted frame with the number of each row's task (PART, in sort order) and its place there
    (ROW, from 0). Write the result at once: another run may deal rows otherwise."""
    made = F.monotonically_increasing_id()
    return ordered.withColumns({PART: F.shiftright(made, 33), ROW: made.bitwiseAND(F.lit((1 << 33) - 1))})


def place_in_order(ordered: DataFrame, name: str,
                   cut: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """Add `name`: 1, 2, ... in the order of a sorted frame.

    Sorting deals rows to tasks by range, so a row's place is the number of rows of earlier tasks plus
    its place within its own. The sorted rows are written (`cut`) with both, and the running sum
    sees one row for each task.
    """
    rows = cut(in_ranges(ordered))
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(PART).agg(F.count(F.lit(1)).alias("__n")).select(
        PART, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    return rows.join(before, PART).withColumn(
        name, F.col("__before") + F.col(ROW) + 1).drop(PART, ROW, "__before")
