"""Fewer rows before a join: a bitmap of key hashes that is small whatever the number of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 8 MB at most: it may be broadcast at any size of the data. With more keys than bits it lets more
# rows through, never fewer.
BITS = 1 << 26


def _bit(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def may_hold(df: DataFrame, key: str, keys: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows of `df` whose key may be among `keys` (a frame with that column): all that are, and
    a few that are not. The rows are not shuffled; the bitmaps of the keys are sent to them.

    Keys set one of `bits` bits each; the bits lie in bitmaps of some thousand bits, made by partial
    aggregates, and a row looks up its own bit.
    """
    made = keys.where(F.col(key).isNotNull()).select(_bit(key, bits).alias("__bit")).groupBy(
        F.bitmap_bucket_number("__bit").alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("__bit")).alias("__bitmap"))
    own = df.withColumn("__bit", _bit(key, bits)).withColumn("__bucket", F.bitmap_bucket_number("__bit"))
    place = F.bitmap_bit_position("__bit")
    byte = F.conv(F.hex(F.substring("__bitmap", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(__bit) % 8 as int))")) > 0
    return own.join(F.broadcast(made), "__bucket").where(held).drop("__bit", "__bucket", "__bitmap")
