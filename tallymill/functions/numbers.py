"""Number expressions whose rounding and text form differ from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,15)"


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double; null where the denominator is zero or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def round_half_up(value: Column, digits: int) -> Column:
    """Decimal rounding, half away from zero, back to double."""
    return F.round(value.cast(WIDE), digits).cast("double")


def round_half_even(value: Column, digits: int) -> Column:
    """Binary rounding, half to even, as array libraries do it."""
    scale = 10.0**digits
    return F.rint(value * scale) / scale


def one_decimal_text(value: Column) -> Column:
    """`2.25` -> `2.3`: rounded half away from zero, always one decimal."""
    return F.round(value.cast(WIDE), 1).cast("decimal(38,1)").cast("string")


def plain_text(value: Column) -> Column:
    """`12.0` -> `12`, `12.5` -> `12.5`, `1.5E7` -> `15000000`."""
    return F.regexp_replace(value.cast("decimal(38,6)").cast("string"), r"\.?0+$", "")


def row_total(columns: list[str]) -> Column:
    total = F.lit(0.0)
    for name in columns:
        total = total + F.col(f"`{name}`")
    return total
