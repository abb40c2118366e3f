"""Text expressions of the loads and the list filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Cell texts that spreadsheet readers take for a missing value.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def missing_to_null(text: Column) -> Column:
    return F.when(~text.isin(MISSING_TEXTS), text)


def drop_point_zero(text: Column) -> Column:
    """Remove every `.0`: numbers that a spreadsheet turned into `30673.0`.

    All occurrences go, so `30895.01` becomes `308951`: the codes already stored
    were made by this rule. Looking for it first is several times as fast as replacing it.
    """
    return F.when(text.contains(".0"), F.replace(text, F.lit(".0"), F.lit(""))).otherwise(text)


def ordinal_text(number: Column) -> Column:
    """At least four digits; longer numbers stay whole (padding would cut them)."""
    return F.when(number.between(0, 9999), F.lpad(number.cast("string"), 4, "0")).otherwise(
        F.format_string("%04d", number))


def code_prefix(code: Column) -> Column:
    """Text before the first dash."""
    return F.substring_index(code, "-", 1)


def matches_search(search: str, *columns: Column) -> Column:
    """Case-insensitive substring in any column; `%` and `_` in `search` stay wildcards."""
    hit = F.lit(False)
    for column in columns:
        hit = hit | column.ilike(f"%{search}%")
    return hit


def tagged(text: Column, tag: str) -> Column:
    """Case-insensitive containment; missing text contains nothing."""
    return F.coalesce(F.upper(text).contains(tag), F.lit(False))
