"""Date expressions: parsing of extract cells and range predicates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.params import DateRange

# Accepted cell forms. Day before month, or year first; one separator of three;
# an optional time.
DAY_FIRST = r"(\d{1,2})([/.-])(\d{1,2})\2(\d{4})"
YEAR_FIRST = r"(\d{4})([/.-])(\d{1,2})\6(\d{1,2})"
TIME = r"(?:[ T](?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:[.]\d+)?)?)?"
# Any cell matches: one of the forms, or else the whole of it with all groups empty.
_CELL = f"(?s)^(?:{DAY_FIRST}|{YEAR_FIRST}){TIME}$|^.*$"
_ISO = "$4$5-$3$7-$1$8"

MONTH_SUFFIX = "_month"


def parse_day_first(text: Column) -> Column:
    """Date from text, null where no accepted form matches or the day does not exist.

    One pass puts the parts in ISO order, or leaves two dashes, which no cast takes for a date. That
    is several times as fast as reading each cell with a date pattern.
    """
    return F.regexp_replace(text, _CELL, _ISO).try_cast("date")


def timestamp_literal(moment: datetime) -> Column:
    """A naive moment is read in the session's time zone, whatever the driver's own is."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp")


def in_range(day: Column, span: DateRange) -> Column:
    return day.between(F.lit(span.start), F.lit(span.end))


def in_any_range(day: Column, spans: Sequence[DateRange]) -> Column:
    hit = F.lit(False)
    for span in spans:
        hit = hit | in_range(day, span)
    return hit


def days_within(df: DataFrame, date_column: str, spans: Sequence[DateRange]) -> DataFrame:
    """Rows whose date lies in any of the ranges.

    Stored facts are partitioned by `<date>_month`; where that column is present, the
    same ranges bound it too, so that other months are not even listed.
    """
    kept = df.filter(in_any_range(F.col(date_column), spans))
    month_column = date_column + MONTH_SUFFIX
    if month_column in df.columns:
        months = [DateRange(span.start.replace(day=1), span.end) for span in spans]
        kept = kept.filter(in_any_range(F.col(month_column), months))
    return kept
