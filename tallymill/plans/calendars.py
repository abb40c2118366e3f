"""The date dimension, and the slices of it that reports join to facts.

A slice holds at most one row per day of the asked range. It carries no broadcast
hint: Spark broadcasts it because its size is known to be small.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.params import DateRange, month_end


def calendar_days(spark: SparkSession, span: DateRange) -> DataFrame:
    """Rows of `dim_date` for a range: ISO weeks, weekdays from Monday = 1."""
    days = F.sequence(F.lit(span.start), F.lit(span.end))
    date = F.col("date")
    return spark.range(0, 1, 1, 1).select(F.explode(days).alias("date")).select(
        "date",
        F.year(date).alias("year"),
        F.quarter(date).alias("quarter"),
        F.month(date).alias("month"),
        F.weekofyear(date).alias("week_of_year"),
        (F.weekday(date) + 1).alias("day_of_week"),
        F.dayofmonth(date).alias("day"),
    )


def day_window(dim_date: DataFrame, days: tuple[int, int], months: tuple[int, int],
               year: int) -> DataFrame:
    """`calendar_date, month` of the days in a day window of some months of one year."""
    return dim_date.filter(in_day_window(days, months, year)).select(
        F.col("date").alias("calendar_date"), "month")


def in_day_window(days: tuple[int, int], months: tuple[int, int], year: int) -> Column:
    return F.col("day").between(*days) & F.col("month").between(*months) & (F.col("year") == year)


def days_of_years(dim_date: DataFrame, years: list[int], *fields: str) -> DataFrame:
    """`calendar_date` and the asked calendar fields of all days of the years."""
    return dim_date.filter(F.col("year").isin(years)).select(
        F.col("date").alias("calendar_date"), *fields
    )


def year_spans(years: list[int]) -> list[DateRange]:
    """Date ranges of the years, neighbouring years joined into one range."""
    spans: list[DateRange] = []
    for year in sorted(set(years)):
        if spans and spans[-1].end.year == year - 1:
            spans[-1] = DateRange(spans[-1].start, date(year, 12, 31))
        else:
            spans.append(DateRange.months(year))
    return spans


def month_of(day: date) -> DateRange:
    return DateRange(day.replace(day=1), month_end(day))


def on_calendar(fact: DataFrame, date_column: str, calendar: DataFrame) -> DataFrame:
    """Fact rows whose date is in the calendar slice, with its fields."""
    return fact.join(calendar, fact[date_column] == calendar["calendar_date"])

