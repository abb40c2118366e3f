"""Thinner against paint, by factory and month.

All three reports start from `thinner_paint_sales`. Persist it when several of them, or
several of the five wide frames, are wanted at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.dates import days_within
from tallymill.functions.numbers import one_decimal_text, plain_text, ratio
from tallymill.functions.predicates import where_member
from tallymill.operators.pivoting import present_values, wide
from tallymill.params import code_list
from tallymill.plans.calendars import days_of_years, on_calendar, year_spans
from tallymill.schemas import PAINT_TYPES, THINNER_TYPES

Types = str | Sequence[str]

_FACTORY = ["factory_code", "factory_name"]
_PRODUCT = [*_FACTORY, "product_type", "product_name"]


def _is_one_of(types: Types) -> Column:
    return F.col("product_type").isin(code_list(types) or [])


def thinner_paint_sales(fact_sales: DataFrame, dim_factory: DataFrame, dim_product: DataFrame,
                        dim_date: DataFrame, year: int, thinner: Types = tuple(THINNER_TYPES),
                        paint: Types = tuple(PAINT_TYPES),
                        factory: str | Sequence[str] | None = None) -> DataFrame:
    """Sales per factory, product and month, of thinner and paint products.

    Sales are summed per factory, product and month first; both dimensions join sums.
    """
    rows = where_member(fact_sales, "factory_code", code_list(factory))
    rows = on_calendar(days_within(rows, "sales_date", year_spans([year])), "sales_date",
                       days_of_years(dim_date, [year], "month"))
    sums = rows.groupBy("factory_code", "product_name", "month").agg(
        F.sum("sales_quantity").alias("sales_quantity"))
    products = dim_product.filter(_is_one_of(thinner) | _is_one_of(paint))
    return sums.join(products.select("product_name", "product_type"), "product_name").join(
        dim_factory.select("factory_code", "factory_name"), "factory_code"
    ).select(*_PRODUCT, "month", "sales_quantity")


def thinner_paint_detail(sales: DataFrame) -> DataFrame:
    """The rows of `thinner_paint_sales` in report order."""
    return sales.orderBy("factory_code", "month", "product_name")


def _ratio_text(thinner: Column, paint: Column) -> Column:
    """`0:p` without thinner, `t:0` without paint, else thinner per one paint."""
    return (
        F.when(thinner == 0, F.concat(F.lit("0:"), plain_text(paint)))
        .when(paint == 0, F.concat(plain_text(thinner), F.lit(":0")))
        .otherwise(F.concat(one_decimal_text(ratio(thinner, paint)), F.lit(":1")))
    )


def _summary(sales: DataFrame, thinner: Types, paint: Types) -> DataFrame:
    def total(types: Types) -> Column:
        return F.sum(F.when(_is_one_of(types), F.col("sales_quantity")).otherwise(F.lit(0.0)))

    sums = sales.groupBy(*_FACTORY, "month").agg(
        total(thinner).alias("sales_thinner_quantity"),
        total(paint).alias("sales_paint_quantity"),
    )
    t, p = F.col("sales_thinner_quantity"), F.col("sales_paint_quantity")
    return sums.filter((t != 0) | (p != 0)).withColumn("ratio", _ratio_text(t, p))


def thinner_paint_summary(sales: DataFrame, thinner: Types = tuple(THINNER_TYPES),
                          paint: Types = tuple(PAINT_TYPES)) -> DataFrame:
    """Thinner and paint sums per factory and month with their ratio as text.

    Months with neither are left out.
    """
    return _summary(sales, thinner, paint).orderBy("factory_code", "month")


class MixPivots(NamedTuple):
    """Five wide frames with one column per month."""

    thinner: DataFrame
    paint: DataFrame
    ratio: DataFrame
    thinner_detail: DataFrame
    paint_detail: DataFrame


def thinner_paint_pivots(sales: DataFrame, thinner: Types = tuple(THINNER_TYPES),
                         paint: Types = tuple(PAINT_TYPES),
                         months: Sequence[int] | None = None) -> MixPivots:
    """The summary and the detail with months as columns.

    `months` defaults to the months present in each frame. The three summary frames share
    one order: largest thinner plus paint quantity of the latest month first.
    """
    summary = _summary(sales, thinner, paint)
    shown = present_values(summary, "month") if months is None else list(months)
    t, p = F.col("sales_thinner_quantity"), F.col("sales_paint_quantity")

    def ranked(cell: Column, empty: object) -> DataFrame:
        if not shown:
            return wide(summary, _FACTORY, "month", [], cell, empty)
        latest = F.sum(F.when(F.col("month") == max(shown), t + p).otherwise(F.lit(0.0)))
        frame = wide(summary, _FACTORY, "month", shown, cell, empty,
                     extra=[latest.alias("latest_total")])
        return frame.orderBy(F.desc("latest_total"), "factory_code").drop("latest_total")

    def ratios() -> DataFrame:
        """Two numbers per month are gathered, and the text is made of them at the end."""
        paints = [F.coalesce(F.max(F.when(F.col("month") == m, p)), F.lit(0.0)).alias(f"paint {m}")
                  for m in shown]
        latest = F.sum(F.when(F.col("month") == max(shown), t + p).otherwise(F.lit(0.0)))
        frame = wide(summary, _FACTORY, "month", shown, t, 0.0, extra=[*paints, latest.alias("latest_total")])

        def text(month: int) -> Column:
            thin, paint = F.col(f"`{month}`"), F.col(f"`paint {month}`")
            return F.when((thin != 0) | (paint != 0), _ratio_text(thin, paint)).otherwise("0").alias(str(month))

        return frame.orderBy(F.desc("latest_total"), "factory_code").select(
            *_FACTORY, *[text(m) for m in shown])

    def products(types: Types) -> DataFrame:
        rows = sales.filter(_is_one_of(types))
        columns = present_values(rows, "month") if months is None else shown
        return wide(rows, _PRODUCT, "month", columns, F.col("sales_quantity"), 0.0).orderBy(*_PRODUCT)

    return MixPivots(ranked(t, 0.0), ranked(p, 0.0),
                     ratios() if shown else ranked(F.col("ratio"), "0"),
                     products(thinner), products(paint))
