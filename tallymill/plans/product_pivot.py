"""Product by factory with one column per month."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.functions.dates import days_within
from tallymill.functions.numbers import or_zero, round_half_even, row_total
from tallymill.functions.predicates import where_member
from tallymill.operators.pivoting import present_values, wide
from tallymill.params import DateRange, code_list, number_list
from tallymill.plans.calendars import days_of_years, on_calendar


def pivot_product_order(fact_sales: DataFrame, fact_order: DataFrame, dim_factory: DataFrame,
                        dim_date: DataFrame, *, days: tuple[int, int],
                        months: int | str | Sequence[int], years: int | str | Sequence[int],
                        selected_month: int, selected_year: int,
                        factory: str | Sequence[str] | None = None, increase: bool = True,
                        columns: Sequence[str] | None = None) -> DataFrame:
    """Monthly sales of each product and factory, their total and mean.

    Every asked month is taken in every asked year. Adds the selected month's sales and
    all deliveries planned after the selected day; planned deliveries ignore `factory`.
    `columns` names the `yyyy-MM` columns; by default the months that have sales.
    """
    month_list, year_list = sorted(set(number_list(months))), sorted(set(number_list(years)))
    codes = code_list(factory)
    fields = ("year", "month", "day")

    def monthly(wanted_years: list[int], wanted_months: list[int]) -> DataFrame:
        spans = [DateRange.months(y, m, m) for y in wanted_years for m in wanted_months]
        calendar = days_of_years(dim_date, wanted_years, *fields).filter(
            F.col("month").isin(wanted_months) & F.col("day").between(*days))
        rows = where_member(fact_sales, "factory_code", codes)
        return on_calendar(days_within(rows, "sales_date", spans), "sales_date", calendar)

    keys = ["product_code", "product_name", "factory_code"]
    main = monthly(year_list, month_list).dropna(subset=keys).withColumn(
        "year_month", F.format_string("%d-%02d", "year", "month"))
    main = main.groupBy(*keys, "year_month").agg(F.sum("sales_quantity").alias("sales_quantity"))
    known = main.join(dim_factory.select("factory_code", "factory_name").dropna(), "factory_code")
    if columns is None:
        columns = present_values(known, "year_month")

    pair = ["factory_code", "product_code"]
    selected = monthly([selected_year], [selected_month]).groupBy(*pair).agg(
        F.sum("sales_quantity").alias("selected_month_sales"))
    after = date(selected_year, selected_month, days[1])
    planned = fact_order.filter(F.col("estimated_delivery_date") > F.lit(after)).groupBy(*pair).agg(
        F.sum("order_quantity").alias("planned_deliveries"))

    table = wide(known, [*keys, "factory_name"], "year_month", columns, F.col("sales_quantity"),
                 0.0, how=F.sum)
    table = table.join(selected, pair, "left").join(planned, pair, "left")
    total = row_total(list(columns))
    table = table.select(
        "product_code", "product_name", "factory_code", "factory_name",
        or_zero(F.col("selected_month_sales")).alias("selected_month_sales"),
        or_zero(F.col("planned_deliveries")).alias("planned_deliveries"),
        *[f"`{c}`" for c in columns],
        total.alias("total_sales"),
        round_half_even(total / max(len(columns), 1), 2).alias("avg_sales"),
    )
    order = ["factory_code", "total_sales", "product_code", "product_name"]
    return table.orderBy(*[F.asc(c) if increase else F.desc(c) for c in order])
