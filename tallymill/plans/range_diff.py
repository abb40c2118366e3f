"""Differences between two date ranges, by factory and by product.

Each fact is read once: the ranges become conditional sums over one scan whose filter is
the union of the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.dates import days_within, in_any_range, in_range
from tallymill.functions.numbers import or_zero, ratio
from tallymill.functions.predicates import where_member
from tallymill.operators.stacking import stacked_sums
from tallymill.params import DateRange, code_list, rest_of_month
from tallymill.plans.calendars import month_of


def _default_ranges(main: DateRange | None, target: DateRange | None) -> tuple[DateRange, DateRange]:
    return main or DateRange.month_to_date(), target or DateRange.previous_month_to_date()


def _two_ranges(day: Column, quantity: Column, main: DateRange, target: DateRange) -> list[Column]:
    """Quantity in either range, and a mark that a row of that range was there."""
    columns = []
    for label, span in (("main", main), ("target", target)):
        inside = in_range(day, span)
        columns += [F.when(inside, quantity).alias(f"{label}_quantity"),
                    F.when(inside, 1).alias(f"{label}_rows")]
    return columns


def _with_month_days(fact: DataFrame, date_column: str, dim_date: DataFrame,
                     month: DateRange) -> DataFrame:
    """Add `month_day`: the row's date if it is a known day of that month, else null."""
    days = dim_date.filter(
        (F.col("year") == month.start.year) & (F.col("month") == month.start.month)
    ).select(F.col("date").alias("month_day"))
    return fact.join(days, fact[date_column] == days["month_day"], "left")


def _planned_span(main: DateRange) -> list[DateRange]:
    """Days after the main range up to its month end; none if it ends on the last day."""
    span = rest_of_month(main.end)
    return [span] if span else []


def _factory_report(sums: DataFrame, dim_factory: DataFrame, kind: str, threshold: float,
                    increase: bool) -> DataFrame:
    quantity, target = or_zero(F.col("main_quantity")), or_zero(F.col("target_quantity"))
    diff = quantity - target
    seen = F.coalesce(F.col("main_rows"), F.col("target_rows")).isNotNull()
    wanted = sums.filter(
        seen & (F.abs(diff) >= threshold) & ((diff > 0) if increase else (diff < 0))
    )
    names = dim_factory.select("factory_code", "factory_name", "salesman")
    report = wanted.join(names, "factory_code").select(
        "factory_code", "factory_name", "salesman",
        quantity.alias(f"{kind}_quantity"),
        target.alias(f"{kind}_quantity_target"),
        diff.alias("quantity_diff"),
        F.abs(diff).alias("quantity_diff_abs"),
        F.coalesce(ratio(diff, target), F.lit(1.0)).alias("quantity_diff_pct"),
        or_zero(F.col("month_quantity")).alias(f"whole_month_{kind}_quantity"),
        or_zero(F.col("planned")).alias("planned_deliveries"),
    )
    order = F.col("quantity_diff").desc() if increase else F.col("quantity_diff").asc()
    return report.orderBy(order, "factory_code")


_FACTORY_MEASURES = ["main_quantity", "main_rows", "target_quantity", "target_rows",
                     "month_quantity", "planned"]


def factory_sales_range_diff(fact_sales: DataFrame, fact_order: DataFrame, dim_factory: DataFrame,
                             dim_date: DataFrame, main: DateRange | None = None,
                             target: DateRange | None = None, threshold: float = 1000,
                             increase: bool = False) -> DataFrame:
    """Factories whose sales fell (or rose) by the threshold or more between two ranges.

    Adds the whole month's sales of the target month, and the deliveries planned for the
    rest of the main range's month.
    """
    main, target = _default_ranges(main, target)
    month = month_of(target.start)
    sales = _with_month_days(days_within(fact_sales, "sales_date", [main, target, month]),
                             "sales_date", dim_date, month)
    quantity = F.col("sales_quantity")
    sales = sales.select(
        "factory_code", *_two_ranges(F.col("sales_date"), quantity, main, target),
        F.when(F.col("month_day").isNotNull(), quantity).alias("month_quantity"),
    )
    planned = days_within(fact_order, "estimated_delivery_date", _planned_span(main)).select(
        "factory_code", F.col("order_quantity").alias("planned")
    )
    sums = stacked_sums([sales, planned], ["factory_code"], _FACTORY_MEASURES)
    return _factory_report(sums, dim_factory, "sales", threshold, increase)


def factory_order_range_diff(fact_order: DataFrame, dim_factory: DataFrame, dim_date: DataFrame,
                             main: DateRange | None = None, target: DateRange | None = None,
                             threshold: float = 1000, increase: bool = False) -> DataFrame:
    """R5 over orders. One scan serves order dates and delivery dates."""
    main, target = _default_ranges(main, target)
    month = month_of(target.start)
    planned = in_any_range(F.col("estimated_delivery_date"), _planned_span(main))
    wanted = in_any_range(F.col("order_date"), [main, target, month]) | planned
    orders = _with_month_days(fact_order.filter(wanted), "order_date", dim_date, month)
    quantity = F.col("order_quantity")
    orders = orders.select(
        "factory_code", *_two_ranges(F.col("order_date"), quantity, main, target),
        F.when(F.col("month_day").isNotNull(), quantity).alias("month_quantity"),
        F.when(planned, quantity).alias("planned"),
    )
    sums = stacked_sums([orders], ["factory_code"], _FACTORY_MEASURES)
    return _factory_report(sums, dim_factory, "order", threshold, increase)


def _product_range_diff(fact: DataFrame, date_column: str, kind: str, main: DateRange | None,
                        target: DateRange | None, factory: str | list[str] | None) -> DataFrame:
    main, target = _default_ranges(main, target)
    rows = where_member(days_within(fact, date_column, [main, target]), "factory_code",
                        code_list(factory))
    quantity = F.col(f"{kind}_quantity")
    rows = rows.select("product_name",
                       *_two_ranges(F.col(date_column), quantity, main, target))
    sums = stacked_sums([rows], ["product_name"],
                        ["main_quantity", "main_rows", "target_quantity", "target_rows"])

    # Two rows without product name are not the same product: each range keeps its own.
    main_side = F.struct(or_zero(F.col("main_quantity")).alias("main"),
                         F.lit(0.0).alias("target"), F.col("main_rows").alias("rows"))
    target_side = F.struct(F.lit(0.0).alias("main"),
                           or_zero(F.col("target_quantity")).alias("target"),
                           F.col("target_rows").alias("rows"))
    both_sides = F.struct(or_zero(F.col("main_quantity")).alias("main"),
                          or_zero(F.col("target_quantity")).alias("target"),
                          F.coalesce("main_rows", "target_rows").alias("rows"))
    sides = F.when(F.col("product_name").isNull(), F.array(main_side, target_side)).otherwise(
        F.array(both_sides)
    )
    side = sums.select("product_name", F.explode(sides).alias("side")).filter("side.rows > 0")
    diff = F.col("side.main") - F.col("side.target")
    return side.select(
        "product_name",
        F.col("side.main").alias(f"{kind}_quantity"),
        F.col("side.target").alias(f"{kind}_quantity_target"),
        diff.alias("quantity_diff"),
        F.abs(diff).alias("quantity_diff_abs"),
    ).orderBy("quantity_diff", "product_name")


def product_sales_range_diff(fact_sales: DataFrame, main: DateRange | None = None,
                             target: DateRange | None = None,
                             factory: str | list[str] | None = None) -> DataFrame:
    """Sales of every product in two ranges, optionally of some factories only."""
    return _product_range_diff(fact_sales, "sales_date", "sales", main, target, factory)


def product_order_range_diff(fact_order: DataFrame, main: DateRange | None = None,
                             target: DateRange | None = None,
                             factory: str | list[str] | None = None) -> DataFrame:
    """Orders of every product in two ranges."""
    return _product_range_diff(fact_order, "order_date", "order", main, target, factory)
