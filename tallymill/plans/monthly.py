"""Sales and orders over calendar periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions.dates import days_within, in_any_range
from tallymill.functions.numbers import or_zero, ratio
from tallymill.functions.predicates import where_equal
from tallymill.operators.reduction import may_hold
from tallymill.operators.stacking import stacked_sums
from tallymill.params import DateRange, code_list, number_list
from tallymill.plans.calendars import days_of_years, on_calendar, year_spans
from tallymill.schemas import CALENDAR_FIELDS


def scheduled_and_actual_sales(fact_sales: DataFrame, fact_order: DataFrame, dim_date: DataFrame,
                               year: int, factory: str | None = None) -> DataFrame:
    """Deliveries scheduled per month of a year against the sales of that month.

    Only months with a schedule appear; a schedule of zero gives a null share.
    """
    calendar = days_of_years(dim_date, [year])
    spans = year_spans([year])

    def rows(fact: DataFrame, date_column: str) -> DataFrame:
        kept = days_within(where_equal(fact, "factory_code", factory or None), date_column, spans)
        return on_calendar(kept, date_column, calendar).withColumn(
            "scheduled_month", F.month(date_column))

    scheduled = rows(fact_order, "estimated_delivery_date").select(
        "scheduled_month", F.col("order_quantity").alias("scheduled_quantity"),
        F.lit(1).alias("scheduled_rows"))
    actual = rows(fact_sales, "sales_date").select("scheduled_month", "sales_quantity")
    totals = stacked_sums([scheduled, actual], ["scheduled_month"],
                          ["scheduled_quantity", "scheduled_rows", "sales_quantity"])
    sales = or_zero(F.col("sales_quantity"))
    return totals.filter(F.col("scheduled_rows") > 0).select(
        "scheduled_month", "scheduled_quantity", sales.alias("sales_quantity"),
        ratio(sales, F.col("scheduled_quantity")).alias("sales_pct"),
    ).orderBy("scheduled_month")


def sales_overtime(fact_sales: DataFrame, dim_factory: DataFrame, dim_date: DataFrame,
                   years: int | str | Sequence[int], group_by: str | Sequence[str] = "month",
                   factory: str | None = None, product: str | None = None) -> DataFrame:
    """Sales by any calendar fields, of factories the dimension knows.

    Sums are taken per field and factory first, so the dimension meets partial sums
    and never the sales rows.
    """
    fields = list(dict.fromkeys(code_list(group_by) or []))
    unknown = [f for f in fields if f not in CALENDAR_FIELDS]
    if not fields or unknown:
        raise ValueError(f"group_by needs fields of {CALENDAR_FIELDS}, got {fields}")
    wanted = number_list(years)
    rows = where_equal(fact_sales, "factory_code", factory or None)
    rows = where_equal(rows, "product_name", product or None)
    rows = days_within(rows, "sales_date", year_spans(wanted))
    per_factory = on_calendar(rows, "sales_date", days_of_years(dim_date, wanted, *fields)).groupBy(
        *fields, "factory_code"
    ).agg(F.sum("sales_quantity").alias("sales_quantity"))
    known = per_factory.join(dim_factory.select("factory_code"), "factory_code")
    return known.groupBy(*fields).agg(
        F.sum("sales_quantity").alias("sales_quantity")
    ).orderBy(*fields)


def _months_of(dim_date: DataFrame, spans: list[DateRange]) -> DataFrame:
    return dim_date.filter(in_any_range(F.col("date"), spans)).select(
        F.col("date").alias("calendar_date"), "year", "month")


def same_month_sales(fact_sales: DataFrame, fact_order: DataFrame, dim_date: DataFrame,
                     main: DateRange | None = None,
                     target: DateRange | None = None) -> DataFrame:
    """Per month of either range, sales whose order fell in the same month or not.

    Sales are summed per order and month before they meet their order: an order code
    with very many sales lines shrinks to one row per month ahead of the join. Orders that
    were not sold in the ranges are dropped by a bitmap of the sold codes before they are shuffled.
    """
    spans = [main or DateRange.month_to_date(), target or DateRange.previous_month_to_date()]
    calendar = _months_of(dim_date, spans)
    sales = on_calendar(days_within(fact_sales, "sales_date", spans), "sales_date", calendar)
    per_order = sales.filter(F.col("order_code").isNotNull()).groupBy(
        "order_code", "year", "month"
    ).agg(F.sum("sales_quantity").alias("sold"))

    order_days = dim_date.select(F.col("date").alias("calendar_date"),
                                 F.col("year").alias("order_year"),
                                 F.col("month").alias("order_month"))
    sold = may_hold(fact_order.filter(F.col("order_code").isNotNull()), "order_code", per_order)
    order_months = on_calendar(sold, "order_date", order_days).select(
        "order_code", "order_year", "order_month")
    same = (F.col("month") == F.col("order_month")) & (F.col("year") == F.col("order_year"))
    matched = per_order.join(order_months, "order_code").select(
        "year", "month",
        F.when(same, F.col("sold")).otherwise(F.lit(0.0)).alias("same_month_sales"),
        F.when(same, F.lit(0.0)).otherwise(F.col("sold")).alias("diff_month_sales"),
        F.col("sold").alias("total_sales"),
    )
    ordered = on_calendar(days_within(fact_order, "order_date", spans), "order_date", calendar)
    measures = ["same_month_sales", "diff_month_sales", "total_sales", "total_order"]
    totals = stacked_sums(
        [calendar.select("year", "month").distinct(), matched,
         ordered.select("year", "month", F.col("order_quantity").alias("total_order"))],
        ["year", "month"], measures,
    )
    return totals.select("year", "month", *[or_zero(F.col(m)).alias(m) for m in measures]).orderBy(
        "year", "month")


def _monthly_change(fact: DataFrame, date_column: str, kind: str, calendar: DataFrame,
                    spans: list[DateRange], exclude_factory: str) -> DataFrame:
    """Monthly sums with their change against the previous month that has rows.

    The windows see one row per month, not the fact.
    """
    quantity = F.col(f"{kind}_quantity")
    kept = F.when(F.col("factory_code") != exclude_factory, quantity).otherwise(F.lit(0.0))
    monthly = on_calendar(days_within(fact, date_column, spans), date_column, calendar).groupBy(
        "year", "month"
    ).agg(F.sum(quantity).alias(f"{kind}_quantity"),
          F.sum(kept).alias(f"remain_{kind}_quantity"))
    order = Window.orderBy("year", "month")

    def change(column: str) -> Column:
        value = F.col(column)
        before = F.when(F.row_number().over(order) == 1, value).otherwise(F.lag(value).over(order))
        return ratio(value, before) - 1

    return monthly.select(
        "year", "month",
        f"{kind}_quantity", change(f"{kind}_quantity").alias(f"{kind}_pct_diff"),
        f"remain_{kind}_quantity",
        change(f"remain_{kind}_quantity").alias(f"remain_{kind}_pct_diff"),
    )


def sales_order_pct_diff(fact_sales: DataFrame, fact_order: DataFrame, dim_date: DataFrame,
                         main: DateRange | None = None, target: DateRange | None = None,
                         exclude_factory: str = "30673") -> DataFrame:
    """The latest month having sales and orders, with changes against the month before.

    A row without factory adds nothing to the remaining quantities.
    """
    spans = [main or DateRange.month_to_date(), target or DateRange.previous_month_to_date()]
    calendar = _months_of(dim_date, spans)
    sales = _monthly_change(fact_sales, "sales_date", "sales", calendar, spans, exclude_factory)
    orders = _monthly_change(fact_order, "order_date", "order", calendar, spans, exclude_factory)
    return sales.join(orders, ["year", "month"]).orderBy(F.desc("year"), F.desc("month")).limit(1)
