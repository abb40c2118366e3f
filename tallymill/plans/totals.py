"""Monthly totals against a target period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions.dates import MONTH_SUFFIX, days_within
from tallymill.functions.numbers import or_zero, ratio
from tallymill.operators.stacking import stacked_sums
from tallymill.params import DateRange, code_list
from tallymill.plans.calendars import day_window, in_day_window, on_calendar
from tallymill.schemas import EXCLUDED_FACTORIES

Days = tuple[int, int]


def max_sales_date(fact_sales: DataFrame) -> DataFrame:
    """Latest sales date as `yyyy-MM-dd` text; null for an empty table.

    Of a table stored by month only the newest month is read.
    """
    month = "sales_date" + MONTH_SUFFIX
    if month in fact_sales.columns:
        newest = fact_sales.agg(F.max(month)).scalar()
        fact_sales = fact_sales.filter(F.col(month) == newest)
    return fact_sales.agg(F.date_format(F.max("sales_date"), "yyyy-MM-dd").alias("max_sales_date"))


def _excluded(exclude_factory: str | list[str] | None) -> list[str]:
    return code_list(exclude_factory) or EXCLUDED_FACTORIES


def _slice(fact: DataFrame, date_column: str, quantity: str, calendar: DataFrame,
           span: DateRange) -> DataFrame:
    rows = on_calendar(days_within(fact, date_column, [span]), date_column, calendar)
    return rows.select("month", "factory_code", F.col(quantity).alias("quantity"))


def _overall(fact_sales: DataFrame, fact_order: DataFrame, dim_date: DataFrame, year: int,
             target_year: int, target_month: int, days: Days, months: Days,
             excluded: list[str]) -> DataFrame:
    """One scan per fact: days of the window and of the target period are told apart by the
    calendar they meet, and the target is summed along with the months.

    A row without factory is neither in nor outside the list, hence not in the target.
    """
    in_window = in_day_window(days, months, year)
    in_target = in_day_window(days, (target_month, target_month), target_year)
    calendar = dim_date.filter(in_window | in_target).select(
        F.col("date").alias("calendar_date"), F.when(in_window, F.col("month")).alias("month"),
        in_target.alias("in_target"))
    spans = [DateRange.months(year, *months), DateRange.months(target_year, target_month, target_month)]

    in_list, shown = F.col("factory_code").isin(excluded), F.col("month").isNotNull()
    facts = {"sales": (fact_sales, "sales_date", "sales_quantity"),
             "order": (fact_order, "order_date", "order_quantity")}
    frames = [calendar.filter(shown).select("month").distinct()]
    for name, (fact, date_column, quantity) in facts.items():
        rows = on_calendar(days_within(fact, date_column, spans), date_column, calendar)
        amount = F.col(quantity)
        frames.append(rows.select(
            "month",
            F.when(shown, amount).alias(f"{name}_quantity"),
            F.when(shown & in_list, amount).alias(f"exclude_factory_{name}_quantity"),
            F.when(F.col("in_target") & ~in_list, amount).alias(f"{name}_target"),
        ))

    measures = [m for name in facts for m in (f"{name}_quantity", f"exclude_factory_{name}_quantity")]
    sums = stacked_sums(frames, ["month"], [*measures, *(f"{name}_target" for name in facts)])
    # A row for each month and one for the rest: the window sees thirteen rows at most.
    everywhere = Window.partitionBy()
    totals = sums.select(
        "month", *[or_zero(F.col(m)).alias(m) for m in measures],
        *[or_zero(F.sum(f"{name}_target").over(everywhere)).alias(f"{name}_target_value") for name in facts],
    ).filter(shown)
    remain = {n: F.col(f"{n}_quantity") - F.col(f"exclude_factory_{n}_quantity") for n in facts}

    def reached(name: str) -> Column:
        target = F.col(f"{name}_target_value")
        return F.when(target > 0, ratio(remain[name], target)).otherwise(F.lit(0.0))

    return totals.select(
        "month",
        "sales_quantity",
        "exclude_factory_sales_quantity",
        remain["sales"].alias("remain_sales_quantity"),
        "order_quantity",
        "exclude_factory_order_quantity",
        remain["order"].alias("remain_order_quantity"),
        "sales_target_value",
        "order_target_value",
        reached("sales").alias("sales_target_pct"),
        reached("order").alias("order_target_pct"),
    )


def overall(fact_sales: DataFrame, fact_order: DataFrame, dim_date: DataFrame, *, year: int,
            target_year: int = 2022, target_month: int = 5, days: Days = (1, 31),
            months: Days = (1, 12),
            exclude_factory: str | list[str] | None = None) -> DataFrame:
    """R2: sales and orders per month, with and without the excluded factories, against target.

    Months without any row appear with zeros, as long as the day window reaches them.
    """
    return _overall(fact_sales, fact_order, dim_date, year, target_year, target_month, days,
                    months, _excluded(exclude_factory)).orderBy("month")


def _breakdown(fact_sales: DataFrame, fact_order: DataFrame, dim_factory: DataFrame,
               dim_date: DataFrame, year: int, days: Days, months: Days,
               excluded: list[str]) -> DataFrame:
    calendar = day_window(dim_date, days, months, year)
    span = DateRange.months(year, *months)
    wanted = F.col("factory_code").isin(excluded)

    sales = _slice(fact_sales.filter(wanted), "sales_date", "sales_quantity", calendar, span)
    orders = _slice(fact_order.filter(wanted), "order_date", "order_quantity", calendar, span)
    totals = stacked_sums(
        [sales.withColumnRenamed("quantity", "sales_quantity"),
         orders.withColumnRenamed("quantity", "order_quantity")],
        ["month", "factory_code"], ["sales_quantity", "order_quantity"],
    )
    names = dim_factory.filter(wanted).select("factory_code", "factory_name")
    return totals.join(names, "factory_code", "left").select(
        "month", "factory_code", "factory_name",
        or_zero(F.col("sales_quantity")).alias("sales_quantity"),
        or_zero(F.col("order_quantity")).alias("order_quantity"),
    )


def overall_breakdown(fact_sales: DataFrame, fact_order: DataFrame, dim_factory: DataFrame,
                      dim_date: DataFrame, *, year: int, days: Days = (1, 31),
                      months: Days = (1, 12),
                      exclude_factory: str | list[str] | None = None) -> DataFrame:
    """Sales and orders of each excluded factory per month; the name may be missing."""
    return _breakdown(fact_sales, fact_order, dim_factory, dim_date, year, days, months,
                      _excluded(exclude_factory)).orderBy("month", "factory_code")


def overall_nested(fact_sales: DataFrame, fact_order: DataFrame, dim_factory: DataFrame,
                   dim_date: DataFrame, *, year: int, target_year: int = 2022,
                   target_month: int = 5, days: Days = (1, 31), months: Days = (1, 12),
                   exclude_factory: str | list[str] | None = None) -> DataFrame:
    """R2 with the rows of R3 as an array per month, empty where there are none.

    An array holds at most one entry per excluded factory.
    """
    excluded = _excluded(exclude_factory)
    entry = F.struct("factory_code", "factory_name", "sales_quantity", "order_quantity")
    breakdown = _breakdown(fact_sales, fact_order, dim_factory, dim_date, year, days, months,
                           excluded)
    breakdown = breakdown.groupBy("month").agg(
        F.array_sort(F.collect_list(entry)).alias("factory_breakdown"))
    totals = _overall(fact_sales, fact_order, dim_date, year, target_year, target_month, days,
                      months, excluded)
    return totals.join(breakdown, "month", "left").withColumn(
        "factory_breakdown", F.coalesce("factory_breakdown", F.array())
    ).orderBy("month")
