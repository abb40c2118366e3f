"""Fact rows of a date range with the factory's name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.functions.dates import days_within
from tallymill.params import DateRange
from tallymill.schemas import TABLES


def _extract(fact: DataFrame, date_column: str, table: str, dim_factory: DataFrame,
             span: DateRange | None) -> DataFrame:
    """All columns of the table, null where `fact` has none, and the factory's name."""
    rows = days_within(fact, date_column, [span or DateRange.month_to_date()])
    columns = [F.col(f.name) if f.name in fact.columns else F.lit(None).cast(f.dataType).alias(f.name)
               for f in TABLES[table]]
    names = dim_factory.select("factory_code", "factory_name")
    return rows.join(names, "factory_code").select(*columns, "factory_name")


def fact_order_extract(fact_order: DataFrame, dim_factory: DataFrame,
                       span: DateRange | None = None) -> DataFrame:
    """Order lines of a range; lines of unknown factories are left out."""
    return _extract(fact_order, "order_date", "fact_order", dim_factory, span)


def fact_sales_extract(fact_sales: DataFrame, dim_factory: DataFrame,
                       span: DateRange | None = None) -> DataFrame:
    """Sales lines of a range; lines of unknown factories are left out."""
    return _extract(fact_sales, "sales_date", "fact_sales", dim_factory, span)
