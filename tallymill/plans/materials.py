"""Material demand from the current bills of material."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.functions.dates import days_within
from tallymill.functions.numbers import round_half_up
from tallymill.functions.predicates import where_member
from tallymill.params import DateRange, code_list

_GROUPS = ["factory_code", "factory_name", "product_name", "material_name"]


def _bom(fact: DataFrame, date_column: str, quantity: str, dim_factory: DataFrame,
         bridge: DataFrame, span: DateRange | None, factory: str | Sequence[str] | None,
         group_by: str | Sequence[str] | None) -> DataFrame:
    """Quantities times ratio, summed by the asked columns and always by material.

    The fact shrinks to sums per product and factory before the bill of materials
    multiplies its rows, and to sums per product if no factory column is asked for.
    """
    asked = code_list(group_by) or []
    unknown = [c for c in asked if c not in _GROUPS]
    if unknown:
        raise ValueError(f"group_by allows {_GROUPS}, got {unknown}")
    groups = [c for c in dict.fromkeys(asked) if c != "material_name"] + ["material_name"]

    rows = where_member(days_within(fact, date_column, [span or DateRange.month_to_date()]),
                        "factory_code", code_list(factory))
    total = F.sum(quantity).alias(quantity)
    sums = rows.groupBy("product_name", "factory_code").agg(total)
    sums = sums.join(dim_factory.select("factory_code", "factory_name"), "factory_code")
    kept = [c for c in groups if c.startswith("factory_")]
    sums = sums.groupBy("product_name", *kept).agg(total)

    current = bridge.filter("is_current").select("product_name", "material_name", "ratio")
    lines = sums.join(current, "product_name")
    measures = [round_half_up(F.sum(F.col(quantity) * F.col("ratio").cast("double")), 2)
                .alias("material_quantity")]
    if "product_name" in groups:
        measures = [round_half_up(F.sum(quantity), 2).alias(quantity),
                    F.round(F.max("ratio"), 4).cast("double").alias("ratio"), *measures]
    return lines.groupBy(*groups).agg(*measures).orderBy(*groups)


def sales_bom(fact_sales: DataFrame, dim_factory: DataFrame, bridge: DataFrame,
              span: DateRange | None = None, factory: str | Sequence[str] | None = None,
              group_by: str | Sequence[str] | None = None) -> DataFrame:
    """Materials behind the sales of a range."""
    return _bom(fact_sales, "sales_date", "sales_quantity", dim_factory, bridge, span, factory,
                group_by)


def order_bom(fact_order: DataFrame, dim_factory: DataFrame, bridge: DataFrame,
              span: DateRange | None = None, factory: str | Sequence[str] | None = None,
              group_by: str | Sequence[str] | None = None) -> DataFrame:
    """Materials behind the orders of a range."""
    return _bom(fact_order, "order_date", "order_quantity", dim_factory, bridge, span, factory,
                group_by)
