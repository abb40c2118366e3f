"""Reports on hand-made rows: the cases that sample data does not hold."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallymill.params import DateRange, code_list, number_list, rest_of_month
from tallymill.plans import extracts, materials, monthly, product_mix, product_pivot, range_diff, totals
from tallymill.plans.calendars import calendar_days, year_spans
from tallymill.schemas import TABLES

SALES = "sales_date string, factory_code string, product_name string, product_code string, " \
        "order_code string, sales_quantity double"
ORDERS = "order_date string, estimated_delivery_date string, factory_code string, " \
         "product_name string, product_code string, order_code string, order_quantity double"


def sales(spark, *rows):
    """(day, factory, quantity, product, order)"""
    filled = [(r[0], r[1], r[3] if len(r) > 3 else "Gloss", r[3] if len(r) > 3 else "Gloss",
               r[4] if len(r) > 4 else "o1", r[2]) for r in rows]
    return spark.createDataFrame(filled, SALES).withColumn("sales_date", F.to_date("sales_date"))


def orders(spark, *rows):
    """(order day, delivery day, factory, quantity, order, product)"""
    filled = [(r[0], r[1], r[2], r[5] if len(r) > 5 else "Gloss", r[5] if len(r) > 5 else "Gloss",
               r[4] if len(r) > 4 else "o1", r[3]) for r in rows]
    frame = spark.createDataFrame(filled, ORDERS)
    return frame.withColumns({c: F.to_date(c) for c in ("order_date", "estimated_delivery_date")})


def factories(spark, *codes):
    return spark.createDataFrame([(c, f"Name {c}", "Ann", True, False) for c in codes],
                                 TABLES["dim_factory"])


@pytest.fixture(scope="module")
def days(spark):
    return calendar_days(spark, DateRange.of("2022-01-01", "2024-12-31")).cache()


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


MARCH, FEBRUARY = DateRange.of("2024-03-01", "2024-03-20"), DateRange.of("2024-02-01", "2024-02-20")


def test_params():
    with pytest.raises(ValueError):
        DateRange.of("2024-03-02", "2024-03-01")
    assert code_list(" a, b,,c ") == ["a", "b", "c"]
    assert code_list(["a,b", " c"]) == ["a", "b", "c"]
    assert code_list("") is None and code_list(",") is None and code_list(None) is None
    assert number_list("1, 2") == [1, 2] == number_list([1, 2]) and number_list(3) == [3]
    assert DateRange.month_to_date(date(2024, 3, 31)) == DateRange.of("2024-03-01", "2024-03-31")
    assert DateRange.previous_month_to_date(date(2024, 3, 31)) == DateRange.of("2024-02-01", "2024-02-29")
    assert rest_of_month(date(2024, 2, 29)) is None
    assert rest_of_month(date(2024, 2, 20)) == DateRange.of("2024-02-21", "2024-02-29")
    assert year_spans([2024, 2022, 2023]) == [DateRange.of("2022-01-01", "2024-12-31")]
    assert len(year_spans([2022, 2024])) == 2


def test_max_sales_date(spark):
    s = sales(spark, ("2024-03-05", "7", 1.0), ("2024-01-01", "7", 1.0))
    assert rows(totals.max_sales_date(s)) == [("2024-03-05",)]
    assert rows(totals.max_sales_date(s.limit(0))) == [(None,)]


def test_overall_keeps_empty_months_and_missing_factories(spark, days):
    s = sales(spark, ("2024-01-10", "7", 5.0), ("2024-01-10", None, 3.0), ("2024-01-31", "8", 2.0),
              ("2023-05-10", "8", 4.0), ("2023-05-10", None, 9.0), ("2023-05-10", "7", 1.0))
    o = orders(spark, ("2024-01-10", "2024-02-01", "8", 6.0))
    report = totals.overall(s, o, days, year=2024, target_year=2023, target_month=5, months=(1, 3),
                            exclude_factory="7, ")
    got = {r.month: r for r in report.collect()}
    assert set(got) == {1, 2, 3}
    # A row without factory stays in the remainder, and out of the target.
    assert (got[1].sales_quantity, got[1].exclude_factory_sales_quantity,
            got[1].remain_sales_quantity) == (10.0, 5.0, 5.0)
    assert got[1].sales_target_value == 4.0 and got[1].sales_target_pct == 1.25
    assert got[1].order_target_value == 0.0 and got[1].order_target_pct == 0.0
    assert got[2].sales_quantity == 0.0 and got[2].order_quantity == 0.0
    # Day 31: months without that day do not appear, and only that day counts.
    narrow = totals.overall(s, o, days, year=2024, days=(31, 31), months=(1, 4))
    assert rows(narrow, "month", "sales_quantity") == [(1, 2.0), (3, 0.0)]


def test_nested_breakdown(spark, days):
    s = sales(spark, ("2024-01-10", "7", 5.0), ("2024-01-11", "9", 1.0))
    o = orders(spark, ("2024-02-10", "2024-03-01", "7", 6.0))
    args = dict(year=2024, months=(1, 3), exclude_factory=["7", "9"])
    nested = totals.overall_nested(s, o, factories(spark, "7"), days, **args).collect()
    assert [[tuple(e) for e in r.factory_breakdown] for r in nested] == [
        [("7", "Name 7", 5.0, 0.0), ("9", None, 1.0, 0.0)], [("7", "Name 7", 0.0, 6.0)], []]
    for r in nested:
        assert sum(e.sales_quantity for e in r.factory_breakdown) == r.exclude_factory_sales_quantity
        assert sum(e.order_quantity for e in r.factory_breakdown) == r.exclude_factory_order_quantity


def test_factory_range_diff(spark, days):
    s = sales(spark, ("2024-03-05", "1", 50.0), ("2024-02-05", "1", 20.0), ("2024-02-25", "1", 7.0),
              ("2024-03-05", "2", 30.0), ("2024-02-05", "3", 40.0), ("2024-03-05", "4", 15.0),
              ("2024-03-05", None, 99.0), ("2024-03-05", "unknown", 99.0))
    o = orders(spark, ("2024-01-01", "2024-03-21", "1", 8.0), ("2024-01-01", "2024-03-20", "1", 80.0),
               ("2024-01-01", "2024-04-01", "1", 80.0), ("2024-01-01", "2024-03-31", "5", 8.0))
    f = factories(spark, "1", "2", "3", "4", "5")
    up = range_diff.factory_sales_range_diff(s, o, f, days, MARCH, FEBRUARY, 20, True)
    assert rows(up, "factory_code", "quantity_diff", "quantity_diff_pct",
                "whole_month_sales_quantity", "planned_deliveries") == [
        ("1", 30.0, 1.5, 27.0, 8.0), ("2", 30.0, 1.0, 0.0, 0.0)]
    down = range_diff.factory_sales_range_diff(s, o, f, days, MARCH, FEBRUARY, 20, False)
    assert rows(down, "factory_code", "quantity_diff", "quantity_diff_pct") == [("3", -40.0, -1.0)]
    # A main range that ends with its month leaves no days to plan for.
    whole = DateRange.of("2024-03-01", "2024-03-31")
    up = range_diff.factory_sales_range_diff(s, o, f, days, whole, FEBRUARY, 20, True)
    assert rows(up, "factory_code", "planned_deliveries") == [("1", 0.0), ("2", 0.0)]


def test_factory_order_range_diff_counts_overlap_in_both(spark, days):
    o = orders(spark, ("2024-03-05", "2024-03-25", "1", 10.0), ("2024-02-05", "2024-03-22", "1", 4.0),
               ("2024-01-05", "2024-03-23", "1", 3.0))
    f = factories(spark, "1")
    wide = DateRange.of("2024-02-01", "2024-03-20")
    report = range_diff.factory_order_range_diff(o, f, days, wide, FEBRUARY, 0, True)
    assert rows(report, "order_quantity", "order_quantity_target", "whole_month_order_quantity",
                "planned_deliveries") == [(14.0, 4.0, 4.0, 17.0)]


def test_product_range_diff_swaps_and_keeps_missing_names_apart(spark):
    s = sales(spark, ("2024-03-05", "1", 5.0, "A"), ("2024-02-05", "1", 2.0, "A"),
              ("2024-03-05", "1", 4.0, None), ("2024-02-05", "2", 3.0, None), ("2024-02-06", "1", 1.0, "B"))
    report = rows(range_diff.product_sales_range_diff(s, MARCH, FEBRUARY))
    assert sorted(report, key=str) == sorted([
        ("A", 5.0, 2.0, 3.0, 3.0), ("B", 0.0, 1.0, -1.0, 1.0),
        (None, 4.0, 0.0, 4.0, 4.0), (None, 0.0, 3.0, -3.0, 3.0)], key=str)
    assert [r[3] for r in report] == sorted(r[3] for r in report)
    swapped = rows(range_diff.product_sales_range_diff(s, FEBRUARY, MARCH))
    assert sorted((str(r[0]), -r[3]) for r in swapped) == sorted((str(r[0]), r[3]) for r in report)
    only = rows(range_diff.product_sales_range_diff(s, MARCH, FEBRUARY, " 2 "))
    assert only == [(None, 0.0, 3.0, -3.0, 3.0)]


def test_scheduled_and_actual(spark, days):
    s = sales(spark, ("2024-03-05", "1", 5.0), ("2024-05-05", "1", 7.0))
    o = orders(spark, ("2023-12-01", "2024-03-09", "1", 10.0), ("2024-01-01", "2024-04-09", "1", 0.0),
               ("2024-01-01", "2025-01-09", "1", 1.0))
    report = monthly.scheduled_and_actual_sales(s, o, days, 2024)
    assert rows(report) == [(3, 10.0, 5.0, 0.5), (4, 0.0, 0.0, None)]
    assert rows(monthly.scheduled_and_actual_sales(s, o, days, 2024, "none")) == []


def test_sales_overtime(spark, days):
    s = sales(spark, ("2024-01-01", "1", 5.0), ("2023-01-01", "1", 2.0), ("2024-01-02", "x", 9.0))
    f = factories(spark, "1")
    assert rows(monthly.sales_overtime(s, f, days, "2023, 2024", "year,day_of_week")) == [
        (2023, 7, 2.0), (2024, 1, 5.0)]
    assert rows(monthly.sales_overtime(s, f, days, 2024, "week_of_year", product="Matt")) == []
    for bad in ("hour", "month,date;drop", ""):
        with pytest.raises(ValueError):
            monthly.sales_overtime(s, f, days, 2024, bad)


def test_same_month(spark, days):
    s = sales(spark, ("2024-03-05", "1", 5.0, "A", "o1"), ("2024-03-06", "1", 2.0, "A", "o2"),
              ("2024-03-07", "1", 1.0, "A", "lost"), ("2024-03-08", "1", 1.0, "A", None))
    o = orders(spark, ("2024-03-01", "2024-04-01", "1", 9.0, "o1"),
               ("2023-03-01", "2024-04-01", "1", 9.0, "o2"))
    report = monthly.same_month_sales(s, o, days, MARCH, DateRange.of("2024-02-20", "2024-03-06"))
    assert rows(report) == [(2024, 2, 0.0, 0.0, 0.0, 0.0), (2024, 3, 5.0, 2.0, 7.0, 9.0)]


def test_same_month_counts_every_matching_order_line(spark, days):
    """Two order rows under one code pair with each sales line, as a join does."""
    s = sales(spark, *[("2024-03-05", "1", 2.0, "A", "hot")] * 50)
    o = orders(spark, ("2024-03-01", "2024-04-01", "1", 1.0, "hot"),
               ("2024-02-01", "2024-04-01", "1", 1.0, "hot"))
    report = rows(monthly.same_month_sales(s, o, days, MARCH, FEBRUARY))
    assert report[1][2:5] == (100.0, 100.0, 200.0)


def test_change_uses_the_previous_present_month(spark, days):
    s = sales(spark, ("2024-01-05", "1", 10.0), ("2024-03-05", "1", 15.0), ("2024-03-05", None, 5.0))
    o = orders(spark, ("2024-01-05", "2024-02-01", "1", 4.0), ("2024-02-05", "2024-02-20", "1", 2.0),
               ("2024-03-05", "2024-03-20", "1", 1.0))
    span = DateRange.of("2024-01-01", "2024-03-31")
    got = monthly.sales_order_pct_diff(s, o, days, span, span, "30673").first()
    assert (got.month, got.sales_pct_diff, got.order_pct_diff) == (3, 1.0, -0.5)
    # The row without factory adds nothing to the remainder.
    assert (got.remain_sales_quantity, got.remain_sales_pct_diff) == (15.0, 0.5)
    first = monthly.sales_order_pct_diff(s, o, days, MARCH, MARCH, "30673").first()
    assert (first.sales_pct_diff, first.order_pct_diff) == (0.0, 0.0)
    zero = monthly.sales_order_pct_diff(s, o, days, span, span, "1").first()
    assert zero.remain_sales_quantity == 0.0 and zero.remain_sales_pct_diff is None


@pytest.fixture(scope="module")
def mix(spark, days):
    s = sales(spark, ("2024-01-05", "1", 1.0, "thin"), ("2024-01-06", "1", 4.0, "paint"),
              ("2024-02-05", "1", 12.5, "thin"), ("2024-03-05", "1", 15000000.0, "paint"),
              ("2024-04-05", "1", 6.0, "other"), ("2024-01-05", "2", 2.25, "thin"),
              ("2024-01-05", "2", 1.0, "paint"), ("2024-03-05", "2", 1.0, "paint"),
              ("2024-01-05", "x", 1.0, "thin"), ("2024-01-05", "1", 0.0, "paint"))
    products = spark.createDataFrame(
        [(1, "thin", "T", None), (2, "paint", "P", None), (3, "other", None, None)],
        TABLES["dim_product"])
    return product_mix.thinner_paint_sales(s, factories(spark, "1", "2"), products, days, 2024, "T", "P")


def test_thinner_paint(mix):
    summary = product_mix.thinner_paint_summary(mix, "T", "P")
    assert rows(summary, "factory_code", "month", "ratio") == [
        ("1", 1, "0.3:1"), ("1", 2, "12.5:0"), ("1", 3, "0:15000000"), ("2", 1, "2.3:1"), ("2", 3, "0:1")]


def test_thinner_paint_pivots(mix):
    pivots = product_mix.thinner_paint_pivots(mix, "T", "P")
    assert pivots.thinner.columns == ["factory_code", "factory_name", "1", "2", "3"]
    assert rows(pivots.thinner) == [("1", "Name 1", 1.0, 12.5, 0.0), ("2", "Name 2", 2.25, 0.0, 0.0)]
    assert rows(pivots.ratio) == [("1", "Name 1", "0.3:1", "12.5:0", "0:15000000"),
                                  ("2", "Name 2", "2.3:1", "0", "0:1")]
    assert pivots.thinner_detail.columns[4:] == ["1", "2"]
    assert pivots.paint_detail.columns[4:] == ["1", "3"]
    empty = product_mix.thinner_paint_pivots(mix.limit(0), "T", "P")
    assert all(frame.count() == 0 for frame in empty)


def test_extracts_drop_unknown_factories(spark):
    s = sales(spark, ("2024-03-01", "1", 5.0), ("2024-03-20", "x", 1.0), ("2024-03-21", "1", 1.0))
    got = extracts.fact_sales_extract(s, factories(spark, "1"), MARCH)
    assert rows(got, "factory_code", "factory_name", "sales_quantity") == [("1", "Name 1", 5.0)]


def test_bom(spark):
    s = sales(spark, ("2024-03-01", "1", 3.0, "A"), ("2024-03-02", "2", 1.0, "A"),
              ("2024-03-02", "x", 9.0, "A"), ("2024-03-02", "1", 1.0, "no formula"))
    bridge = spark.sql("""SELECT * FROM VALUES
        ('A', 'm1', 0.3350BD, true), ('A', 'm2', 1.00005BD, true), ('A', 'm1', 9BD, false)
        AS t(product_name, material_name, ratio, is_current)""")
    f = factories(spark, "1", "2")
    assert rows(materials.sales_bom(s, f, bridge, MARCH)) == [("m1", 1.34), ("m2", 4.0)]
    assert rows(materials.sales_bom(s, f, bridge, MARCH, "1", "product_name, material_name")) == [
        ("A", "m1", 3.0, 0.335, 1.01), ("A", "m2", 3.0, 1.0001, 3.0)]
    by_factory = materials.sales_bom(s, f, bridge, MARCH, None, "factory_name")
    assert rows(by_factory)[0] == ("Name 1", "m1", 1.01)
    with pytest.raises(ValueError):
        materials.sales_bom(s, f, bridge, MARCH, None, "price")


def test_product_pivot(spark, days):
    s = sales(spark, ("2024-01-05", "1", 5.0, "A"), ("2023-02-05", "1", 2.0, "A"),
              ("2024-02-25", "1", 100.0, "A"), ("2024-02-05", "2", 1.0, "B"),
              ("2024-01-05", None, 1.0, "A"), ("2024-01-05", "1", 1.0, None))
    o = orders(spark, ("2024-01-01", "2024-02-21", "1", 8.0, "o", "A"),
               ("2024-01-01", "2024-02-20", "1", 80.0, "o", "A"))
    f = factories(spark, "1", "2")
    args = dict(days=(1, 20), months="1,2", years=[2023, 2024], selected_month=2, selected_year=2024)
    table = product_pivot.pivot_product_order(s, o, f, days, **args)
    assert table.columns == [
        "product_code", "product_name", "factory_code", "factory_name", "selected_month_sales",
        "planned_deliveries", "2023-02", "2024-01", "2024-02", "total_sales", "avg_sales"]
    assert rows(table) == [
        ("A", "A", "1", "Name 1", 0.0, 8.0, 2.0, 5.0, 0.0, 7.0, 2.33),
        ("B", "B", "2", "Name 2", 1.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.33)]
    reverse = product_pivot.pivot_product_order(s, o, f, days, **args, increase=False)
    assert rows(reverse, "factory_code") == [("2",), ("1",)]
    none = product_pivot.pivot_product_order(s, o, f, days, **args, factory="none")
    assert none.count() == 0
