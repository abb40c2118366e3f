"""Shared operators against plain Python on small and on skewed input."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymill.functions.dates import parse_day_first
from tallymill.functions.numbers import one_decimal_text, plain_text, round_half_even, round_half_up
from tallymill.functions.text import drop_point_zero, missing_to_null, ordinal_text
from tallymill.operators.ordinals import number_after, ordinal_in_key, place_in_order
from tallymill.operators.paging import page, row_count
from tallymill.operators.reduction import may_hold
from tallymill.operators.stacking import stacked_sums
from tallymill.operators.upsert import insert_absent, one_row_per_key, upsert
from tallymill.plans import dimension_changes, dimension_lists
from tallymill.schemas import TABLES


def evaluate(spark, values, kind, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("v"))).collect()]


def test_number_texts(spark):
    assert evaluate(spark, [12.0, 12.5, 1.5e7, 0.1, 100.0], "double", plain_text) == [
        "12", "12.5", "15000000", "0.1", "100"]
    assert evaluate(spark, [2.25, 2.0, 0.04], "double", one_decimal_text) == ["2.3", "2.0", "0.0"]
    assert evaluate(spark, [0.125, 2.675, -0.125], "double", lambda c: round_half_up(c, 2)) == [
        0.13, 2.68, -0.13]
    assert evaluate(spark, [0.125, 0.375], "double", lambda c: round_half_even(c, 2)) == [0.12, 0.38]


def test_texts(spark):
    assert evaluate(spark, ["30673.0", "30895.01", "1.0.0", None], "string", drop_point_zero) == [
        "30673", "308951", "1", None]
    assert evaluate(spark, [7, 12345, 9999], "long", ordinal_text) == ["0007", "12345", "9999"]
    assert evaluate(spark, ["", "NA", "nan", "x", " "], "string", missing_to_null) == [
        None, None, None, "x", " "]
    got = evaluate(spark, ["1/3/2024", "31/12/2024", "2024-03-01", "2024-03-01 10:00:00", "32/1/2024",
                           "3/1", "junk", None, "1/2/2024/3", "2024-03-01 25:00:00", "29/2/2023",
                           "29/02/2024", "2024-3-1"], "string", lambda c: parse_day_first(c).cast("string"))
    assert got == ["2024-03-01", "2024-12-31", "2024-03-01", "2024-03-01", None, None, None, None,
                   None, None, None, "2024-02-29", "2024-03-01"]


def test_ordinals_with_a_hot_key(spark):
    """One key holds most rows, over many chunks; partitions hold rows in any order."""
    random.seed(1)
    source = [("hot" if random.random() < 0.8 else f"k{random.randrange(40)}", i // 97, i)
              for i in range(5000)]
    expected, seen = {}, {}
    for key, _, i in source:
        seen[key] = seen.get(key, 0) + 1
        expected[i] = seen[key]
    random.shuffle(source)
    frame = spark.createDataFrame(source, "k string, chunk long, row long").repartition(16)
    got = ordinal_in_key(frame, "k", "chunk", "row", "n")
    assert {r.row: r.n for r in got.collect()} == expected


def test_no_window_gathers_a_key(spark):
    """Rows are windowed by key and chunk; only chunk counts are windowed by key alone."""
    frame = spark.range(10).selectExpr("id % 2 AS k", "id AS chunk", "id AS row")
    plan = ordinal_in_key(frame, "k", "chunk", "row", "n")._jdf.queryExecution().optimizedPlan().toString()
    over_rows = [line for line in plan.splitlines() if "row_number()" in line and "Window" in line]
    assert over_rows and all("[k#" in line and ", chunk#" in line for line in over_rows)


def test_number_after(spark):
    names = spark.createDataFrame([(f"p{i}",) for i in range(300)], "name string").repartition(7)
    ids = sorted(r.id for r in number_after(names, "name", F.lit(41), "id", buckets=16).collect())
    assert ids == list(range(42, 342))


batch_rows = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9), st.text("ab", max_size=2)), max_size=25)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(batch_rows, batch_rows)
def test_upsert_equals_row_by_row(spark, first, second):
    """Two batches, applied set-based and one row after the other."""
    expected = {}
    for rows in (first, second):
        for key, quantity, note in rows:
            expected[key] = (quantity, expected[key][1] if key in expected else note)

    def collapsed(rows):
        frame = spark.createDataFrame([(k, q, n, i) for i, (k, q, n) in enumerate(rows)],
                                      "k int, q int, note string, place int")
        return one_row_per_key(frame, "k", F.col("place"), ["place"], ["q"])

    result = upsert(collapsed(first), collapsed(second), "k", ["q"])
    got = {r.k: ((r.q, r.note), r.change) for r in result.collect()}
    assert {k: v[0] for k, v in got.items()} == expected
    old, new = {r[0] for r in first}, {r[0] for r in second}
    assert {k: v[1] for k, v in got.items()} == {
        k: "updated" if k in old & new else "kept" if k in old else "inserted" for k in old | new}


def test_update_to_null_and_missing_columns(spark):
    current = spark.createDataFrame([(1, 5, "a", "z")], "k int, q int, note string, extra string")
    new = spark.createDataFrame([(1, None, "b"), (2, 3, "c")], "k int, q int, note string")
    got = {r.k: tuple(r)[1:] for r in upsert(current, new, "k", ["q"]).collect()}
    assert got == {1: (None, "a", "z", "updated"), 2: (3, "c", None, "inserted")}
    assert [r.k for r in insert_absent(current, new, "k").collect()] == [2]


def test_stacked_sums(spark):
    a = spark.createDataFrame([("x", 1.0), ("x", 2.0)], "k string, a double")
    b = spark.createDataFrame([("x", 5.0), ("y", None)], "k string, b double")
    got = {r.k: (r.a, r.b) for r in stacked_sums([a, b], ["k"], ["a", "b"]).collect()}
    assert got == {"x": (3.0, 5.0), "y": (None, None)}


@pytest.fixture(scope="module")
def factory_table(spark):
    return spark.createDataFrame(
        [(f"{i:02d}", f"Plant {'A' if i % 2 else 'b'}{i}", "Ann", i % 2 == 0, i % 3 == 0)
         for i in range(23)], TABLES["dim_factory"])


def test_pages_make_up_the_list(factory_table):
    listed = dimension_lists.list_factories(factory_table)
    pages = [page(listed, ["factory_code"], n, 5).collect() for n in range(1, 7)]
    assert [len(p) for p in pages] == [5, 5, 5, 5, 3, 0]
    codes = [r.factory_code for p in pages for r in p]
    assert codes == sorted(codes) and len(set(codes)) == 23
    assert {r.total_count for p in pages for r in p} == {23}
    assert row_count(listed).first()[0] == 23
    with pytest.raises(ValueError):
        page(listed, ["factory_code"], 0)


def test_list_filters(spark, factory_table):
    codes = lambda **f: [r.factory_code for r in
                         dimension_lists.list_factories(factory_table, **f).collect()]
    assert len(codes(is_active=True)) == 12 and len(codes(is_active=True, has_onsite=True)) == 4
    assert codes(search="plant a1_") == ["11", "13", "15", "17", "19"]
    assert set(codes(search="2")) == {"02", "12", "20", "21", "22"}
    bridge = spark.sql("SELECT 'p' AS product_name, 'm' AS material_name, 1BD AS ratio, 1 AS version_number,"
                       " current_date() AS effective_date, current_date() AS end_date, false AS is_current")
    assert dimension_lists.list_formulas(bridge).count() == 0
    assert dimension_lists.list_formulas(bridge, is_current=None).count() == 1
    paths = spark.createDataFrame([("/app/media/blueprints/a.svg",), ("/x/a.svg",), (None,)], "p string")
    assert [r[0] for r in paths.select(dimension_lists.public_url(F.col("p"))).collect()] == [
        "/dw-media/blueprints/a.svg", None, None]


def test_patch_applies_in_order(spark, factory_table):
    patches = spark.createDataFrame(
        [(1, "00", False, None), (2, "00", None, False), (3, "00", True, None), (4, "zz", True, True),
         (5, "01", None, None)], "seq long, factory_code string, is_active boolean, has_onsite boolean")
    table, outcomes = dimension_changes.patch_factories(factory_table, patches)
    assert {r.seq: r.outcome for r in outcomes.collect()} == {
        1: "updated", 2: "updated", 3: "updated", 4: "not_found", 5: "empty"}
    rows = {r.factory_code: (r.is_active, r.has_onsite) for r in table.collect()}
    assert rows["00"] == (True, False) and rows["01"] == (False, False) and len(rows) == 23


def test_rename(spark):
    table = spark.createDataFrame([("1", "North"), ("2", "South"), ("3", "East")], TABLES["dim_retailer"])
    requests = spark.createDataFrame(
        [(1, "1", "SOUTH"), (2, "2", "south"), (3, "3", "West"), (4, "9", "Any"), (5, "3", "x" * 256)],
        "seq long, id string, name string")
    after, outcomes = dimension_changes.rename_retailers(table, requests)
    assert {r.seq: r.outcome for r in outcomes.collect()} == {
        1: "name_taken", 2: "updated", 3: "updated", 4: "not_found", 5: "invalid"}
    assert {r.id: r.name for r in after.collect()} == {"1": "North", "2": "south", "3": "West"}


def test_pages_after_a_key(spark):
    from tallymill.operators.paging import page, page_after

    rows = spark.createDataFrame([(a, b) for a in "abcd" for b in range(5)], "a string, b int").repartition(3)
    seen, last = [], {"a": "", "b": -1}
    while True:
        part = [tuple(r) for r in page_after(rows, last, 3).collect()]
        if not part:
            break
        seen, last = seen + part, dict(zip(last, part[-1]))
    assert seen == sorted(seen) and len(seen) == 20
    assert seen[3:6] == [tuple(r)[:2] for r in page(rows, ["a", "b"], 2, 3).collect()]


def test_totals_read_each_fact_once(spark):
    import __spark_entry__ as contract

    plan = contract.queries()["overall"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    scans = [line for line in plan.toString().splitlines() if "Relation" in line]
    assert sum("l_shipdate" in s for s in scans) == 1
    assert sum("o_orderdate" in s for s in scans) == 1


def test_place_in_order(spark):
    rows = spark.range(5000).selectExpr("(id * 7919) % 5000 AS v", "id % 3 AS w").repartition(6)
    found = place_in_order(rows.orderBy("v"), "place")
    assert found.where("place <> v + 1").count() == 0 and found.count() == 5000
    assert found.columns == ["v", "w", "place"]
    assert place_in_order(rows.where("v < 0").orderBy("v"), "place").count() == 0
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not any("Window [" in x and "row_number" in x for x in lines)


@pytest.mark.parametrize("bits", [1 << 26, 1 << 15, 64])
def test_may_hold_keeps_all_that_match(spark, bits):
    rows = spark.range(20_000).selectExpr("concat('k', id) AS k", "id")
    keys = spark.range(0, 20_000, 40).selectExpr("if(id = 0, null, concat('k', id)) AS k", "id AS other")
    found = may_hold(rows, "k", keys, bits)
    kept = {r.id for r in found.collect()}
    assert found.columns == ["k", "id"] and kept >= set(range(40, 20_000, 40))
    assert len(kept) <= (600 if bits > 1 << 20 else 20_000)
    assert may_hold(rows, "k", keys.limit(0), bits).count() == 0


def test_unsold_orders_are_not_shuffled(spark):
    from tallymill.params import DateRange
    from tallymill.plans.calendars import calendar_days
    from tallymill.plans.monthly import same_month_sales

    orders = spark.range(30_000).selectExpr(
        "concat('o', id) AS order_code", "date_add(date'2024-01-01', int(id % 60)) AS order_date", "1.0D AS order_quantity")
    sales = spark.range(200).selectExpr("concat('o', id * 100) AS order_code",
                                        "date'2024-02-10' AS sales_date", "2.0D AS sales_quantity")
    days = calendar_days(spark, DateRange.of("2024-01-01", "2024-12-31"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = same_month_sales(sales, orders, days, DateRange.of("2024-02-01", "2024-02-20"),
                                 DateRange.of("2024-01-01", "2024-01-02"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        totals = {(r.month, r.same_month_sales, r.diff_month_sales) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "bitmap_construct_agg" in plan and "BroadcastHashJoin" in plan
    same = sum(2.0 for i in range(200) if (i * 100) % 60 >= 31)
    assert totals == {(1, 0.0, 0.0), (2, same, 400.0 - same)}


def test_deep_pages_read_few_ranges(spark):
    rows = spark.range(40_000).selectExpr("(id * 7919) % 40000 AS v", "id % 7 AS w").repartition(9)
    found = page(rows, ["v"], 361, 100, deep=5_000)
    assert [r.v for r in found.collect()] == list(range(36_000, 36_100))
    assert found.columns == ["v", "w", "total_count"] and found.first().total_count == 40_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "__part" in plan.split("PushedFilters: [")[1].split("]")[0] and "Limit" not in plan
    for number, expected in ((1, range(100)), (400, range(39_900, 40_000)), (401, range(0))):
        assert [r.v for r in page(rows, ["v"], number, 100, deep=0).collect()] == list(expected)
    wide = page(rows, ["v"], 2, 15_000, deep=5_000)
    assert [r.v for r in wide.collect()] == list(range(15_000, 30_000))
    assert page(rows.limit(0), ["v"], 3, 100, deep=0).count() == 0
