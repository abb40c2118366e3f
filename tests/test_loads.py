"""Extract reading, cleaning and whole loads on hand-made files."""

from __future__ import annotations

import csv
import os
import time
from datetime import date, datetime
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from extract_rows import write_orders, write_sales
from pyspark.sql import functions as F

from tallymill.plans import facts, staging
from tallymill.operators.upsert import insert_absent, one_row_per_key, upsert
from tallymill.plans.loads import load_order_files, load_orders, load_sales, load_sales_files
from tallymill.schemas import ORDER_STAGING_COLUMNS, SALES_EXTRACT
from tallymill.sources.landing import (
    SUFFIXES, ColumnMismatch, admit, listed_files, read_listed, read_order_extract, read_sales_extract,
)
from tallymill.session import durable, shared_folder
from tallymill.sources.tables import COPIED, Store, padded
from tallymill.streaming.landing import load_landed_orders, load_landed_sales

T1, T2, T3 = (datetime(2024, 3, d, 8) for d in (1, 2, 3))


def column(df, name):
    return sorted(str(r[0]) for r in df.select(name).collect())


def by_code(df, code):
    return {r[code]: r for r in df.collect()}


def test_admission(spark, tmp_path):
    write_orders(tmp_path / "good.csv", {})
    (tmp_path / "Also.CSV").write_text("a\n")
    (tmp_path / "sheet.xlsx").write_text("x")
    (tmp_path / "plain").write_text("x")
    write_orders(tmp_path / "two words %.csv", {})
    (tmp_path / "large.csv").write_text("x" * 3000)
    (tmp_path / "no bytes %41.csv").write_text("")
    (tmp_path / "none.xlsx").write_text("")
    accepted, rejected = admit(spark, str(tmp_path), max_bytes=2000)
    names = [p.rsplit("/", 1)[1] for p in column(accepted, "path")]
    assert names == ["Also.CSV", "good.csv", "two words %.csv"]
    reasons = {r.path.rsplit("/", 1)[1]: r.reject_reason for r in rejected.collect()}
    assert reasons == {"sheet.xlsx": "wrong_suffix", "plain": "wrong_suffix", "large.csv": "too_large",
                       "no bytes %41.csv": "empty_file", "none.xlsx": "wrong_suffix"}
    assert admit(spark, str(tmp_path)).accepted.count() == 4


def test_admission_reads_no_content(spark, tmp_path):
    write_orders(tmp_path / "good.csv", {})
    plan = admit(spark, str(tmp_path)).accepted._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_files_of_another_width_are_refused(spark, tmp_path):
    """A file without its last column must not shift or lose cells; the others are read."""
    write_sales(tmp_path / "good.csv", {}, {})
    lines = (tmp_path / "good.csv").read_text().splitlines()
    (tmp_path / "short.csv").write_text("\n".join(x.rsplit(",", 1)[0] for x in lines) + "\n")
    (tmp_path / "long.csv").write_text("\n".join([*lines, lines[1] + ",more"]) + "\n")
    landed = read_sales_extract(spark, str(tmp_path))
    assert landed.rows.count() == 2
    refused = {r.path.rsplit("/", 1)[1]: r.reject_reason for r in landed.refused.collect()}
    assert refused == {"short.csv": "column_count", "long.csv": "column_count"}
    raw = spark.read.option("header", True).csv(str(tmp_path / "short.csv")).coalesce(1)
    raw.write.parquet(str(tmp_path / "p.parquet"))
    with pytest.raises(ColumnMismatch, match="expected 15 columns, found 14"):
        read_sales_extract(spark, str(tmp_path / "p.parquet"), "parquet")
    store = Store(spark, str(tmp_path / "warehouse"))
    load_sales_files(store, landed, T1)
    assert store.read("landing_rejects").count() == 2 and store.read("fact_sales").count() == 2


def test_batches_judge_files_too(spark, tmp_path):
    write_sales(tmp_path / "good.CSV", {}, {})
    write_sales(tmp_path / "a.txt", {})
    (tmp_path / "e.csv").write_text("")
    landed = read_sales_extract(spark, str(tmp_path))
    assert landed.rows.count() == 2
    refused = {r.path.rsplit("/", 1)[1]: r.reject_reason for r in landed.refused.collect()}
    assert refused == {"a.txt": "wrong_suffix", "e.csv": "empty_file"}
    bounded = read_sales_extract(spark, str(tmp_path), max_bytes=100)
    assert bounded.rows.count() == 0
    assert {r.reject_reason for r in bounded.refused.collect()} == {"wrong_suffix", "empty_file", "too_large"}


DATES = {"31-12-2024": "2024-12-31", "31.12.2024": "2024-12-31", "2024/12/31": "2024-12-31",
         "31/12/2024 00:00:00": "2024-12-31", "2024-12-31T00:00:00": "2024-12-31", "1/3/2024": "2024-03-01",
         "2024-3-1 8:05": "2024-03-01", "01.03.2024T23:59:59.25": "2024-03-01", "31/02/2024": None,
         "12/31/2024": None, "1/3-2024": None, "2024-12-31 junk": None, "31/12/24": None, "": None,
         "2024-12-31 25:00": None, "20241231": None}


def test_date_forms(spark):
    from tallymill.functions.dates import parse_day_first

    rows = spark.createDataFrame(list(DATES), "string").select(
        "value", parse_day_first(F.col("value")).cast("string").alias("day"))
    assert {r.value: r.day for r in rows.collect()} == DATES


def test_order_cleaning(spark, tmp_path):
    path = write_orders(
        tmp_path / "orders.csv",
        {"order_code": "", "note": "no code"}, {"numerical_order": "NA"},
        {"numerical_order": "seven"}, {"order_quantity": "many"},
        {"order_code": "2201-2", "numerical_order": "7", "order_date": "31/12/2024"},
        {"order_code": "2201-3", "numerical_order": "12345.0", "order_date": "2024-03-01"},
        {"order_code": "2201-4", "order_date": "junk", "factory_code": "30895.01", "qc": ""},
        {"order_code": "2201-5", "order_date": "1/3/2024", "note": 'two\nlines, "quoted"'},
        {"order_code": "2201-6", "order_date": "2024-03-01 00:00:00", "factory_code": ""},
    )
    cleaned = staging.clean_orders(read_order_extract(spark, path, multiline=True).rows, T1)
    reasons = sorted(r.reject_reason for r in staging.rejected(cleaned).collect())
    assert reasons == ["bad_ordinal", "bad_quantity", "missing_code", "missing_code"]
    rows = by_code(staging.accepted(cleaned), "order_code")
    assert set(rows) == {"2201-2-0007", "2201-3-12345", "2201-4-0001", "2201-5-0001", "2201-6-0001"}
    assert rows["2201-2-0007"].order_date == date(2024, 12, 31)
    assert rows["2201-2-0007"].numerical_order == "0007"
    assert rows["2201-3-12345"].order_date == date(2024, 3, 1)
    assert rows["2201-4-0001"].order_date is None
    assert rows["2201-4-0001"].factory_code == "308951"
    assert rows["2201-4-0001"].qc is None
    assert rows["2201-5-0001"].order_date == date(2024, 3, 1)
    assert rows["2201-5-0001"].note == 'two\nlines, "quoted"'
    assert rows["2201-5-0001"].factory_code == "30673"
    assert rows["2201-6-0001"].order_date == date(2024, 3, 1)
    assert rows["2201-6-0001"].factory_code is None
    whole = padded("order_staging", staging.accepted(cleaned))
    assert whole.columns == ORDER_STAGING_COLUMNS and len(whole.columns) == 76


@pytest.mark.parametrize("file_format", ["csv", "split csv", "parquet"])
def test_sales_ordinals_follow_the_file(spark, tmp_path, file_format):
    """Line numbers restart per code and follow file order, over any number of splits."""
    codes = [f"2301-{i % 3 if i % 2 else 9}" for i in range(3000)]
    path = write_sales(tmp_path / "sales.csv", *[
        {"sales_code": c, "sales_quantity": str(i)} for i, c in enumerate(codes)])
    options = {}
    if file_format == "parquet":
        raw = spark.read.option("header", True).csv(path).coalesce(1)
        path = str(tmp_path / "sales.parquet")
        raw.write.parquet(path)
        options = {"file_format": "parquet"}
    elif file_format == "split csv":
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        extract = read_sales_extract(spark, path, **options).rows
        if file_format == "split csv":
            assert extract.select("source_chunk").distinct().count() > 5
        rows = staging.accepted(staging.clean_sales(extract, T1)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    seen, expected = {}, {}
    for i, code in enumerate(codes):
        seen[code] = seen.get(code, 0) + 1
        expected[f"{code}-{seen[code]:04d}"] = float(i)
    assert {r.sales_code: r.sales_quantity for r in rows} == expected


def test_factory_split(spark):
    from tallymill.functions.factories import split_factory

    cases = {"ST 1": "30895.1", "tn-2": "30895", "xBP": "30895.5", "QT": "30895.4",
             "ST-QT": "30895.4", "BP TN": "30895.5", "other": "30895.2", None: "30895.2"}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "tag string, code string")
    got = rows.withColumn("got", split_factory(F.lit("30895.2"), F.col("tag")))
    assert got.filter("got <> code").count() == 0
    kept = rows.withColumn("got", split_factory(F.lit("7"), F.col("tag")))
    assert kept.filter("got <> '7'").count() == 0
    assert rows.limit(1).select(split_factory(F.lit(None).cast("string"), F.lit("ST"))).first()[0] is None


def test_order_load(spark, tmp_path):
    store = Store(spark, str(tmp_path / "warehouse"))
    first = write_orders(
        tmp_path / "1.csv",
        {"order_code": "2201-1", "order_quantity": "10", "note": "first"},
        {"order_code": "2201-1", "order_quantity": "11", "note": "second"},
        {"order_code": "2201-2", "qc": ""},
        {"order_code": "2202-3"},
        {"order_code": "2201-4", "factory_code": "30895.2", "factory_order_code": "tn 5",
         "order_date": "5/4/2024", "product_name": "Matt.0"},
        {"order_code": "2201-5", "factory_code": "30673", "factory_name": "North new",
         "order_date": "9/3/2024"},
        {"order_code": "2201-6", "factory_code": "30673", "factory_name": "North undated",
         "order_date": "junk"},
        {"order_code": ""},
    )
    stats = load_order_files(store, read_order_extract(spark, first), T1).first().asDict()
    assert stats == {
        "staging_inserted": 6, "staging_updated": 0, "staging_skipped": 1, "staging_rejected": 1,
        "staging_bad_dates": 1, "fact_inserted": 4, "fact_updated": 0, "fact_rejected": 2, "factories_added": 2,
        "products_added": 2}
    staged = by_code(store.read("order_staging"), "order_code")
    assert staged["2201-1-0001"].order_quantity == 11
    assert staged["2201-1-0001"].note == "first"
    orders = by_code(store.read("fact_order"), "order_code")
    assert set(orders) == {f"2201-{i}-0001" for i in (1, 4, 5, 6)}
    assert orders["2201-4-0001"].factory_code == "30895"
    factories = by_code(store.read("dim_factory"), "factory_code")
    assert set(factories) == {"30673", "30895.2"}
    assert factories["30673"].factory_name == "North new"
    assert factories["30673"].salesman == "Unassigned"
    assert factories["30673"].is_active and not factories["30673"].has_onsite
    products = store.read("dim_product").collect()
    assert sorted((r.id, r.product_type) for r in products) == [(1, None), (2, None)]
    assert {r.product_name for r in products} == {"Gloss", "Matt"}

    # The same file again: no new fact rows.
    stats = load_order_files(store, read_order_extract(spark, first), T2).first().asDict()
    assert (stats["staging_inserted"], stats["staging_updated"]) == (0, 6)
    assert (stats["fact_inserted"], stats["fact_updated"]) == (0, 4)
    assert stats["factories_added"] == stats["products_added"] == 0
    assert store.read("fact_order").count() == 4

    # A correction: only the two quantities and the time change.
    second = write_orders(
        tmp_path / "2.csv",
        {"order_code": "2201-4", "order_quantity": "99", "delivered_quantity": "",
         "product_name": "Other", "order_date": "1/1/2020"},
        {"order_code": "2201-7", "order_date": "5/4/2024", "product_name": "Satin"})
    before = by_code(store.read("fact_order"), "order_code")
    load_order_files(store, read_order_extract(spark, second), T3)
    after = by_code(store.read("fact_order"), "order_code")
    assert after["2201-4-0001"].order_quantity == 99
    assert after["2201-4-0001"].delivered_quantity is None
    assert after["2201-4-0001"].product_name == "Matt"
    assert after["2201-4-0001"].order_date == date(2024, 4, 5)
    assert after["2201-4-0001"].import_timestamp == T1
    assert after["2201-4-0001"].import_wh_timestamp == T3
    # The second load had updates only and so left the watermark behind: its rows are read
    # once more, which restamps them and changes nothing else.
    was, now = before["2201-1-0001"].asDict(), after["2201-1-0001"].asDict()
    assert was.pop("import_wh_timestamp") == T2 and now.pop("import_wh_timestamp") == T3
    assert was == now
    assert set(after) - set(before) == {"2201-7-0001"}
    products = by_code(store.read("dim_product"), "product_name")
    assert set(products) == {"Gloss", "Matt", "Satin"} and products["Satin"].id == 3


def test_sales_load(spark, tmp_path):
    store = Store(spark, str(tmp_path / "warehouse"))
    first = write_sales(
        tmp_path / "1.csv",
        {"sales_code": "2301-1", "sales_quantity": "1.5"},
        {"sales_code": "2301-1", "sales_quantity": "2"},
        {"sales_code": "2302-1", "factory_code": "30895.2", "factory_order_code": "ST-QT"},
        {"sales_code": "2303-1"}, {"sales_code": "2301-2", "qc": ""}, {"sales_code": ""},
        {"sales_code": "2301-3", "factory_code": "", "sales_date": "junk"},
    )
    stats = load_sales_files(store, read_sales_extract(spark, first), T1).first().asDict()
    assert stats["staging_inserted"] == 6 and stats["staging_rejected"] == 1
    assert stats["fact_inserted"] == 4 and stats["fact_rejected"] == 2
    sales = by_code(store.read("fact_sales"), "sales_code")
    assert set(sales) == {"2301-1-0001", "2301-1-0002", "2302-1-0001", "2301-3-0001"}
    assert sales["2302-1-0001"].factory_code == "30895.4"
    assert sales["2301-3-0001"].factory_code is None
    assert sales["2301-3-0001"].sales_date is None
    assert store.read("dim_factory").count() == 0

    # A corrected upload is ignored; a new line is not.
    second = write_sales(tmp_path / "2.csv", {"sales_code": "2301-1", "sales_quantity": "77"},
                         {"sales_code": "2301-8", "sales_quantity": "3"})
    stats = load_sales_files(store, read_sales_extract(spark, second), T2).first().asDict()
    assert (stats["staging_inserted"], stats["staging_skipped"]) == (1, 1)
    assert (stats["fact_inserted"], stats["fact_updated"]) == (1, 0)
    after = by_code(store.read("fact_sales"), "sales_code")
    assert after["2301-1-0001"].sales_quantity == 1.5
    assert after["2301-8-0001"].sales_quantity == 3

    # Nothing new: the load ends early, and nothing is written.
    load = store.last_load("fact_sales")
    stats = load_sales_files(store, read_sales_extract(spark, second), T3).first().asDict()
    assert stats["staging_skipped"] == 2 and stats["fact_inserted"] == 0
    assert store.last_load("fact_sales") == load


def test_empty_extract(spark, tmp_path):
    store = Store(spark, str(tmp_path / "warehouse"))
    stats = load_order_files(store, read_order_extract(spark, write_orders(tmp_path / "o.csv")), T1)
    assert set(stats.first()) == {0}
    stats = load_sales_files(store, read_sales_extract(spark, write_sales(tmp_path / "s.csv")), T1)
    assert set(stats.first()) == {0}


def _files(root, table):
    return {p: p.stat().st_mtime_ns for p in (Path(root) / table).rglob("*.parquet")}


def test_update_rewrites_only_matched_months(spark, tmp_path):
    store = Store(spark, str(tmp_path / "warehouse"))
    path = write_orders(tmp_path / "1.csv", *[
        {"order_code": f"2201-{m}", "order_date": f"1/{m}/2024"} for m in range(1, 7)])
    load_order_files(store, read_order_extract(spark, path), T1)
    old = _files(store.root, "fact_order")
    assert len({p.parent for p in old}) == 6
    path = write_orders(tmp_path / "2.csv", {"order_code": "2201-3", "order_quantity": "50"},
                        {"order_code": "2201-9", "order_date": "1/9/2024"})
    load_order_files(store, read_order_extract(spark, path), T2)
    new = _files(store.root, "fact_order")
    months = lambda files: {p.parent.name for p in files}
    assert months(old.keys() - new.keys()) == {"order_date_month=2024-03-01"}
    assert months(new.keys() - old.keys()) == {"order_date_month=2024-03-01", "order_date_month=2024-09-01"}
    assert store.read("fact_order").count() == 7


def test_insert_only_adds_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "warehouse"))
    for i, when in enumerate((T1, T2)):
        path = write_sales(tmp_path / f"{i}.csv", {"sales_code": f"2301-{i}"})
        load_sales_files(store, read_sales_extract(spark, path), when)
        if i == 0:
            old = _files(store.root, "fact_sales")
    assert old.items() < _files(store.root, "fact_sales").items()
    assert store.read("fact_sales").count() == 2
    store.compact("fact_sales", [date(2024, 3, 1)])
    assert store.read("fact_sales").count() == 2 and not old.keys() & _files(store.root, "fact_sales").keys()


def test_reports_prune_stored_months(spark, tmp_path):
    from tallymill.functions.dates import days_within
    from tallymill.params import DateRange

    store = Store(spark, str(tmp_path / "warehouse"))
    path = write_sales(tmp_path / "1.csv", *[
        {"sales_code": f"2301-{m}", "sales_date": f"15/{m}/2024"} for m in range(1, 13)])
    load_sales_files(store, read_sales_extract(spark, path), T1)
    rows = days_within(store.read("fact_sales"), "sales_date", [DateRange.of("2024-03-10", "2024-04-20")])
    assert rows.count() == 2
    plan = rows._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "sales_date_month" in filters
    assert len(rows.inputFiles()) <= 12


def test_landed_files_load_as_a_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "warehouse"))
    orders, sales = tmp_path / "orders", tmp_path / "sales"
    orders.mkdir(), sales.mkdir()
    write_orders(orders / "1.csv", {"order_code": "2201-1"}, {"order_code": "2201-2"})
    write_sales(sales / "1.csv", {"sales_code": "2301-1"}, {"sales_code": "2301-1"})
    seen = []

    def run():
        for start, name in ((load_landed_orders, "orders"), (load_landed_sales, "sales")):
            query = start(store, str(tmp_path / name), str(tmp_path / f"checkpoint-{name}"),
                          on_stats=lambda stats: seen.append(stats.first().asDict()))
            query.awaitTermination(120)
            assert query.exception() is None

    run()
    assert [s["fact_inserted"] for s in seen] == [2, 2]
    write_orders(orders / "2.csv", {"order_code": "2201-2", "order_quantity": "44"},
                 {"order_code": "2201-3"})
    run()
    assert len(seen) == 3 and (seen[2]["fact_inserted"], seen[2]["fact_updated"]) == (1, 1)
    rows = by_code(store.read("fact_order"), "order_code")
    assert rows["2201-2-0001"].order_quantity == 44 and len(rows) == 3
    assert set(by_code(store.read("fact_sales"), "sales_code")) == {"2301-1-0001", "2301-1-0002"}


def test_reject_reasons_of_facts(spark, tmp_path):
    path = write_sales(tmp_path / "s.csv", {"sales_code": "2303-1"}, {"qc": "nan"}, {})
    staged = staging.staged_sales(staging.clean_sales(read_sales_extract(spark, path).rows, T1))
    labelled = facts.sales_facts(staged, T1)
    assert column(staging.rejected(labelled), "reject_reason") == ["missing_qc", "other_document"]
    assert column(staging.accepted(labelled), "sales_code") == ["2301-1-0002"]


def _arrive(path, age):
    """Set a file's time of arrival, `age` seconds ago."""
    then = time.time() - age
    os.utime(path, (then, then))


def _land(folder, kind):
    """Files whose order of arrival is not that of their names."""
    folder.mkdir()
    write, code, quantity, first = {
        "sales": (write_sales, "sales_code", "sales_quantity", "2301-1"),
        "orders": (write_orders, "order_code", "order_quantity", "2201-1")}[kind]
    files = [("9.csv", [{code: first, quantity: "5"}, {code: first + "7", quantity: "1"}]),
             ("10.CSV", [{code: first, quantity: "20"}]),
             ("10 again.csv", [{code: first, quantity: "20"}]),
             ("[1].csv", [{code: first + "8", quantity: "3"}]),
             ("0.csv", [{code: first, quantity: "30"}])]
    for i, (name, rows) in enumerate(files):
        write(folder / name, *rows)
        _arrive(folder / name, 100 - i)
    raw = write(folder / "aside", {code: first + "9", quantity: "4"})
    (folder / "aside").rename(folder.parent / f"{kind}.aside")
    table = csv.DictReader(open(folder.parent / f"{kind}.aside"))
    pq.write_table(pa.Table.from_pylist(list(table)), folder / "late.parquet")
    (folder / "notes.txt").write_text("x")
    (folder / "empty.csv").write_text("")
    return raw


@pytest.mark.parametrize("max_files", [1, 1000])
def test_tables_do_not_depend_on_triggers(spark, tmp_path, max_files):
    store = Store(spark, str(tmp_path / "warehouse"))
    for kind, start in (("sales", load_landed_sales), ("orders", load_landed_orders)):
        _land(tmp_path / kind, kind)
        query = start(store, str(tmp_path / kind), str(tmp_path / f"progress-{kind}"), max_files=max_files)
        query.awaitTermination()
    sales = {r.sales_code: r.sales_quantity for r in store.read("fact_sales").collect()}
    assert sales == {"2301-1-0001": 5, "2301-17-0001": 1, "2301-18-0001": 3, "2301-19-0001": 4}
    orders = {r.order_code: r.order_quantity for r in store.read("fact_order").collect()}
    assert orders == {"2201-1-0001": 30, "2201-17-0001": 1, "2201-18-0001": 3, "2201-19-0001": 4}
    reasons = sorted(r.reject_reason for r in store.read("landing_rejects").collect())
    assert reasons == ["empty_file"] * 2 + ["wrong_suffix"] * 2


def test_many_parquet_files_make_one_scan(spark, tmp_path):
    raw = csv.DictReader(open(write_sales(tmp_path / "raw.txt", {}, {})))
    table = pa.Table.from_pylist(list(raw))
    folder = tmp_path / "landed"
    folder.mkdir()
    for i in range(12):
        pq.write_table(table, folder / f"{i}.parquet")

    def read():
        files = listed_files(spark, str(folder))
        return read_listed(spark, files, SALES_EXTRACT, False, SUFFIXES, None, lambda df: df)

    plan = read().rows._jdf.queryExecution().analyzed().toString()
    assert read().rows.count() == 24 and plan.count("Union") == 0
    pq.write_table(table.select(table.column_names[:-1]), folder / "short.parquet")
    landed = read()
    assert landed.rows.count() == 24
    assert [(r.path.rsplit("/", 1)[1], r.reject_reason) for r in landed.refused.collect()] == [
        ("short.parquet", "column_count")]


def test_large_files_are_loaded(spark, tmp_path):
    folder = tmp_path / "large"
    folder.mkdir()
    write_orders(folder / "large.csv", *[{"order_code": f"2201-{i}", "note": "n" * 90_000} for i in range(620)])
    assert (folder / "large.csv").stat().st_size > 50 << 20
    store = Store(spark, str(tmp_path / "warehouse"))
    load_landed_orders(store, str(folder), str(tmp_path / "progress")).awaitTermination()
    assert store.read("fact_order").count() == 620
    small = Store(spark, str(tmp_path / "bounded"))
    load_landed_orders(small, str(folder), str(tmp_path / "progress-2"), max_bytes=1000).awaitTermination()
    assert [r.reject_reason for r in small.read("landing_rejects").collect()] == ["too_large"]


def test_dimensions_see_rows_of_a_load_that_ended_early(spark, tmp_path):
    store = Store(spark, str(tmp_path / "warehouse"))
    load = lambda name, row, now: load_order_files(store, read_order_extract(
        spark, write_orders(tmp_path / name, row)), now).first()
    load("1.csv", {"order_code": "2201-1"}, T2)
    # Stamped before the watermark: no fact row, and no look at the dimensions.
    early = load("2.csv", {"order_code": "2201-2", "factory_code": "77"}, T1)
    assert early.staging_inserted == 1 and early.fact_inserted == early.factories_added == 0
    assert load("3.csv", {"order_code": "2201-3", "factory_code": "88"}, T3).factories_added == 2
    assert set(by_code(store.read("dim_factory"), "factory_code")) == {"30673", "77", "88"}


def _stored_orders(spark, root, number):
    store = Store(spark, str(root))
    rows = spark.range(number).select(
        F.concat(F.lit("2201-"), F.col("id").cast("string")).alias("order_code"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("order_date"),
        F.lit(1.0).alias("order_quantity"), F.lit(T1.isoformat(sep=" ")).cast("timestamp").alias("import_timestamp"))
    store.append("fact_order", rows)
    return store


def _batch(spark, *rows):
    return spark.createDataFrame(rows, "order_code string, order_date date, order_quantity double, "
                                       "import_timestamp timestamp")


def test_a_load_that_ended_while_it_overwrote_is_finished(spark, tmp_path, monkeypatch):
    store = _stored_orders(spark, tmp_path, 900)
    write = Store._write

    def lost(self, table, rows, overwrite=False):
        if overwrite:  # the months are gone, and nothing has taken their place
            for folder in (tmp_path / table).glob("order_date_month=2024-01-01"):
                for file in folder.iterdir():
                    file.unlink()
            raise OSError("gone")
        write(self, table, rows, overwrite)

    new = _batch(spark, ("2201-0", date(2024, 1, 1), 7.0, T2), ("2201-new", date(2024, 5, 1), 8.0, T2))
    monkeypatch.setattr(Store, "_write", lost)
    with pytest.raises(OSError):
        store.upsert("fact_order", new, ["order_quantity"])
    monkeypatch.undo()
    again = Store(spark, str(tmp_path))
    assert again.upsert("fact_order", new, ["order_quantity"]) == {"inserted": 0, "updated": 2}
    rows = {r.order_code: r.order_quantity for r in again.read("fact_order").collect()}
    assert len(rows) == 901 and rows["2201-0"] == 7 and rows["2201-new"] == 8 and rows["2201-1"] == 1
    states = [r.state for r in again._table("loads").orderBy("load").collect()]
    assert states.count(COPIED) == 2 and states[-1] != COPIED
    assert not list((tmp_path / "copies").iterdir()) and not again.finish("fact_order")


def test_another_session_finds_the_tables(spark, tmp_path):
    _stored_orders(spark, tmp_path, 300)
    other = spark.newSession()
    for name in [t.name for t in other.catalog.listTables()]:
        other.sql(f"DROP TABLE {name}")  # what a new catalog does not know
    store = Store(other, str(tmp_path))
    assert store.read("fact_order").count() == 300
    assert store.insert_absent("fact_order", _batch(other, ("2201-5", None, 1.0, T2), ("x", None, 1.0, T2))) == {
        "inserted": 1}
    assert Store(spark, str(tmp_path)).read("fact_order").where("order_date_month IS NULL").count() == 1
    with pytest.raises(ValueError, match="8 buckets, not 4"):
        Store(spark, str(tmp_path), buckets=4)


def test_stored_rows_are_not_shuffled(spark, tmp_path):
    """Neither where a large batch meets stored keys nor where it meets the rows of touched months."""
    store = _stored_orders(spark, tmp_path, 20_000)
    new = durable(_batch(spark, ("2201-5", date(2024, 1, 6), 9.0, T2), ("2201-x", date(2024, 1, 6), 9.0, T2)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = store.near_keys("fact_order", "2201-5", "2201-x")
        month = store.read_months("fact_order", [date(2024, 1, 1)])
        assert column(insert_absent(near, new, "order_code"), "order_code") == ["2201-x"]
        for frame in (insert_absent(near, new, "order_code"), near.join(new.select("order_code"), "order_code"),
                      upsert(month, new, "order_code", ["order_quantity"])):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            lines = plan.splitlines()
            scan = next(i for i, x in enumerate(lines) if "Bucketed: true" in x)
            depth = lambda x: len(x) - len(x.lstrip(" :+-"))
            above, limit = [], depth(lines[scan])
            for x in reversed(lines[:scan]):
                if depth(x) < limit:
                    above, limit = [*above, x], depth(x)
            assert not any("Exchange" in x for x in above if "Broadcast" not in x), plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "PushedFilters: [IsNotNull(order_code), GreaterThanOrEqual(order_code,2201-5)" in (
        near._jdf.queryExecution().executedPlan().toString())


def test_incremental_reads_open_newer_months_only(spark, tmp_path):
    store = _stored_orders(spark, tmp_path, 900)
    first, load = store.newest("fact_order"), store.last_load("fact_order")
    store.append("fact_order", _batch(spark, ("2201-new", date(2024, 1, 5), 1.0, T2)))
    rows = store.read_since("fact_order", first)
    assert column(rows, "order_code") == ["2201-new"]
    assert {f.rsplit("/", 2)[1] for f in rows.inputFiles()} == {"order_date_month=2024-01-01"}
    assert store.newest("fact_order") > first
    assert store.read_since("fact_order", store.newest("fact_order")).count() == 0
    assert column(store.read_stored_after("fact_order", load).where("order_quantity = 1").select(
        "order_date_month").distinct(), "order_date_month") == ["2024-01-01"]


def test_reports_by_delivery_date_skip_parts_of_files(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=1)
    rows = spark.range(60_000).selectExpr(
        "concat('2201-', uuid()) AS order_code", "date'2024-01-05' AS order_date",
        "date_add(date'2024-02-01', int(id * 7919 % 300)) AS estimated_delivery_date")
    spark._jsc.hadoopConfiguration().set("parquet.page.row.count.limit", "1000")
    try:
        store.append("fact_order", rows)
    finally:
        spark._jsc.hadoopConfiguration().unset("parquet.page.row.count.limit")
    month = store.read("fact_order").where("estimated_delivery_date BETWEEN date'2024-03-01' AND date'2024-03-31'")
    found = month.select("order_code", "estimated_delivery_date")
    assert found.where("estimated_delivery_date IS NULL").count() == 0
    assert found.count() == found.toPandas().shape[0] == 6200
    scan = found._jdf.queryExecution().executedPlan()
    found._jdf.queryExecution().toRdd().count()
    while scan.children().size():
        scan = scan.children().head()
    assert scan.metrics().apply("numOutputRows").value() < 15_000


def test_one_row_per_key_sorts_no_rows(spark):
    rows = durable(spark.range(2000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('k', id % 500)) AS k", "id AS place_of", "concat('a', id) AS a",
        "if(id % 2 = 0, null, id) AS b"))
    found = one_row_per_key(rows, "k", F.col("place_of"), ["place_of"], ["b"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    truth = {}
    for r in rows.orderBy("place_of").collect():
        truth.setdefault(r.k, [r.a, r.b])[1] = r.b
    assert {r.k: [r.a, r.b] for r in found.collect()} == truth and found.columns == ["k", "a", "b"]


def test_loads_leave_no_copies(spark, tmp_path):
    store = Store(spark, str(tmp_path / "warehouse"))
    shared = Path(shared_folder(spark)) / "tallymill"
    landed = read_sales_extract(spark, write_sales(tmp_path / "1.csv", {}))
    before = set(shared.iterdir())
    load_sales_files(store, landed, T1)
    assert set(shared.iterdir()) == before


def test_newest_sales_date_reads_one_month(spark, tmp_path):
    from tallymill.plans.totals import max_sales_date

    store = Store(spark, str(tmp_path))
    rows = [(f"2301-{m}", date(2024, m, 3)) for m in range(1, 13)]
    store.append("fact_sales", spark.createDataFrame(rows, "sales_code string, sales_date date"))
    newest = max_sales_date(store.read("fact_sales"))
    assert newest.first()[0] == "2024-12-03"
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "sales_date_month" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_rows_of_few_repeated_keys_are_not_shuffled(spark):
    rows = durable(spark.range(2000).selectExpr(
        "concat('k', id % 1990) AS k", "id AS place_of", "concat('a', id) AS a"))
    found = one_row_per_key(rows, "k", F.col("place_of"), ["place_of"], cut=durable)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert {(r.k, r.a) for r in found.collect()} == {(f"k{i}", f"a{i}") for i in range(1990)}


def test_a_batch_from_written_rows_is_not_written_again(spark, tmp_path, monkeypatch):
    from tallymill import session

    store = _stored_orders(spark, tmp_path, 900)
    rows = [(f"2201-{i}", date(2024, 5, i % 3 + 1), 1.0, T2) for i in range(890, 910)]
    new, batch = durable(_batch(spark, *rows)), {"n": 20, "least": "2201-890", "most": "2201-909"}
    copies = []
    monkeypatch.setattr(session, "durable", lambda df, folder=None: copies.append(1) or durable(df, folder))
    shuffles = []
    write = Store._write

    def seen(self, table, rows, overwrite=False):
        rows = rows.repartition(self.buckets, "order_code")
        shuffles.append(rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        write(self, table, rows, overwrite)

    monkeypatch.setattr(Store, "_write", seen)
    assert store.insert_absent("fact_order", new, batch=batch) == {"inserted": 10}
    assert not copies and shuffles == [1]
    noted = store._table("loads").where("load = 2").orderBy("month").collect()
    assert [(r.month, r.n_rows) for r in noted] == [(date(2024, 5, 1), 10)]
    assert store.upsert("fact_order", new.withColumn("order_code", F.concat("order_code", F.lit("x"))),
                        ["order_quantity"], {**batch, "most": "2201-909x"}) == {"inserted": 20, "updated": 0}
    assert not copies and store.read("fact_order").count() == 930


def test_landed_files_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    from tallymill import registry
    from tallymill.sources.files import Files
    from tallymill.sources.sample import SampleWarehouse

    spark.range(4000).selectExpr(
        "id div 4 AS l_orderkey", "id % 90 AS l_partkey", "id % 12 AS l_suppkey", "int(id % 4) AS l_linenumber",
        "double(id % 50) AS l_quantity", "'N' AS l_returnflag", "'O' AS l_linestatus",
        "timestamp_ntz '1997-05-01 00:00:00' AS l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    w = SampleWarehouse(spark, str(tmp_path))
    monkeypatch.setattr(registry, "LANDED_BYTES", w.size("lineitem") // 3 + 1)
    landing = registry._Landing(Files(spark, str(tmp_path)), w, "lineitem", str(tmp_path / "landed"), part=1)
    landing.land(F.lit(True), SALES_EXTRACT.names, "lines")
    files = sorted((tmp_path / "landed").rglob("*.csv"))
    assert [f"{f.parent.name}/{f.name}" for f in files] == [f"{i}/lines-0.csv" for i in range(3)]
    lines = [list(csv.DictReader(f.open())) for f in files]
    assert sum(map(len, lines)) == 4000 and max(map(len, lines)) < 2000
    orders = [{r["order_code"] for r in rows} for rows in lines]
    assert sum(map(len, orders)) == len(set.union(*orders)) == 1000
    assert {(r.file, r.reject_reason) for r in registry._refusals(spark, str(tmp_path)).collect()} == {
        ("empty.csv", "empty_file"), ("notes-0.txt", "wrong_suffix"), ("short-0.csv", "column_count"),
        ("rows read", "4000")}


def test_copies_of_an_order_lie_in_one_extract(spark, tmp_path):
    """The last of an order's rows counts, whichever file was written first."""
    from tallymill import registry

    spark.range(3000).selectExpr(
        "id AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus", "5000.0D AS o_totalprice",
        "timestamp_ntz '1998-05-01 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority").write.parquet(
        str(tmp_path / "orders.parquet"))
    spark.range(10).selectExpr("id AS s_suppkey", "'s' AS s_name", "1 AS s_nationkey").write.parquet(
        str(tmp_path / "supplier.parquet"))
    store = registry._order_run(spark, str(tmp_path))[0]
    assert [r[0] for r in store.read("fact_order").select("order_quantity").distinct().collect()] == [14.0]


def test_cleaning_of_orders_fits_compiled_methods(spark, tmp_path):
    """Java leaves methods of more than 8,000 bytes uncompiled."""
    import re

    from tallymill import registry
    from tallymill.sources.sample import SAMPLE_SCHEMAS, SampleWarehouse

    row = (6, 3, "O", 5000.0, datetime(1998, 5, 1), "1-URGENT")
    spark.createDataFrame([row], SAMPLE_SCHEMAS["orders"]).write.parquet(str(tmp_path / "orders.parquet"))
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    for upload in (0, 1, 2):
        cleaned = registry._clean_orders(SampleWarehouse(spark, str(tmp_path)), upload)
        code = debug.codegenString(cleaned._jdf.queryExecution().executedPlan())
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
        assert sizes and max(sizes) < 8000


def test_incremental_read_cleans_each_upload_once(spark, tmp_path, monkeypatch):
    from tallymill import registry
    from tallymill.sources.sample import SAMPLE_SCHEMAS

    rows = [(k, 3, "O", 5000.0, datetime(year, 5, 1), "1-URGENT") for k, year in ((1, 1997), (2, 1998), (3, 1999))]
    spark.createDataFrame(rows, SAMPLE_SCHEMAS["orders"]).write.parquet(str(tmp_path / "orders.parquet"))
    uploads, clean = [], registry._clean_orders
    monkeypatch.setattr(registry, "_clean_orders", lambda w, upload=0: uploads.append(upload) or clean(w, upload))
    found = registry.load_queries()["staging_incremental_read"](spark, str(tmp_path))
    assert column(found, "order_code") == ["2201-2-0001", "2201-3-0001"]
    assert sorted(uploads) == [1, 2]


def test_sales_of_one_file_are_not_grouped_again(spark, tmp_path):
    write_sales(tmp_path / "1.csv", {"sales_quantity": "1"}, {"sales_quantity": "2"})
    write_sales(tmp_path / "2.csv", {"sales_quantity": "3"})
    one, two = (durable(staging.clean_sales(read_sales_extract(spark, str(path)).rows, T1))
                for path in (tmp_path / "1.csv", tmp_path))
    assert two.select("source_file").distinct().count() == 2
    plan = staging.staged_sales(one)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert column(staging.staged_sales(one), "sales_quantity") == ["1.0", "2.0"]
    assert staging.staged_sales(two).columns == staging.staged_sales(one).columns
    assert staging.staged_sales(two).count() == 2


def test_compressed_extracts_are_read(spark, tmp_path):
    import gzip

    folder = tmp_path / "landed"
    folder.mkdir()
    whole = Path(write_sales(tmp_path / "raw.txt", {"sales_code": "2301-1"}, {"sales_code": "2301-2"})).read_bytes()
    short = b"\n".join(x.rsplit(b",", 1)[0] for x in whole.splitlines()) + b"\n"
    for name, content in (("a.csv.gz", whole), ("B.CSV.gz", whole), ("short.csv.gz", short), ("c.parquet.gz", whole),
                          ("notes.txt.gz", whole), ("other.gz", whole), ("LOUD.csv.GZ", whole)):
        (folder / name).write_bytes(gzip.compress(content))
    write_sales(folder / "plain.csv", {"sales_code": "2301-3"})
    (folder / "empty.csv.gz").write_bytes(b"")
    refused = {"short.csv.gz": "column_count", "c.parquet.gz": "wrong_suffix", "notes.txt.gz": "wrong_suffix",
               "other.gz": "wrong_suffix", "LOUD.csv.GZ": "wrong_suffix", "empty.csv.gz": "empty_file"}
    landed = read_sales_extract(spark, str(folder))
    assert landed.rows.count() == 5 and landed.rows.select("source_file").distinct().count() == 3
    assert {r.path.rsplit("/", 1)[1]: r.reject_reason for r in landed.refused.collect()} == refused
    store = Store(spark, str(tmp_path / "warehouse"))
    load_landed_sales(store, str(folder), str(tmp_path / "progress")).awaitTermination()
    assert column(store.read("fact_sales"), "sales_code") == ["2301-1-0001", "2301-2-0001", "2301-3-0001"]
    found = {r.path.rsplit("/", 1)[1]: r.reject_reason for r in store.read("landing_rejects").collect()}
    assert found == refused


def test_landed_rows_are_not_shuffled_by_file(spark, tmp_path):
    """Files are few, so a shuffle by them leaves most tasks without rows. Their number shows once they are written."""
    for i in range(3):
        write_sales(tmp_path / f"{i}.csv", *[{"sales_code": f"2301-{k}"} for k in range(200)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "6000")
    try:
        landed = read_sales_extract(spark, str(tmp_path))
        plan = landed.rows._jdf.queryExecution().executedPlan().toString()
        assert landed.rows.count() == 600
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") <= 1


def test_loads_pack_what_they_write(spark, tmp_path):
    store = Store(spark, str(tmp_path / "warehouse"))
    landed = read_sales_extract(spark, write_sales(tmp_path / "1.csv", {}))
    load_sales_files(store, landed, T1)
    files = [*landed.rows.inputFiles(), *store.read("sales_staging").inputFiles(), *store.read("fact_sales").inputFiles()]
    assert files
    for name in files:
        part = pq.ParquetFile(name.removeprefix("file://")).metadata.row_group(0).column(0)
        assert part.compression == "ZSTD", name


def test_staged_sales_become_facts_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Staged rows lie in the buckets of the facts, unless a code loses a `.0` on the way."""
    plans, write = [], Store._write

    def seen(self, table, rows, overwrite=False):
        if table == "fact_sales":
            plans.append(rows.repartition(self.buckets, "sales_code")._jdf.queryExecution().executedPlan().toString())
        write(self, table, rows, overwrite)

    monkeypatch.setattr(Store, "_write", seen)
    store = Store(spark, str(tmp_path / "warehouse"))
    rows = [{"sales_code": f"2301-{k}", "sales_date": f"1/{k % 3 + 1}/2024"} for k in range(30)]
    first = read_sales_extract(spark, write_sales(tmp_path / "1.csv", *rows)).rows
    assert load_sales(store, first, T1).first().fact_inserted == 30
    again = read_sales_extract(spark, write_sales(tmp_path / "2.csv", *rows, {"sales_code": "2301-77..00"})).rows
    told = load_sales(store, again, T2).first()
    assert (told.staging_inserted, told.staging_skipped, told.fact_inserted, told.fact_updated) == (1, 30, 1, 0)
    assert "Exchange" not in plans[0] and "Exchange hashpartitioning" in plans[1]
    assert {"2301-29-0001", "2301-77-0001"} <= set(column(store.read("fact_sales"), "sales_code"))
    assert store.read("fact_sales").count() == 31 and store.read("fact_sales").where("sales_code LIKE '%.%'").count() == 0
