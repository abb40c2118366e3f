"""Registered queries: every operator applied to the sample warehouse."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.params import DateRange
from tallymill.operators.upsert import INSERTED, KEPT, insert_absent, upsert
from tallymill.operators.ordinals import place_in_order
from tallymill.operators.paging import page, page_after, row_count
from tallymill.plans import (
    dimension_changes, dimension_lists, dimension_refresh, extracts, facts, materials, monthly, product_mix, product_pivot,
    range_diff, staging, totals,
)
from tallymill.plans.loads import STATS, load_order_files, load_sales_files
from tallymill.schemas import ORDER_EXTRACT, SALES_EXTRACT
from tallymill.session import durable, shared_folder
from tallymill.sources.files import Files
from tallymill.sources.landing import COMPRESSED, read_order_extract, read_sales_extract, uncompressed
from tallymill.sources.sample import SampleWarehouse
from tallymill.sources.tables import BUCKETS, Store, padded
from tallymill.streaming.landing import load_landed_orders, load_landed_sales

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Params:
    """Parameters that the queries and their oracle texts share."""

    year: int = 1997
    overall_target: tuple[int, int] = (1996, 5)
    main: DateRange = DateRange.of("1997-03-01", "1997-03-20")
    target: DateRange = DateRange.of("1997-02-01", "1997-02-20")
    threshold: int = 10
    excluded: list[str] = field(default_factory=lambda: ["7", "3"])
    one_factory: str = "5"
    some_factories: list[str] = field(default_factory=lambda: ["1", "2", "5", "9", "12"])
    thinner: list[str] = field(default_factory=lambda: ["ECONOMY", "LARGE"])
    paint: list[str] = field(default_factory=lambda: ["MEDIUM", "PROMO", "SMALL", "STANDARD"])
    pivot_days: tuple[int, int] = (1, 20)
    pivot_months: tuple[int, ...] = (1, 2, 3)
    pivot_years: tuple[int, ...] = (1996, 1997)
    selected: tuple[int, int] = (1997, 3)


PARAMS = Params()


def _on_sample(build: Callable[[SampleWarehouse], DataFrame]) -> Query:
    return lambda spark, folder: build(SampleWarehouse(spark, folder))


def _overall(w: SampleWarehouse, **window: tuple[int, int]) -> DataFrame:
    p = PARAMS
    return totals.overall(w.fact_sales, w.fact_order, w.dim_date, year=p.year,
                          target_year=p.overall_target[0], target_month=p.overall_target[1],
                          exclude_factory=p.excluded, **window)


def _nested(w: SampleWarehouse) -> DataFrame:
    """The array rendered as text, since nested values have no common text form."""
    p = PARAMS
    nested = totals.overall_nested(
        w.fact_sales, w.fact_order, w.dim_factory, w.dim_date, year=p.year,
        target_year=p.overall_target[0], target_month=p.overall_target[1],
        exclude_factory=p.excluded)
    entry = F.transform("factory_breakdown", lambda e: F.concat_ws(
        "|", e.factory_code, F.coalesce(e.factory_name, F.lit("")),
        e.sales_quantity.cast("bigint").cast("string"),
        e.order_quantity.cast("bigint").cast("string")))
    return nested.select("month", F.array_join(entry, ";").alias("factory_breakdown"),
                         "exclude_factory_sales_quantity")


def _factory_diff(kind: str, increase: bool) -> Query:
    p = PARAMS

    def build(w: SampleWarehouse) -> DataFrame:
        common = (w.dim_factory, w.dim_date, p.main, p.target, p.threshold, increase)
        if kind == "sales":
            return range_diff.factory_sales_range_diff(w.fact_sales, w.fact_order, *common)
        return range_diff.factory_order_range_diff(w.fact_order, *common)

    return _on_sample(build)


def _mix_sales(w: SampleWarehouse) -> DataFrame:
    return product_mix.thinner_paint_sales(w.fact_sales, w.dim_factory, w.dim_product, w.dim_date,
                                           PARAMS.year, PARAMS.thinner, PARAMS.paint)


def _mix_pivot(name: str) -> Query:
    return _on_sample(lambda w: getattr(product_mix.thinner_paint_pivots(
        _mix_sales(w), PARAMS.thinner, PARAMS.paint, range(1, 13)), name))


def _product_pivot(factory: list[str] | None, increase: bool) -> Query:
    p = PARAMS
    labels = [f"{y}-{m:02d}" for y in p.pivot_years for m in p.pivot_months]
    return _on_sample(lambda w: product_pivot.pivot_product_order(
        w.fact_sales, w.fact_order, w.dim_factory, w.dim_date, days=p.pivot_days,
        months=p.pivot_months, years=p.pivot_years, selected_year=p.selected[0],
        selected_month=p.selected[1], factory=factory, increase=increase, columns=labels))


def _ranked(build: Callable[[SampleWarehouse], DataFrame]) -> Query:
    """A report with the place of each row in its order."""
    return _on_sample(lambda w: place_in_order(build(w), "place").withColumn("place", F.col("place").cast("int")))


def report_queries() -> dict[str, Query]:
    p = PARAMS
    years = [1996, 1997]

    def overtime(fields: str, **only: str) -> Query:
        return _on_sample(lambda w: monthly.sales_overtime(
            w.fact_sales, w.dim_factory, w.dim_date, years, fields, **only))

    def bom(kind: str, group_by: str | None = None, factory: list[str] | None = None) -> Query:
        build = {"sales": materials.sales_bom, "order": materials.order_bom}[kind]
        return _on_sample(lambda w: build(
            getattr(w, f"fact_{kind}"), w.dim_factory, w.bridge_product_material, p.main, factory,
            group_by))

    def product_diff(kind: str, factory: list[str] | None = None) -> Query:
        build = {"sales": range_diff.product_sales_range_diff,
                 "order": range_diff.product_order_range_diff}[kind]
        return _on_sample(lambda w: build(getattr(w, f"fact_{kind}"), p.main, p.target, factory))

    return {
        "max_sales_date": _on_sample(lambda w: totals.max_sales_date(w.fact_sales)),
        "overall": _on_sample(_overall),
        "overall_day_window": _on_sample(lambda w: _overall(w, days=(10, 31), months=(2, 7))),
        "overall_breakdown": _on_sample(lambda w: totals.overall_breakdown(
            w.fact_sales, w.fact_order, w.dim_factory, w.dim_date, year=p.year,
            exclude_factory=p.excluded)),
        "overall_nested": _on_sample(_nested),
        "factory_sales_range_diff_rising": _factory_diff("sales", True),
        "factory_sales_range_diff_order": _ranked(lambda w: range_diff.factory_sales_range_diff(
            w.fact_sales, w.fact_order, w.dim_factory, w.dim_date, p.main, p.target, p.threshold,
            False).select("factory_code", "quantity_diff")),
        "overall_breakdown_order": _ranked(lambda w: totals.overall_breakdown(
            w.fact_sales, w.fact_order, w.dim_factory, w.dim_date, year=p.year,
            exclude_factory=p.excluded).select("month", "factory_code")),
        "thinner_pivot_order": _ranked(lambda w: product_mix.thinner_paint_pivots(
            _mix_sales(w), p.thinner, p.paint, range(1, 13)).thinner.select("factory_code")),
        "factory_sales_range_diff_falling": _factory_diff("sales", False),
        "factory_order_range_diff_rising": _factory_diff("order", True),
        "factory_order_range_diff_falling": _factory_diff("order", False),
        "product_sales_range_diff": product_diff("sales"),
        "product_sales_range_diff_factories": product_diff("sales", p.some_factories),
        "product_order_range_diff": product_diff("order"),
        "product_order_range_diff_factories": product_diff("order", p.some_factories),
        "scheduled_and_actual_sales": _on_sample(lambda w: monthly.scheduled_and_actual_sales(
            w.fact_sales, w.fact_order, w.dim_date, p.year)),
        "scheduled_and_actual_sales_factory": _on_sample(
            lambda w: monthly.scheduled_and_actual_sales(
                w.fact_sales, w.fact_order, w.dim_date, p.year, p.one_factory)),
        "sales_overtime_month": overtime("month"),
        "sales_overtime_calendar": overtime("year,quarter,week_of_year,day_of_week"),
        "sales_overtime_factory_days": overtime("date,day", factory=p.one_factory),
        "same_month_sales": _on_sample(lambda w: monthly.same_month_sales(
            w.fact_sales, w.fact_order, w.dim_date, p.main, p.target)),
        "sales_order_pct_diff": _on_sample(lambda w: monthly.sales_order_pct_diff(
            w.fact_sales, w.fact_order, w.dim_date, p.main, p.target, p.excluded[0])),
        "thinner_paint_summary": _on_sample(lambda w: product_mix.thinner_paint_summary(
            _mix_sales(w), p.thinner, p.paint)),
        "thinner_paint_detail": _on_sample(
            lambda w: product_mix.thinner_paint_detail(_mix_sales(w))),
        "thinner_pivot": _mix_pivot("thinner"),
        "paint_pivot": _mix_pivot("paint"),
        "ratio_pivot": _mix_pivot("ratio"),
        "thinner_detail_pivot": _mix_pivot("thinner_detail"),
        "paint_detail_pivot": _mix_pivot("paint_detail"),
        "fact_order_extract": _on_sample(lambda w: _times_as_text(extracts.fact_order_extract(
            w.fact_order, w.dim_factory, p.main))),
        "fact_sales_extract": _on_sample(lambda w: _times_as_text(extracts.fact_sales_extract(
            w.fact_sales, w.dim_factory, p.main))),
        "sales_bom": bom("sales"),
        "sales_bom_by_product": bom("sales", "product_name"),
        "sales_bom_by_factory": bom("sales", "factory_code,factory_name", p.some_factories),
        "order_bom": bom("order"),
        "order_bom_by_product_factory": bom("order", "product_name,material_name,factory_code"),
        "pivot_product_order": _product_pivot(None, True),
        "pivot_product_order_factories": _product_pivot(p.some_factories, False),
    }


FIRST, SECOND = datetime(2024, 1, 1, 6, 30), datetime(2024, 2, 1, 6, 30)

# Columns that the sample extracts fill; the others are null on this path.
_ORDER_SHOWN = ["order_date", "order_code", "factory_code", "factory_order_code", "product_code",
                "product_name", "qc", "warehouse_type", "order_quantity", "delivered_quantity",
                "estimated_delivery_date"]
_SALES_SHOWN = ["sales_date", "sales_code", "factory_code", "factory_order_code", "product_code",
                "product_name", "qc", "warehouse_code", "order_code", "sales_quantity"]


def _staged_orders(w: SampleWarehouse, upload: int = 0) -> DataFrame:
    return staging.staged_orders(durable(_clean_orders(w, upload)))


def _staged_sales(w: SampleWarehouse, upload: int = 0) -> DataFrame:
    return staging.staged_sales(durable(_clean_sales(w, upload)))


def _clean_orders(w: SampleWarehouse, upload: int = 0) -> DataFrame:
    return staging.clean_orders(w.order_extract(upload), SECOND if upload == 2 else FIRST)


def _clean_sales(w: SampleWarehouse, upload: int = 0) -> DataFrame:
    return staging.clean_sales(w.sales_extract(upload), SECOND if upload == 2 else FIRST)


def _time_text(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _times_as_text(df: DataFrame) -> DataFrame:
    return df.select(*[_time_text(name) if kind == "timestamp" else name for name, kind in df.dtypes])


def _whole(table: str, rows: DataFrame) -> DataFrame:
    """All columns as the table stores them."""
    return _times_as_text(padded(table, rows))


def _order_staging(w: SampleWarehouse, first: DataFrame | None = None) -> DataFrame:
    """Staging after both uploads, each row with its change in the second one.

    `first` is staging after the first upload, where that is at hand."""
    first, second = first or _staged_orders(w, 1), _staged_orders(w, 2)
    return upsert(first, second, "order_code", staging.ORDER_UPDATES)


def _sales_staging(w: SampleWarehouse) -> DataFrame:
    first, second = (_staged_sales(w, u) for u in (1, 2))
    added = insert_absent(first, second, "sales_code")
    return first.withColumn("change", F.lit(KEPT)).unionByName(
        added.withColumn("change", F.lit(INSERTED)))


def _accepted(labelled: DataFrame) -> DataFrame:
    return staging.accepted(labelled)


def _order_facts(w: SampleWarehouse, upload: int) -> DataFrame:
    rows = _staged_orders(w, upload)
    return facts.order_facts(rows, SECOND if upload == 2 else FIRST)


def _sales_facts(w: SampleWarehouse, upload: int) -> DataFrame:
    rows = _staged_sales(w, upload)
    return facts.sales_facts(rows, SECOND if upload == 2 else FIRST)


def _order_reload(w: SampleWarehouse) -> DataFrame:
    first, second = (_accepted(_order_facts(w, u)) for u in (1, 2))
    return upsert(first, second, "order_code", facts.ORDER_UPDATES).select(
        *_ORDER_SHOWN, "change", _time_text("import_timestamp"), _time_text("import_wh_timestamp"))


def _sales_reload(w: SampleWarehouse) -> DataFrame:
    first, second = (_accepted(_sales_facts(w, u)) for u in (1, 2))
    return upsert(first, second, "sales_code", facts.SALES_UPDATES).select(
        *_SALES_SHOWN, "change", _time_text("import_timestamp"), _time_text("import_wh_timestamp"))


def _incremental(w: SampleWarehouse) -> DataFrame:
    """Staging rows newer than what the fact of the first upload holds."""
    first = _staged_orders(w, 1)
    fact = _accepted(facts.order_facts(first, FIRST))
    rows = staging.staged_since(_order_staging(w, first), staging.watermark(fact))
    return rows.select(*_ORDER_SHOWN, _time_text("import_timestamp"))


# --- Whole loads through files and stored tables ---


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"


_CSV_OUT = {"header": True, "quote": '"', "escape": '"', "emptyValue": ""}
# Extracts land compressed.
_PACKED_OUT = {**_CSV_OUT, "compression": "gzip"}


# Bytes of a table for which there is a bucket of a store, and at most so many of which land in one file.
BUCKET_BYTES, LANDED_BYTES = 32 << 20, 128 << 20


def _store(w: SampleWarehouse, spark: SparkSession, root: str, table: str) -> Store:
    """A store whose buckets are as many as a table of the sample asks for."""
    return Store(spark, f"{root}/warehouse", max(BUCKETS, math.ceil(w.size(table) / BUCKET_BYTES)))


_SOURCE = ["source_chunk", "source_row"]


def _order_run(spark: SparkSession, folder: str) -> tuple[Store, list[DataFrame]]:
    """Both order uploads, written as files whose names sort in source order, and loaded one after the other."""
    w, root = SampleWarehouse(spark, folder), _scratch(spark)
    store = _store(w, spark, root, "orders")
    store.append("dim_factory", w.dim_factory)
    stats = []
    for upload, now in ((1, FIRST), (2, SECOND)):
        landed = f"{root}/orders-{upload}"
        extract = w.order_extract(upload, lambda orders: orders.repartitionByRange("o_orderkey"))
        extract.sortWithinPartitions(*_SOURCE).select(*ORDER_EXTRACT.names).write.options(**_PACKED_OUT).csv(landed)
        stats.append(load_order_files(store, read_order_extract(spark, landed), now))
    return store, stats


def _sales_run(spark: SparkSession, folder: str) -> tuple[Store, list[DataFrame]]:
    w, root = SampleWarehouse(spark, folder), _scratch(spark)
    store, stats = _store(w, spark, root, "lineitem"), []
    for upload, now in ((1, FIRST), (2, SECOND)):
        landed = f"{root}/sales-{upload}"
        # One extract per file: each order lies in one file as a whole.
        extract = w.sales_extract(upload, lambda lines: lines.repartition("l_orderkey"))
        extract.sortWithinPartitions(*_SOURCE).select(*SALES_EXTRACT.names).write.options(
            **_PACKED_OUT).csv(landed)
        stats.append(load_sales_files(store, read_sales_extract(spark, landed), now))
    return store, stats


class _Landing:
    """Extracts of a table that land as files, each order in one file.

    Files are moved to folders `0`, `1`, ... below `folder`; there are as many folders as the table's
    size asks for, so that no file, which one task writes, grows with it. A file holds the
    `part`-th part of a folder's rows at most.
    """

    def __init__(self, files: Files, w: SampleWarehouse, table: str, folder: str, part: int = 4) -> None:
        self.files, self.w, self.table, self.folder = files, w, table, folder
        self.folders = max(1, math.ceil(w.size(table) / (part * LANDED_BYTES)))
        self.paths = f"{folder}/*"

    def land(self, where: Column, columns: list[str], name: str, suffix: str = "csv", parts: int = 1,
             change: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """Write some rows of the extract as `parts` files `<name>-<n>.<suffix>` in each folder, which land now.

        They are compressed if the suffix says so."""
        key, make = {"lineitem": ("l_orderkey", self.w.sales_extract),
                     "orders": ("o_orderkey", self.w.order_extract)}[self.table]
        number, aside = parts * self.folders, f"{self.folder}-aside/{uuid.uuid4().hex}"
        extract = change(make(0, lambda rows: rows.repartition(number, key)).filter(where))
        extract.sortWithinPartitions(*_SOURCE).select(*columns).write.options(
            **(_PACKED_OUT if suffix.endswith(COMPRESSED) else _CSV_OUT)).csv(aside)
        for i, part in enumerate(sorted(n for n in self.files.names(aside) if n.startswith("part-"))):
            self.files.move(f"{aside}/{part}", f"{self.folder}/{i // parts}/{name}-{i % parts}.{suffix}")


def _land_all(landing: _Landing, schema: T.StructType, code: str, quantity: str) -> None:
    """An extract in several files, and then: a file with an upper-case suffix, a file that lands
    again, a file that lacks its last column, and a correction whose name sorts before all."""
    columns, share = schema.names, F.pmod(F.xxhash64(F.coalesce(code, F.lit(""))), F.lit(4))
    landing.land(share < 3, columns, "base", "csv.gz", parts=3)
    landing.land(share == 3, columns, "MORE", "CSV.gz")
    landing.land(share == 1, columns, "repeat", "csv.gz")
    landing.land(share == 2, columns[:-1], "short", "csv.gz")
    more = F.coalesce((F.col(quantity).try_cast("double") + 5).cast("string"), F.col(quantity))
    landing.land(F.col(code).endswith("0"), columns, "0-corrected", "csv.gz", change=lambda rows: rows.withColumn(quantity, more))


def _name_of(path: str) -> Column:
    """A file's name, whether it landed compressed or not."""
    return uncompressed(F.element_at(F.split(path, "/"), -1))


def _refusals(spark: SparkSession, folder: str) -> DataFrame:
    """A batch load of folders that also hold an empty file, files with another suffix, files with a
    suffix in capitals and files that lack a column: what is refused, by name, and how many rows are read."""
    w, root = SampleWarehouse(spark, folder), _scratch(spark)
    files, columns = Files(spark, root), SALES_EXTRACT.names
    landing = _Landing(files, w, "lineitem", f"{root}/landed", part=1)
    share = F.pmod(F.xxhash64(F.coalesce("sales_code", F.lit(""))), F.lit(4))
    for name, suffix, rows, cells in (
            ("base", "csv.gz", share < 2, columns), ("MORE", "CSV.gz", share >= 2, columns),
            ("notes", "txt.gz", F.lit(True), columns), ("short", "csv.gz", F.lit(True), columns[:-1])):
        landing.land(rows, cells, name, suffix)
    spark.range(0).select(F.lit("").alias("value")).coalesce(1).write.text(f"{root}/nothing")
    files.move(next(f"{root}/nothing/{n}" for n in files.names(f"{root}/nothing") if n.startswith("part-")),
               f"{root}/landed/0/empty.csv")
    landed = read_sales_extract(spark, landing.paths)
    refused = landed.refused.select(_name_of("path").alias("file"), "reject_reason").distinct()
    return refused.union(landed.rows.agg(F.lit("rows read"), F.count(F.lit(1)).cast("string")))


def _landed(max_files: int) -> Query:
    """Sales and orders that landed as files, taken by the stream `max_files` at a time."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        w, root = SampleWarehouse(spark, folder), _scratch(spark)
        files, store = Files(spark, root), _store(w, spark, root, "lineitem")
        sales, orders = (_Landing(files, w, table, f"{root}/{name}") for table, name in (
            ("lineitem", "sales"), ("orders", "orders")))
        _land_all(sales, SALES_EXTRACT, "sales_code", "sales_quantity")
        _land_all(orders, ORDER_EXTRACT, "order_code", "order_quantity")
        for start, landing, name in ((load_landed_sales, sales, "sales"), (load_landed_orders, orders, "orders")):
            query = start(store, landing.paths, f"{root}/progress-{name}", max_files=max_files)
            query.awaitTermination()
        # Each name once for an extract, in however many folders it landed.
        names = store.read("landing_rejects").select(
            F.element_at(F.split("path", "/"), -3), _name_of("path").alias("name"), "reject_reason").distinct()
        refused = names.select(
            F.lit("refused").alias("kind"), F.concat_ws(" ", "name", "reject_reason").alias("code"),
            F.lit(None).cast("double").alias("quantity"), F.lit(None).cast("date").alias("day"))
        sales = store.read("fact_sales").select(
            F.lit("sales"), "sales_code", "sales_quantity", "sales_date")
        orders = store.read("fact_order").select(
            F.lit("order"), "order_code", "order_quantity", "order_date")
        return refused.union(sales).union(orders)

    return run


def _sales_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The whole sales extract, landed as files and loaded by the stream."""
    w, root = SampleWarehouse(spark, folder), _scratch(spark)
    landing = _Landing(Files(spark, root), w, "lineitem", f"{root}/landed")
    landing.land(F.lit(True), SALES_EXTRACT.names, "lines", "csv.gz", parts=4)
    store = _store(w, spark, root, "lineitem")
    query = load_landed_sales(store, landing.paths, f"{root}/progress")
    query.awaitTermination()
    return store.read("fact_sales").select(*_SALES_SHOWN)


def _summed(stats: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, stats).agg(*[F.sum(c).alias(c) for c in STATS])


def run_queries() -> dict[str, Query]:
    def stored(df: DataFrame, columns: list[str], *times: str) -> DataFrame:
        return df.select(*columns, *map(_time_text, times))

    return {
        "order_load": lambda s, f: stored(_order_run(s, f)[0].read("fact_order"), _ORDER_SHOWN,
                                          "import_timestamp", "import_wh_timestamp"),
        "order_load_dimensions": lambda s, f: _order_run(s, f)[0].read("dim_factory"),
        "order_load_counts": lambda s, f: _summed(_order_run(s, f)[1]),
        "sales_load": lambda s, f: stored(_sales_run(s, f)[0].read("fact_sales"), _SALES_SHOWN,
                                          "import_timestamp"),
        "sales_load_counts": lambda s, f: _summed(_sales_run(s, f)[1]),
        "landing_refusals": _refusals,
        "landed_sales_stream": _sales_stream,
        "landed_files_one_trigger": _landed(max_files=1_000),
        "landed_files_many_triggers": _landed(max_files=3),
    }


def load_queries() -> dict[str, Query]:
    def shown(build: Callable[[SampleWarehouse], DataFrame], *columns: str) -> Query:
        return _on_sample(lambda w: build(w).select(*columns))

    def rejects(build: Callable[[SampleWarehouse, int], DataFrame], code: str) -> Query:
        return _on_sample(lambda w: staging.rejected(build(w, 0)).select(code, "reject_reason"))

    order_staged = [*_ORDER_SHOWN, "factory_name", "note", "numerical_order", "path"]
    sales_staged = [*_SALES_SHOWN, "factory_name", "salesman"]
    return {
        "order_extract_clean": _on_sample(lambda w: _whole(
            "order_staging", staging.accepted(_clean_orders(w)))),
        "order_extract_rejects": rejects(_clean_orders, "order_code"),
        "sales_extract_clean": shown(lambda w: staging.accepted(_clean_sales(w)), *sales_staged),
        "order_staging_reupload": _on_sample(lambda w: _order_staging(w).select(
            *order_staged, "change", _time_text("import_timestamp"))),
        "sales_staging_reupload": _on_sample(lambda w: _sales_staging(w).select(
            *sales_staged, "change", _time_text("import_timestamp"))),
        "staging_incremental_read": _on_sample(_incremental),
        "order_fact_load": _on_sample(lambda w: _whole("fact_order", _accepted(_order_facts(w, 0)))),
        "order_fact_rejects": rejects(_order_facts, "order_code"),
        "sales_fact_load": _on_sample(lambda w: _whole("fact_sales", _accepted(_sales_facts(w, 0)))),
        "sales_fact_rejects": rejects(_sales_facts, "sales_code"),
        "order_fact_reload": _on_sample(_order_reload),
        "sales_fact_reload": _on_sample(_sales_reload),
        "dim_factory_refresh": _on_sample(lambda w: dimension_refresh.new_factories(
            padded("order_staging", _staged_orders(w)), w.dim_factory)),
        "dim_product_refresh": shown(
            lambda w: dimension_refresh.new_products(
                _staged_orders(w), w.dim_product),
            "product_name", "product_type", "qc"),
    }


def dimension_queries() -> dict[str, Query]:
    lists, changes = dimension_lists, dimension_changes
    made = datetime(2024, 3, 1)

    def both(name: str, build: Callable[[SampleWarehouse], changes.Change],
             *hidden: str) -> dict[str, Query]:
        return {name: _on_sample(lambda w: build(w).table.drop(*hidden)),
                f"{name}_outcomes": _on_sample(lambda w: build(w).outcomes)}

    return {
        "factory_list": _on_sample(lambda w: lists.list_factories(w.dim_factory, True, None, "_1")),
        "factory_list_page": _on_sample(lambda w: page(
            lists.list_factories(w.dim_factory, None, False), ["factory_code"], 2, 7)),
        "product_list": _on_sample(lambda w: lists.list_products(
            w.dim_product, "ECONOMY, PROMO", "RING")),
        "product_list_page": _on_sample(lambda w: page(
            lists.list_products(w.dim_product, ["LARGE"]), ["id"], 3)),
        "product_list_count": _on_sample(lambda w: row_count(lists.list_products(
            w.dim_product, None, "bolt"))),
        "material_list": _on_sample(lambda w: lists.list_materials(w.dim_material, "AL-1")),
        "retailer_list": _on_sample(lambda w: lists.list_retailers(w.dim_retailer, "00%7")),
        "retailer_list_page": _on_sample(lambda w: page(w.dim_retailer, ["name"], 2, 100)),
        "formula_list_after": _on_sample(lambda w: page_after(
            lists.list_formulas(w.bridge_product_material, is_current=None),
            {"material_name": "material-17", "product_name": "m", "version_number": 1}, 40)),
        "formula_list": _on_sample(lambda w: lists.list_formulas(
            w.bridge_product_material, None, "material-3,material-17")),
        "formula_list_page": _on_sample(lambda w: page(
            lists.list_formulas(w.bridge_product_material, is_current=None),
            ["product_name", "material_name", "version_number"], 4)),
        "blueprint_list": _on_sample(lambda w: lists.list_blueprints(w.blueprint, "42").drop(
            "created_at", "updated_at")),
        "blueprint_list_all": _on_sample(lambda w: lists.list_blueprints(w.blueprint).select(
            "id", "factory", "type", "file_url")),
        "factory_lookup": _on_sample(lambda w: lists.look_up(
            w.factory_requests().select("factory_code").distinct(), w.dim_factory, "factory_code")),
        "blueprint_lookup": _on_sample(lambda w: lists.look_up_blueprints(
            w.blueprint_patches().select("id").distinct(), w.blueprint).select(
            "id", "name", "type", "file_size", "file_url", "found")),
        **both("factory_insert", lambda w: changes.insert_factories(
            w.dim_factory, w.factory_requests())),
        **both("factory_patch", lambda w: changes.patch_factories(
            w.dim_factory, w.factory_patches())),
        **both("retailer_insert", lambda w: changes.insert_retailers(
            w.dim_retailer, w.retailer_requests(), "batch-1")),
        **both("retailer_rename", lambda w: changes.rename_retailers(
            w.dim_retailer, w.retailer_renames())),
        **both("retailer_delete", lambda w: changes.delete_rows(
            w.dim_retailer, w.retailer_deletes(), "id")),
        **both("blueprint_patch", lambda w: changes.patch_blueprints(
            w.blueprint, w.blueprint_patches()), "created_at", "updated_at"),
        **both("blueprint_insert", lambda w: changes.insert_blueprints(
            w.blueprint, w.dim_factory, w.blueprint_requests(), made, "batch-1",
            max_bytes=100 * 1024 * 1024),
            "created_at", "updated_at"),
    }


def all_queries() -> dict[str, Query]:
    return {**report_queries(), **load_queries(), **dimension_queries(), **run_queries()}
