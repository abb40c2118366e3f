"""Warehouse tables derived from a TPC-H-like Parquet folder.

Used by the registered queries, the tests and the benchmark. Counts enter as
scalar subqueries and the bill of materials as an exploded constant array, so that
no table is joined without a key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.params import DateRange
from tallymill.plans.calendars import calendar_days

# Columns of the sample files that the mapping uses. Stated, so that no job
# has to read a footer for them.
SAMPLE_SCHEMAS = {
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "customer": "c_custkey bigint, c_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
}

Deal = Callable[[DataFrame], DataFrame]


def _as_they_lie(rows: DataFrame) -> DataFrame:
    return rows


class SampleWarehouse:
    """Lazy warehouse tables over one folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark = spark
        self._folder = folder

    def raw(self, name: str) -> DataFrame:
        path = f"{self._folder}/{name}.parquet"
        return self._spark.read.schema(SAMPLE_SCHEMAS[name]).parquet(path)

    def size(self, name: str) -> int:
        """Bytes of a table's files, from their listing."""
        return int(str(self.raw(name)._jdf.queryExecution().analyzed().stats().sizeInBytes()))

    def _row_count(self, name: str) -> Column:
        return self.raw(name).agg(F.count(F.lit(1))).scalar()

    def _product_names(self) -> DataFrame:
        return self.raw("part").select(
            "p_partkey", "p_brand", "p_size", _product_name().alias("product_name"))

    @cached_property
    def dim_date(self) -> DataFrame:
        return calendar_days(self._spark, DateRange.of("1995-01-01", "2001-12-31"))

    @cached_property
    def dim_factory(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.raw("supplier").select(
            key.cast("string").alias("factory_code"),
            F.col("s_name").alias("factory_name"),
            F.concat(F.lit("Rep "), F.col("s_nationkey").cast("string")).alias("salesman"),
            (key % 4 != 0).alias("is_active"),
            (key % 3 == 0).alias("has_onsite"),
        )

    @cached_property
    def dim_product(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"),
            _product_name().alias("product_name"),
            F.col("p_type").alias("product_type"),
            F.col("p_brand").alias("qc"),
        )

    @cached_property
    def fact_sales(self) -> DataFrame:
        part = self._product_names()
        line = self.raw("lineitem")
        day = F.col("l_shipdate").cast("date")
        return line.join(part, line.l_partkey == part.p_partkey).select(
            F.col("l_orderkey").cast("string").alias("order_code"),
            _known_or_not(F.col("l_suppkey")).alias("factory_code"),
            F.col("l_partkey").cast("string").alias("product_code"),
            "product_name",
            F.col("p_brand").alias("qc"),
            day.alias("sales_date"),
            F.concat_ws("-", F.lit("2301"), "l_orderkey", "l_linenumber").alias("sales_code"),
            F.col("l_quantity").alias("sales_quantity"),
            F.lit("kg").alias("unit"),
            F.floor(F.col("l_quantity") / 4).cast("double").alias("package_sales_quantity"),
            _package(F.col("p_size")).alias("package_unit"),
            F.concat(F.lit("D"), (F.col("l_suppkey") % 7).cast("string")).alias("department"),
            F.concat(F.lit("Rep "), (F.col("l_suppkey") % 25).cast("string")).alias("salesman"),
            F.concat(F.lit("W"), F.col("l_returnflag")).alias("warehouse_code"),
            F.col("l_linestatus").alias("warehouse_type"),
            F.date_add(day, 1).cast("timestamp").alias("import_timestamp"),
        )

    @cached_property
    def fact_order(self) -> DataFrame:
        part = self._product_names()
        orders = self.raw("orders").select(
            "*",
            (F.col("o_orderkey") % self._row_count("part")).alias("part_key"),
            (F.col("o_custkey") % self._row_count("supplier")).alias("supplier_key"),
        )
        order_day = F.col("o_orderdate").cast("date")
        return orders.join(part, orders.part_key == part.p_partkey).select(
            F.col("o_orderkey").cast("string").alias("order_code"),
            _known_or_not(F.col("supplier_key")).alias("factory_code"),
            F.concat(F.lit("F"), (F.col("o_custkey") % 5).cast("string")).alias("factory_order_code"),
            F.col("o_orderpriority").alias("tax_type"),
            F.concat(F.lit("D"), (F.col("o_custkey") % 7).cast("string")).alias("department"),
            F.concat(F.lit("Rep "), (F.col("o_custkey") % 25).cast("string")).alias("salesman"),
            ((F.col("o_orderkey") % 5) * 0.25).cast("double").alias("deposit_rate"),
            F.concat(F.lit("Street "), F.col("o_custkey").cast("string")).alias("delivery_address"),
            F.col("p_partkey").cast("string").alias("product_code"),
            "product_name",
            F.col("p_brand").alias("qc"),
            F.col("o_orderstatus").alias("warehouse_type"),
            order_day.alias("order_date"),
            F.date_add(order_day, (F.col("o_orderkey") % 60 + 30).cast("int"))
            .alias("estimated_delivery_date"),
            F.date_add(order_day, 30).alias("original_estimated_delivery_date"),
            F.floor(F.col("o_totalprice") / 1000).cast("double").alias("order_quantity"),
            F.floor(F.col("o_totalprice") / 2000).cast("double").alias("delivered_quantity"),
            F.lit("kg").alias("unit"),
            _package(F.col("p_size")).alias("package_unit"),
            F.date_add(order_day, 1).cast("timestamp").alias("import_timestamp"),
            F.date_add(order_day, 2).cast("timestamp").alias("import_wh_timestamp"),
        )

    @cached_property
    def bridge_product_material(self) -> DataFrame:
        lines = F.array(*[
            F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k in range(3) for v in (1, 2)
        ])
        k, v = F.col("line.k"), F.col("line.v")
        effective = F.when(v == 1, F.lit("1995-01-01")).otherwise(F.lit("1998-01-01"))
        return self.raw("part").select("p_partkey", "p_name", F.explode(lines).alias("line")).select(
            _product_name().alias("product_name"),
            F.concat(F.lit("material-"), ((F.col("p_partkey") * 7 + k * 13) % 50).cast("string"))
            .alias("material_name"),
            ((k + 1) * 0.125 + (v - 1) * 0.5).cast("decimal(18,6)").alias("ratio"),
            v.alias("version_number"),
            effective.cast("date").alias("effective_date"),
            F.when(v == 1, F.lit("1997-12-31").cast("date")).alias("end_date"),
            (v == 2).alias("is_current"),
        )

    @cached_property
    def dim_material(self) -> DataFrame:
        return self.bridge_product_material.select("material_name").distinct().select(
            F.replace("material_name", F.lit("material-"), F.lit("")).cast("bigint").alias("id"),
            F.col("material_name").alias("name"),
            F.lit(None).cast("string").alias("qc"),
            F.lit("kg").alias("unit"),
        )

    @cached_property
    def dim_retailer(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name")
        )

    @cached_property
    def blueprint(self) -> DataFrame:
        """One blueprint per part, at a factory that may lack a dimension row."""
        key = F.col("p_partkey")
        made = F.date_add(F.lit("2020-01-01").cast("date"), (key % 900).cast("int")).cast("timestamp")
        return self.raw("part").select(
            key.cast("string").alias("id"),
            _known_or_not(key % 100).alias("factory"),
            F.col("p_name").alias("name"),
            F.when(F.col("p_size") < 20, "PALLET").when(F.col("p_size") < 35, "HANGING")
            .otherwise("ROLLER").alias("type"),
            F.when(key % 3 != 0, F.col("p_brand")).alias("description"),
            F.concat(F.when(key % 50 == 7, "/other/").otherwise("/app/media/blueprints/"),
                     key.cast("string"), F.lit(".svg")).alias("file_path"),
            F.concat(F.col("p_name"), F.lit(".svg")).alias("filename"),
            (key * 10).alias("file_size"),
            made.alias("created_at"), made.alias("updated_at"),
        )

    def factory_requests(self) -> DataFrame:
        """Two requests per supplier; some lack a name."""
        key = F.col("s_suppkey")
        return self.raw("supplier").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).select(
            (key * 2 + F.col("copy")).alias("seq"),
            _known_or_not(key).alias("factory_code"),
            F.when((key % 20 != 9) | (F.col("copy") == 1),
                   F.concat_ws(" ", F.lit("New"), key.cast("string"), F.col("copy").cast("string")))
            .alias("factory_name"),
            F.lit("Rep").alias("salesman"),
            (key % 2 == 0).alias("is_active"),
            F.lit(False).alias("has_onsite"),
        )

    def factory_patches(self) -> DataFrame:
        """Two patches per supplier; values are missing in turn."""
        key, copy = F.col("s_suppkey"), F.col("copy")
        return self.raw("supplier").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).select(
            (key * 2 + copy).alias("seq"),
            _known_or_not(key).alias("factory_code"),
            F.when((key + copy) % 3 == 0, key % 2 == 0).alias("is_active"),
            F.when((key + copy) % 4 == 0, key % 2 == 1).alias("has_onsite"),
        )

    def retailer_requests(self) -> DataFrame:
        """Names that exist in other case, new names asked for twice, and empty names."""
        key = F.col("c_custkey")
        name = (F.when(key % 5 == 0, F.upper("c_name")).when(key % 5 == 1, F.lit(""))
                .when(key % 5 == 2, F.concat(F.lit("SHOP "), (key + 1).cast("string")))
                .otherwise(F.concat(F.lit("Shop "), key.cast("string"))))
        return self.raw("customer").select(key.alias("seq"), name.alias("name"))

    def retailer_renames(self) -> DataFrame:
        """New names, own names in other case, names of the next retailer, unknown ids, repeats."""
        key, copy = F.col("c_custkey"), F.col("copy")
        other = F.concat(F.lit("customer#"), F.lpad((key + 1).cast("string"), 9, "0"))
        name = (F.when(key % 6 == 0, F.upper("c_name")).when(key % 6 == 1, other)
                .when(key % 6 == 2, F.lit("")).when(key % 6 == 3, F.concat(
                    F.lit("Team "), F.floor(key / 12).cast("string")))
                .otherwise(F.concat_ws(" ", F.lit("Store"), key.cast("string"),
                                       copy.cast("string"))))
        copies = F.array(*map(F.lit, [0, 1]))
        return self.raw("customer").withColumn("copy", F.explode(copies)).select(
            (key * 2 + copy).alias("seq"),
            F.when(key % 7 == 5, F.concat(F.lit("x"), key.cast("string")))
            .otherwise(key.cast("string")).alias("id"),
            name.alias("name"),
        )

    def retailer_deletes(self) -> DataFrame:
        """Every other retailer and as many unknown ids, all of them twice."""
        key, copy = F.col("c_custkey"), F.col("copy")
        copies = F.array(*map(F.lit, [0, 1]))
        return self.raw("customer").withColumn("copy", F.explode(copies)).select(
            (key * 2 + copy).alias("seq"), (key * 2).cast("string").alias("id"))

    def blueprint_patches(self) -> DataFrame:
        """Two patches per part, some with an unknown type, some for unknown ids, some empty."""
        key, copy = F.col("p_partkey"), F.col("copy")
        copies = F.array(*map(F.lit, [0, 1]))
        return self.raw("part").withColumn("copy", F.explode(copies)).select(
            (key * 2 + copy).alias("seq"),
            F.when(key % 8 == 7, F.concat(F.lit("x"), key.cast("string")))
            .otherwise(key.cast("string")).alias("id"),
            F.when((key + copy) % 3 == 0, F.upper("p_name")).alias("name"),
            F.when((key + copy) % 5 == 0, "ROLLER").when((key + copy) % 5 == 1, "BELT").alias("type"),
            F.when((key + copy) % 4 == 0, F.lit("checked")).alias("description"),
        )

    def blueprint_requests(self) -> DataFrame:
        """One request per part; each refusal reason occurs."""
        key = F.col("p_partkey")
        return self.raw("part").select(
            key.alias("seq"),
            _known_or_not(key % 100).alias("factory"),
            F.col("p_name").alias("name"),
            F.when(key % 11 == 0, "BELT").otherwise("HANGING").alias("type"),
            F.col("p_brand").alias("description"),
            F.concat(F.col("p_name"), F.when(key % 13 == 0, ".png").otherwise(".SVG")).alias("filename"),
            F.when(key % 17 == 0, "image/png").otherwise("image/svg+xml").alias("content_type"),
            (key * 100_000).alias("file_size"),
        )

    def order_extract(self, upload: int = 0, deal: Deal = _as_they_lie) -> DataFrame:
        """Text cells of an order extract: 0 = all orders, 1 and 2 = two uploads that overlap.

        The second upload holds every order twice with higher quantities. `deal` shuffles the
        orders, which are a few numbers wide, before cells are made of them.
        """
        key = F.col("o_orderkey")
        orders = self.raw("orders")
        if upload == 1:
            orders = orders.filter("o_orderdate < '1999-01-01'")
        elif upload == 2:
            orders = orders.filter("o_orderdate >= '1998-01-01'")
        copies = F.array(*map(F.lit, [0, 1] if upload == 2 else [0]))
        orders = deal(orders).withColumn("copy", F.explode(copies))
        added = F.lit(0) if upload < 2 else F.lit(5) + F.col("copy") * 4
        day = F.col("o_orderdate").cast("date")
        tag = F.element_at(F.array(*map(F.lit, ["ST-1", "tn 7", "BP", "QT", "st-qt", ""])),
                           (key % 6 + 1).cast("int"))
        empty = F.lit("")

        def amount(divisor: int) -> Column:
            return (F.floor(F.col("o_totalprice") / divisor) + added).cast("string")

        return orders.select(
            F.when(key % 29 == 0, "junk").otherwise(_day_text(day, key % 8)).alias("order_date"),
            empty.alias("ct_date"),
            empty.alias("original_estimated_delivery_date"),
            F.date_add(day, (key % 60 + 30).cast("int")).cast("string")
            .alias("estimated_delivery_date"),
            F.concat(F.when(key % 4 == 0, "2202-").otherwise("2201-"), key.cast("string"))
            .alias("order_code"),
            _factory_text(F.col("o_custkey")).alias("factory_code"),
            F.concat_ws(" ", F.lit("Factory"), F.col("o_custkey").cast("string"), F.lit("in"),
                        F.year(day).cast("string")).alias("factory_name"),
            F.concat(F.lit("P"), (key % 500).cast("string")).alias("product_code"),
            F.concat(F.lit("Paint "), (key % 500).cast("string"), F.lit(".0"))
            .alias("product_name"),
            F.when(key % 17 == 0, "NA").otherwise(F.col("o_orderpriority")).alias("qc"),
            F.when(key % 997 == 0, "x").otherwise(amount(1000)).alias("order_quantity"),
            amount(2000).alias("delivered_quantity"),
            tag.alias("factory_order_code"),
            F.concat(F.lit("copy "), F.col("copy").cast("string")).alias("note"),
            F.when(key % 2 == 0, "1").otherwise("1.0").alias("numerical_order"),
            F.lit("A").alias("path"),
            F.col("o_orderstatus").alias("warehouse_type"),
            F.lit(upload).alias("source_file"),
            F.floor(key / 100000).alias("source_chunk"),
            (key % 100000 * 2 + F.col("copy")).alias("source_row"),
        )

    def sales_extract(self, upload: int = 0, deal: Deal = _as_they_lie) -> DataFrame:
        """Text cells of a sales extract: 0 = all lines, 1 and 2 = two uploads that overlap.

        Chunks are bounded runs of the source order (order, line, part, ...), and some orders
        lie in two of them. `deal` shuffles the lines before cells are made of them.
        """
        order, part, supplier = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
        lines = self.raw("lineitem")
        if upload == 1:
            lines = lines.filter("l_shipdate < '1999-01-01'")
        elif upload == 2:
            lines = lines.filter("l_shipdate >= '1998-01-01'")
        day = F.col("l_shipdate").cast("date")
        prefix = F.element_at(F.array(F.lit("2301-"), F.lit("2302-"), F.lit("2399-")),
                              (order % 3 + 1).cast("int"))
        tag = F.element_at(F.array(*map(F.lit, ["ST", "TN", "BP", "QT", ""])),
                           (part % 5 + 1).cast("int"))
        return deal(lines).select(
            F.when(part % 101 == 0, "junk").otherwise(_day_text(day, order % 8)).alias("sales_date"),
            F.lit("").alias("ct_date"),
            F.when(order % 499 != 0, F.concat(prefix, order.cast("string"))).alias("sales_code"),
            _factory_text(supplier).alias("factory_code"),
            F.concat(F.lit("Supplier "), supplier.cast("string")).alias("factory_name"),
            F.lit("Rep").alias("salesman"),
            F.concat(F.lit("P"), part.cast("string")).alias("product_code"),
            F.concat(F.lit("Part "), part.cast("string"), F.lit(".0")).alias("product_name"),
            F.when(part % 17 != 0, F.col("l_linestatus")).alias("qc"),
            F.concat(F.lit("W"), F.col("l_returnflag")).alias("warehouse_code"),
            F.col("l_quantity").cast("string").alias("sales_quantity"),
            F.concat(F.lit("2201-"), order.cast("string"), F.lit("-0001")).alias("order_code"),
            F.lit("").alias("import_code"),
            F.lit("null").alias("note"),
            tag.alias("factory_order_code"),
            F.lit(upload).alias("source_file"),
            F.floor((order * 8 + F.col("l_linenumber")) / 100).alias("source_chunk"),
            F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
            .alias("source_row"),
        )


def _day_text(day: Column, form: Column) -> Column:
    """One day in the forms that spreadsheets write: day first or ISO, three separators, with and
    without a time."""
    text = day.cast("string")
    for i, pattern in enumerate(("d/M/yyyy", "yyyy-MM-dd", "yyyy-MM-dd 00:00:00", "dd-MM-yyyy",
                                 "d.M.yyyy", "yyyy/MM/dd", "dd/MM/yyyy 00:00:00")):
        text = F.when(form == i, F.date_format(day, pattern)).otherwise(text)
    return F.when(form == 7, F.concat(day.cast("string"), F.lit("T00:00:00"))).otherwise(text)


def _known_or_not(key: Column) -> Column:
    """The code of a supplier; every tenth code is one that no supplier has."""
    return F.when(key % 10 == 9, key + 1_000_000).otherwise(key).cast("string")


def _package(size: Column) -> Column:
    return F.when(size < 25, "can").otherwise("drum")


def _factory_text(key: Column) -> Column:
    """The shared factory for every tenth key, else the key as a spreadsheet prints it."""
    return F.when(key % 10 == 3, "30895.2").otherwise(F.concat(key.cast("string"), F.lit(".0")))


def _product_name() -> Column:
    return F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string"))
