"""Column lists and types of the warehouse tables and of the extracts."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: column names and their order are the storage and file contract ---

ORDER_EXTRACT_COLUMNS = [
    "order_date", "ct_date", "original_estimated_delivery_date", "estimated_delivery_date",
    "order_code", "factory_code", "factory_name", "product_code", "product_name", "qc",
    "order_quantity", "delivered_quantity", "factory_order_code", "note", "numerical_order",
    "path", "warehouse_type",
]

SALES_EXTRACT_COLUMNS = [
    "sales_date", "ct_date", "sales_code", "factory_code", "factory_name", "salesman",
    "product_code", "product_name", "qc", "warehouse_code", "sales_quantity", "order_code",
    "import_code", "note", "factory_order_code",
]

ORDER_STAGING_COLUMNS = [
    "order_date", "order_code", "ct_date", "factory_code", "factory_name", "factory_order_code",
    "currency", "exchange_rate", "tax_type", "channel", "type", "area", "nation", "path",
    "path_2", "department", "salesman", "export_factory", "register_price", "note", "deposit",
    "deposit_rate", "payment_registration_code", "payment_registration_name",
    "register_transaction", "delivery_address", "delivery_address_2", "volumn_unit",
    "money_order", "tax", "total_quantity", "gw", "total_volumn", "total_package",
    "numerical_order", "product_code", "product_name", "qc", "factory_product_code",
    "warehouse_type", "predict_code", "factory_product_name", "factory_qc", "order_quantity",
    "delivered_quantity", "package_order_quantity", "delivered_package_order_quantity",
    "gift_quantity", "delivered_gift_quantity", "package_gift_quantity",
    "delivered_package_gift_quantity", "reserve_quantity", "delivered_reserve_quantity",
    "package_reserve_quantity", "delivered_package_reserve_quantity",
    "temporary_export_quantity", "package_temporary_export_quantity", "unit", "small_unit",
    "package_unit", "price", "money", "priced_quantity", "estimated_delivery_date",
    "original_estimated_delivery_date", "priced_unit", "pre_ct", "note_1", "finish_code",
    "package_pt", "package_name", "weight_with_package", "volumn_with_package", "project_code",
    "project_name", "import_timestamp",
]

SALES_STAGING_COLUMNS = [
    "product_code", "product_name", "qc", "factory_code", "factory_name", "sales_date",
    "sales_code", "order_code", "sales_quantity", "gift_quantity", "unit", "small_unit",
    "package_sales_quantity", "package_gift_quantity", "package_unit", "priced_quantity",
    "priced_unit", "currency", "exchange_rate", "price", "unpaid_tw", "tax_tw", "unpaid_vn",
    "tax_vn", "capital", "gross_profit", "gross_profit_rate", "lot_code", "tax_type",
    "department", "salesman", "export_factory_code", "export_factory", "warehouse_code",
    "warehouse_type", "warehouse_loc", "import_code", "note", "factory_order_code",
    "import_timestamp",
]

FACT_ORDER_COLUMNS = [
    "order_date", "order_code", "ct_date", "factory_code", "factory_order_code", "tax_type",
    "department", "salesman", "deposit_rate", "payment_registration_code",
    "payment_registration_name", "delivery_address", "product_code", "product_name", "qc",
    "warehouse_type", "order_quantity", "delivered_quantity", "package_order_quantity",
    "delivered_package_order_quantity", "unit", "package_unit", "estimated_delivery_date",
    "original_estimated_delivery_date", "pre_ct", "finish_code", "import_timestamp",
    "import_wh_timestamp",
]

FACT_SALES_COLUMNS = [
    "product_code", "product_name", "qc", "factory_code", "sales_date", "sales_code",
    "order_code", "sales_quantity", "unit", "package_sales_quantity", "package_unit",
    "department", "salesman", "warehouse_code", "warehouse_type", "import_code",
    "factory_order_code", "import_timestamp", "import_wh_timestamp",
]

# Text columns whose cells may carry a spreadsheet `.0`.
ORDER_STAGING_TEXT = [
    "factory_code", "factory_order_code", "path", "note", "numerical_order", "product_code",
    "product_name", "qc", "warehouse_type",
]
SALES_STAGING_TEXT = [
    "factory_code", "factory_name", "salesman", "product_code", "product_name", "qc",
    "warehouse_code", "order_code", "import_code", "note", "factory_order_code",
    "numerical_order", "sales_code",
]
FACT_SALES_TEXT = [
    "factory_code", "product_code", "product_name", "qc", "order_code", "unit", "package_unit",
    "department", "salesman", "warehouse_code", "warehouse_type", "import_code",
    "factory_order_code", "sales_code",
]

CALENDAR_FIELDS = ["year", "quarter", "month", "week_of_year", "day_of_week", "date", "day"]

PRODUCTION_LINES = ["PALLET", "HANGING", "ROLLER"]

THINNER_TYPES = ["原料溶劑 NL DUNG MOI", "成品溶劑DUNG MOI TP"]
PAINT_TYPES = ["烤調色PM HAP", "木調色PM GO", "底漆 LOT", "面漆 BONG"]

EXCLUDED_FACTORIES = ["30673"]

# --- End of fixed values ---

_NUMERIC_STAGING = {
    "exchange_rate", "money_order", "tax", "total_quantity", "gw", "total_volumn",
    "total_package", "price", "money", "unpaid_tw", "tax_tw", "unpaid_vn", "tax_vn", "capital",
    "gross_profit", "gross_profit_rate", "weight_with_package", "volumn_with_package",
}


def _type_of(column: str, numeric: set[str]) -> T.DataType:
    if column.endswith("_timestamp"):
        return T.TimestampType()
    if column.endswith("_date"):
        return T.DateType()
    if column.endswith("_quantity") or column in numeric:
        return T.DoubleType()
    return T.StringType()


def _struct(columns: list[str], numeric: set[str] = frozenset()) -> T.StructType:
    return T.StructType([T.StructField(c, _type_of(c, numeric)) for c in columns])


def _fields(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


_text, _int, _long, _flag = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
_date, _time = T.DateType(), T.TimestampType()

ORDER_EXTRACT = T.StructType([T.StructField(c, _text) for c in ORDER_EXTRACT_COLUMNS])
SALES_EXTRACT = T.StructType([T.StructField(c, _text) for c in SALES_EXTRACT_COLUMNS])

TABLES: dict[str, T.StructType] = {
    "order_staging": _struct(ORDER_STAGING_COLUMNS, _NUMERIC_STAGING),
    "sales_staging": _struct(SALES_STAGING_COLUMNS, _NUMERIC_STAGING),
    "fact_order": _struct(FACT_ORDER_COLUMNS, {"deposit_rate"}),
    "fact_sales": _struct(FACT_SALES_COLUMNS),
    "dim_date": _fields(date=_date, year=_int, quarter=_int, month=_int, week_of_year=_int,
                        day_of_week=_int, day=_int),
    "dim_factory": _fields(factory_code=_text, factory_name=_text, salesman=_text,
                           is_active=_flag, has_onsite=_flag),
    "dim_product": _fields(id=_long, product_name=_text, product_type=_text, qc=_text),
    "dim_material": _fields(id=_long, name=_text, qc=_text, unit=_text),
    "dim_retailer": _fields(id=_text, name=_text),
    "bridge_product_material": _fields(product_name=_text, material_name=_text,
                                       ratio=T.DecimalType(18, 6), version_number=_int,
                                       effective_date=_date, end_date=_date, is_current=_flag),
    "landing_rejects": _fields(path=_text, file_size=_long, modified_at=_time, reject_reason=_text),
    "blueprint": _fields(id=_text, factory=_text, name=_text, type=_text, description=_text,
                         file_path=_text, filename=_text, file_size=_long, created_at=_time,
                         updated_at=_time),
}

# Key of each stored table, and the date that partitions it by month (facts and staging only).
KEYS = {
    "order_staging": "order_code", "sales_staging": "sales_code",
    "fact_order": "order_code", "fact_sales": "sales_code",
    "dim_factory": "factory_code", "dim_product": "product_name",
    "dim_retailer": "id", "blueprint": "id",
}
# What the rows of a bucket are sorted by, so that readers skip parts of files: the key, but for
# orders the delivery date, by which reports read them over all months.
SORTED_BY = {"fact_order": "estimated_delivery_date"}
PARTITION_DATES = {
    "order_staging": "order_date", "sales_staging": "sales_date",
    "fact_order": "order_date", "fact_sales": "sales_date",
}
