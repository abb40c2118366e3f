"""From an extract to staging rows, and the incremental read of staging."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.dates import parse_day_first, timestamp_literal
from tallymill.functions.text import drop_point_zero, missing_to_null, ordinal_text
from tallymill.operators.ordinals import ordinal_in_key
from tallymill.operators.upsert import one_row_per_key
from tallymill.schemas import (
    ORDER_EXTRACT_COLUMNS, ORDER_STAGING_TEXT, SALES_EXTRACT_COLUMNS, SALES_STAGING_TEXT, TABLES,
)
from tallymill.session import durable
from tallymill.sources.landing import Cut, SOURCE_CHUNK, SOURCE_FILE, SOURCE_ROW, place_in_source

REASON = "reject_reason"
# True for a row with a date cell that is no date; the row is kept, its date is null.
BAD_DATE = "bad_date"
BAD_NUMBER = "__bad_number"
SOURCE_ORDER = [SOURCE_FILE, SOURCE_CHUNK, SOURCE_ROW]
ORDER_UPDATES = ["order_quantity", "delivered_quantity", "import_timestamp"]
FIRST_WATERMARK = datetime(1900, 1, 1)


def _cells(extract: DataFrame, columns: list[str]) -> DataFrame:
    cells = [missing_to_null(F.col(c)).alias(c) for c in columns]
    return extract.select(*cells, *SOURCE_ORDER)


def _typed(table: str, rows: DataFrame, import_timestamp: datetime) -> DataFrame:
    """The staging columns that the extract fills, plus reason and place.

    The store adds the others when it writes (`tables.padded`): carrying their nulls through shuffles
    and joins would make rows several times as wide.
    """
    columns, dates = [], []
    given = F.lit(0)
    for field in TABLES[table]:
        if field.name == "import_timestamp":
            columns.append(timestamp_literal(import_timestamp).alias(field.name))
        elif field.name in rows.columns:
            value = F.col(field.name)
            kind = field.dataType.typeName()
            if kind == "date":
                dates.append(field.name)
                given = given + value.isNotNull().cast("int")
                value = parse_day_first(value)
            elif kind == "double":
                value = value.try_cast("double")
            columns.append(value.alias(field.name))
    typed = rows.select(*columns, REASON, given.alias("given"), *SOURCE_ORDER)
    found = F.lit(0)
    for c in dates:
        found = found + F.col(c).isNotNull().cast("int")
    return typed.withColumn(BAD_DATE, F.col("given") > found).drop("given")


def _with_numbers(rows: DataFrame, *columns: str) -> DataFrame:
    """Cells read as numbers, and in BAD_NUMBER whether one of them is no number."""
    read = rows.withColumns({f"__{c}": F.col(c).try_cast("double") for c in columns})
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.col(c).isNotNull() & F.col(f"__{c}").isNull())
    return read.withColumns({BAD_NUMBER: bad, **{c: F.col(f"__{c}") for c in columns}}).drop(
        *[f"__{c}" for c in columns])


def _without_point_zero(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns without `.0`, by one function over the array of them.

    Spark makes one method of all steps of a stage, and Java runs a method of more than 8,000 bytes
    uncompiled, several times as slowly. A copy of the function for each of so many columns takes the
    steps from an extract to typed rows beyond that; a function over an array parts them.
    """
    done = rows.withColumn("__texts", F.transform(F.array(*columns), drop_point_zero))
    return done.withColumns({c: F.col("__texts")[i] for i, c in enumerate(columns)}).drop("__texts")


def clean_orders(extract: DataFrame, import_timestamp: datetime) -> DataFrame:
    """Rows of an order extract as staging holds them, with place and reject reason or null.

    The ordinal of the line becomes part of the order code. Rows without code or ordinal,
    and rows whose ordinal or quantities are no numbers, carry a reason.
    """
    rows = _with_numbers(_cells(extract, ORDER_EXTRACT_COLUMNS), "order_quantity", "delivered_quantity")
    rows = rows.withColumn("__number", F.col("numerical_order").try_cast("double").try_cast("bigint"))
    rows = rows.withColumn("__ordinal", ordinal_text(F.col("__number")))
    reason = (
        F.when(F.col("order_code").isNull() | F.col("numerical_order").isNull(), "missing_code")
        .when(F.col("__number").isNull(), "bad_ordinal")
        .when(F.col(BAD_NUMBER), "bad_quantity")
    )
    rows = rows.withColumns({
        REASON: reason,
        "order_code": F.concat(F.col("order_code"), F.lit("-"), F.col("__ordinal")),
        "numerical_order": F.col("__ordinal"),
    })
    rows = _without_point_zero(rows, ORDER_STAGING_TEXT)
    return _typed("order_staging", rows, import_timestamp)


def clean_sales(extract: DataFrame, import_timestamp: datetime) -> DataFrame:
    """Rows of a sales extract as staging holds them, with place and reject reason or null.

    Lines of one file that share a sales code are numbered in source order, and the number
    becomes part of the code. A line rejected for its quantity keeps its number. A file that
    repeats a code of an earlier one makes the same codes again.
    """
    rows = _cells(extract, SALES_EXTRACT_COLUMNS)
    rows = _with_numbers(rows, "sales_quantity")
    coded = ordinal_in_key(rows.filter(F.col("sales_code").isNotNull()),
                           ["sales_code", SOURCE_FILE], SOURCE_CHUNK, SOURCE_ROW, "ordinal")
    ordinal = ordinal_text(F.col("ordinal"))
    coded = coded.withColumns({
        REASON: F.when(F.col(BAD_NUMBER), "bad_quantity"),
        "factory_code": drop_point_zero(F.col("factory_code")),
        "sales_code": F.concat(F.col("sales_code"), F.lit("-"), ordinal),
        "numerical_order": ordinal,
    }).drop("ordinal")
    coded = coded.withColumns({c: drop_point_zero(F.col(c)) for c in SALES_STAGING_TEXT})
    uncoded = rows.filter(F.col("sales_code").isNull()).withColumn(REASON, F.lit("missing_code"))
    both = coded.unionByName(uncoded, allowMissingColumns=True)
    return _typed("sales_staging", both, import_timestamp)


def accepted(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter(F.col(REASON).isNull()).drop(REASON, BAD_DATE)


def rejected(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter(F.col(REASON).isNotNull())


def staged_orders(cleaned: DataFrame, cut: Cut = durable) -> DataFrame:
    """One staging row per order code, ready for the upsert. Write `cleaned` first: it is read thrice."""
    return one_row_per_key(accepted(cleaned), "order_code", place_in_source(), SOURCE_ORDER, ORDER_UPDATES, cut)


def staged_sales(cleaned: DataFrame, cut: Cut = durable) -> DataFrame:
    """One staging row per sales code, ready to be inserted if absent. Write `cleaned` first.

    Codes are numbered within a file, so only rows of different files share one: the rows of a single
    file are neither grouped nor joined.
    """
    files = cleaned.agg(F.min(SOURCE_FILE).alias("first"), F.max(SOURCE_FILE).alias("last")).first()
    if files["first"] == files["last"]:
        placed = F.col("sales_code").isNotNull() & F.col(SOURCE_FILE).isNotNull()
        return accepted(cleaned).where(placed).drop(*SOURCE_ORDER)
    return one_row_per_key(accepted(cleaned), "sales_code", F.col(SOURCE_FILE).cast("long"), SOURCE_ORDER, cut=cut)


def watermark(fact: DataFrame) -> Column:
    """Latest import the fact holds, as a scalar subquery; long past for an empty fact."""
    latest = F.coalesce(F.max("import_timestamp"), timestamp_literal(FIRST_WATERMARK))
    return fact.agg(latest.alias("import_timestamp")).scalar()


def staged_since(staging: DataFrame, since: Column | datetime) -> DataFrame:
    """Staging rows imported after the watermark."""
    since = since if isinstance(since, Column) else timestamp_literal(since)
    return staging.filter(F.col("import_timestamp") > since)
