"""Landed extract files: admission and positional reading.

Nothing that lands is dropped unseen: a file is either read whole or refused with a reason.
Rows carry their place in numbers: that of the file (by modification time, then path), that of
a bounded run of rows (over all files, in their order), and the order within the run.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.schemas import ORDER_EXTRACT, SALES_EXTRACT, TABLES
from tallymill.session import packed

SUFFIXES = (".csv", ".parquet")
# A CSV file may be compressed; Spark knows that by this further suffix, in this case only.
COMPRESSED = ".gz"

SOURCE_FILE = "source_file"
SOURCE_CHUNK = "source_chunk"
SOURCE_ROW = "source_row"
ROWS_PER_CHUNK = 1 << 20
# A row's number within its chunk takes so many bits of its place.
ROW_BITS = 33

# Spreadsheets write a quote inside a cell as two quotes.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"'}
_RAGGED = "ragged_row"

# Reasons of refusal.
WRONG_SUFFIX, EMPTY, TOO_LARGE, COLUMN_COUNT = "wrong_suffix", "empty_file", "too_large", "column_count"
REFUSED_COLUMNS = TABLES["landing_rejects"].names

Cut = Callable[[DataFrame], DataFrame]


class Admission(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


class Landed(NamedTuple):
    """Rows of the files that were read, and the refused files with their reason."""

    rows: DataFrame
    refused: DataFrame


class ColumnMismatch(ValueError):
    """An extract has another number of columns than its schema."""


def uncompressed(name: Column) -> Column:
    """The name of a file, or of the file that was compressed."""
    return F.regexp_replace(name, rf"(\.[^./]+)\{COMPRESSED}$", "$1")


def judged_files(files: DataFrame, suffixes: tuple[str, ...] = SUFFIXES,
                 max_bytes: int | None = None) -> DataFrame:
    """Files (path, file_size, modified_at) with `reject_reason` or null.

    The suffix counts in any case; that of a compressed CSV file is the one before `.gz`. The size
    (as the file lies there) is not bounded unless the caller bounds it.
    """
    suffix = F.lower(F.regexp_extract(uncompressed(F.col("path")), r"(\.[^./]*)$", 1))
    unread = F.col("path").endswith(COMPRESSED) & (suffix != ".csv")
    reason = F.when(~suffix.isin(list(suffixes)) | unread, WRONG_SUFFIX).when(F.col("file_size") == 0, EMPTY)
    if max_bytes is not None:
        reason = reason.when(F.col("file_size") > max_bytes, TOO_LARGE)
    return files.withColumn("reject_reason", reason)


def listed_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, file_size, modified_at) of all files below a path, from metadata only.

    Spark's readers leave files of no bytes out of their rows, but not out of the names they
    list; such files have no time here.
    """
    held = spark.read.format("binaryFile").load(path)
    files = held.select("path", F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at"))
    names = [(re.sub("^file:/+", "file:/", unquote(name)),) for name in held.inputFiles()]
    empty = spark.createDataFrame(names, "path string").join(files.select("path"), "path", "left_anti")
    return files.union(empty.select("path", F.lit(0).cast("long"), F.lit(None).cast("timestamp")))


def admit(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES,
          max_bytes: int | None = None) -> Admission:
    """Files of a folder that may be loaded, and the others with the reason; no content is read."""
    judged = judged_files(listed_files(spark, folder), suffixes, max_bytes)
    return Admission(judged.filter("reject_reason IS NULL").drop("reject_reason"),
                     judged.filter("reject_reason IS NOT NULL"))


def place_in_source() -> Column:
    """The place of a row as one long: chunk and row."""
    return F.shiftleft(F.col(SOURCE_CHUNK).cast("long"), ROW_BITS).bitwiseOR(F.col(SOURCE_ROW).cast("long"))


def _place(part: Column, row: Column) -> list[Column]:
    file = F.struct(F.col("_metadata.file_modification_time").alias("modified_at"),
                    F.col("_metadata.file_path").alias("path"))
    return [file.alias(SOURCE_FILE), part.cast("bigint").alias(SOURCE_CHUNK),
            row.bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias(SOURCE_ROW),
            F.col("_metadata.file_size").alias("file_size")]


def _numbered(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Written rows of some chunks with numbers for file and chunk. The numbering sees one row for each chunk."""
    numbers = chunks.select(SOURCE_FILE, SOURCE_CHUNK).withColumns({
        "file_number": F.dense_rank().over(Window.orderBy(SOURCE_FILE)).cast("long"),
        "chunk_number": F.row_number().over(Window.orderBy(SOURCE_FILE, SOURCE_CHUNK)).cast("long")})
    return rows.join(numbers, [SOURCE_FILE, SOURCE_CHUNK]).withColumns({
        SOURCE_FILE: F.col("file_number"), SOURCE_CHUNK: F.col("chunk_number")}).drop(
        "file_number", "chunk_number")


def _csv_rows(spark: SparkSession, path: str | list[str], schema: T.StructType,
              multiline: bool) -> DataFrame:
    checked = T.StructType([*schema.fields, T.StructField(_RAGGED, T.StringType())])
    raw = spark.read.schema(checked).options(
        **CSV_OPTIONS, multiLine=multiline, columnNameOfCorruptRecord=_RAGGED,
        pathGlobFilter=f"{_glob('.csv')}{{,{COMPRESSED}}}").csv(path)
    return raw.select(*schema.names, F.col(_RAGGED).isNotNull().alias(_RAGGED), *_place(
        F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))


def _parquet_rows(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    raw = spark.read.options(mergeSchema=True, pathGlobFilter=_glob(".parquet")).parquet(*([path] if isinstance(path, str) else path))
    if len(raw.columns) != len(schema):
        raise ColumnMismatch(f"expected {len(schema)} columns, found {len(raw.columns)}")
    index = F.col("_metadata.row_index")
    cells = [F.col(f"`{c}`").cast("string").alias(f.name) for c, f in zip(raw.columns, schema)]
    return raw.select(*cells, F.lit(False).alias(_RAGGED), *_place(
        F.floor(index / ROWS_PER_CHUNK), index))


def _glob(suffix: str) -> str:
    """Names with a suffix in any case."""
    return "*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix)


def _sorted_out(rows: DataFrame, cut: Cut) -> Landed:
    """Files with a row of another number of cells are refused whole.

    What is known of the chunks is written too: its size then shows that it can be broadcast, and no
    row is shuffled to the few files there are.
    """
    rows = cut(rows)
    chunks = cut(rows.groupBy(SOURCE_FILE, SOURCE_CHUNK).agg(
        F.max(_RAGGED).alias(_RAGGED), F.max("file_size").alias("file_size")))
    judged = chunks.withColumn(_RAGGED, F.max(_RAGGED).over(Window.partitionBy(SOURCE_FILE)))
    refused = judged.filter(_RAGGED).select(
        F.col(f"{SOURCE_FILE}.path").alias("path"), "file_size",
        F.col(f"{SOURCE_FILE}.modified_at").alias("modified_at"),
        F.lit(COLUMN_COUNT).alias("reject_reason")).distinct()
    return Landed(_numbered(rows.drop(_RAGGED, "file_size"), judged.filter(~F.col(_RAGGED))), refused)


def read_extract(spark: SparkSession, path: str | list[str], schema: T.StructType,
                 file_format: str = "csv", multiline: bool = False, cut: Cut = packed,
                 max_bytes: int | None = None) -> Landed:
    """Extract files as text columns by position, with the place of each row.

    Files of another suffix, of no bytes, or of more than `max_bytes` are refused unread.

    CSV files are split by Spark; pass `multiline=True` for files whose cells hold line breaks:
    each is then read by one task, as is a compressed one (`.csv.gz`; one without content has no rows).
    A CSV file with a row of another number of cells is refused.
    Parquet files of one read share one schema; another number of columns raises.
    The rows are written once (`cut`), so that later steps do not parse the files again.
    """
    if file_format not in ("csv", "parquet"):
        raise ValueError(f"unknown extract format {file_format}")
    refused = admit(spark, path, (f".{file_format}",), max_bytes).rejected
    read = _parquet_rows(spark, path, schema) if file_format == "parquet" else _csv_rows(
        spark, path, schema, multiline)
    landed = _sorted_out(read if max_bytes is None else read.where(F.col("file_size") <= max_bytes), cut)
    return Landed(landed.rows, landed.refused.unionByName(refused))


def read_listed(spark: SparkSession, files: DataFrame, schema: T.StructType, multiline: bool,
                suffixes: tuple[str, ...], max_bytes: int | None, cut: Cut) -> Landed:
    """The files of a bounded listing (path, file_size, modified_at), of either format.

    Paths and Parquet column names go through the driver: bound the listing.
    """
    judged = cut(judged_files(files, suffixes, max_bytes))
    refused = judged.filter("reject_reason IS NOT NULL")
    paths = [_literal(r.path) for r in judged.filter("reject_reason IS NULL").select("path").collect()]
    parts: list[DataFrame] = []
    csv = [p for p in paths if not p.lower().endswith(".parquet")]
    if csv:
        parts.append(_csv_rows(spark, csv, schema, multiline))
    # One read for all files of a layout, however many they are.
    layouts: dict[tuple[str, ...], list[str]] = {}
    for path in sorted(set(paths) - set(csv)):
        layouts.setdefault(tuple(spark.read.parquet(path).columns), []).append(path)
    for columns, same in layouts.items():
        if len(columns) == len(schema):
            parts.append(_parquet_rows(spark, same, schema))
        else:
            refused = refused.unionByName(judged.filter(F.col("path").isin([p.replace("\\", "") for p in same]))
                                          .withColumn("reject_reason", F.lit(COLUMN_COUNT)))
    if not parts:
        place = T.StructType([T.StructField(c, T.LongType()) for c in (SOURCE_FILE, SOURCE_CHUNK, SOURCE_ROW)])
        return Landed(spark.createDataFrame([], T.StructType([*schema.fields, *place.fields])), refused)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    landed = _sorted_out(rows, cut)
    return Landed(landed.rows, refused.unionByName(landed.refused))


def _literal(path: str) -> str:
    """A path whose characters are no glob."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in path)


def read_order_extract(spark: SparkSession, path: str | list[str], file_format: str = "csv",
                       multiline: bool = False, cut: Cut = packed, max_bytes: int | None = None) -> Landed:
    """S3: 17 text columns by position; see `read_extract`."""
    return read_extract(spark, path, ORDER_EXTRACT, file_format, multiline, cut, max_bytes)


def read_sales_extract(spark: SparkSession, path: str | list[str], file_format: str = "csv",
                       multiline: bool = False, cut: Cut = packed, max_bytes: int | None = None) -> Landed:
    """15 text columns by position; see `read_extract`."""
    return read_extract(spark, path, SALES_EXTRACT, file_format, multiline, cut, max_bytes)
