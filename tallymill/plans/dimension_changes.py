"""Batch changes of dimension tables.

A batch is a frame of requests with `seq`, the order they came in. Each function gives the
table after the batch and one outcome per request. With one request per batch the outcome
is what the request alone would get; the docstrings say how requests of one batch interact.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.dates import timestamp_literal
from tallymill.schemas import PRODUCTION_LINES, TABLES

# What names and files must be like. MAX_NAME only refuses, it never shortens.
MAX_NAME = 255
SVG_CONTENT_TYPES = ["image/svg+xml", "text/xml", "application/xml"]
BLUEPRINT_FOLDER = "/app/media/blueprints/"

CREATED, UPDATED, DELETED = "created", "updated", "deleted"
EXISTS, NOT_FOUND, INVALID, EMPTY = "exists", "not_found", "invalid", "empty"
NAME_TAKEN, SUPERSEDED = "name_taken", "superseded"


class Change(NamedTuple):
    table: DataFrame
    outcomes: DataFrame


def _any_null(*columns: str) -> Column:
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return missing


def _flagged(requests: DataFrame, table: DataFrame, key: Column, name: str) -> DataFrame:
    """Add `name`: whether the request's `match` value is among the table's keys."""
    known = table.select(key.alias("match")).distinct().withColumn(name, F.lit(True))
    return requests.join(known, "match", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _match(key: Column, bad: Column) -> Column:
    """What a request is matched by: null for a bad one, which then takes no part in joins.

    Bad requests may share one value, such as an empty name, in any number.
    """
    return F.when(~bad, key)


def _first_of(requests: DataFrame, wanted: Column) -> DataFrame:
    """Add `first_seq`: the earliest wanted request with the same `match` value."""
    first = requests.filter(wanted).groupBy("match").agg(F.min("seq").alias("first_seq"))
    return requests.join(first, "match", "left")


def _generated_id(text: Column) -> Column:
    """A UUID-shaped id made from a text."""
    return F.regexp_replace(F.md5(text), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _bad_name(name: Column) -> Column:
    return name.isNull() | (F.length(name) < 1) | (F.length(name) > MAX_NAME)


def insert_factories(dim_factory: DataFrame, requests: DataFrame) -> Change:
    """Add factories; a code that is taken, also earlier in the batch, is refused."""
    columns = TABLES["dim_factory"].names
    judged = requests.withColumns({
        "match": _match(F.col("factory_code"), _any_null(*columns)), "bad": _any_null(*columns)})
    judged = _first_of(_flagged(judged, dim_factory, F.col("factory_code"), "known"),
                       ~F.col("bad"))
    outcome = F.when(F.col("bad"), INVALID).when(
        F.col("known") | (F.col("seq") != F.col("first_seq")), EXISTS).otherwise(CREATED)
    judged = judged.withColumn("outcome", outcome)
    added = judged.filter(F.col("outcome") == CREATED).select(*columns)
    return Change(dim_factory.select(*columns).unionByName(added),
                  judged.select("seq", "factory_code", "outcome"))


def insert_retailers(dim_retailer: DataFrame, requests: DataFrame, batch: str) -> Change:
    """Add retailers; a name that is taken in any case, also earlier in the batch, is refused.

    Ids come from `batch` and the name, so a repeated run makes the same ids; every batch
    needs its own text.
    """
    judged = requests.withColumns({
        "match": _match(F.lower("name"), _bad_name(F.col("name"))), "bad": _bad_name(F.col("name"))})
    judged = _first_of(_flagged(judged, dim_retailer, F.lower("name"), "known"), ~F.col("bad"))
    outcome = F.when(F.col("bad"), INVALID).when(
        F.col("known") | (F.col("seq") != F.col("first_seq")), EXISTS).otherwise(CREATED)
    new_id = _generated_id(F.concat(F.lit(batch + ":"), F.col("match")))
    judged = judged.withColumn("outcome", outcome)
    judged = judged.withColumn("id", F.when(F.col("outcome") == CREATED, new_id))
    added = judged.filter(F.col("outcome") == CREATED).select("id", "name")
    return Change(dim_retailer.select("id", "name").unionByName(added),
                  judged.select("seq", "name", "id", "outcome"))


def _patched(table: DataFrame, judged: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The table with the last value that any accepted request gives for each column."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"new_{c}") for c in columns]
    patch = judged.filter(F.col("outcome") == UPDATED).groupBy(key).agg(*last)
    changed = {c: F.coalesce(f"new_{c}", c) for c in columns}
    return table.join(patch, key, "left").withColumns(changed).select(*table.columns)


def _judge_patch(table: DataFrame, requests: DataFrame, key: str, columns: Sequence[str],
                 bad: Column) -> DataFrame:
    judged = _flagged(requests.withColumn("match", F.col(key)), table, F.col(key), "known")
    nothing = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNull()
    outcome = (F.when(bad, INVALID).when(~F.col("known"), NOT_FOUND)
               .when(nothing, EMPTY).otherwise(UPDATED))
    return judged.withColumn("outcome", outcome)


def patch_factories(dim_factory: DataFrame, requests: DataFrame) -> Change:
    """Set `is_active` and `has_onsite`; null leaves a value as it is.

    Requests for one factory apply one after the other.
    """
    columns = ["is_active", "has_onsite"]
    judged = _judge_patch(dim_factory, requests, "factory_code", columns, F.lit(False))
    return Change(_patched(dim_factory, judged, "factory_code", columns),
                  judged.select("seq", "factory_code", "outcome"))


def patch_blueprints(blueprint: DataFrame, requests: DataFrame) -> Change:
    """Set name, type and description of blueprints; null leaves a value as it is.

    Requests for one blueprint apply one after the other.
    """
    columns = ["name", "type", "description"]
    bad = F.coalesce(~F.col("type").isin(PRODUCTION_LINES), F.lit(False)) | F.coalesce(
        F.length("name") > MAX_NAME, F.lit(False))
    judged = _judge_patch(blueprint, requests, "id", columns, bad)
    return Change(_patched(blueprint, judged, "id", columns),
                  judged.select("seq", "id", "outcome"))


def rename_retailers(dim_retailer: DataFrame, requests: DataFrame) -> Change:
    """Rename retailers; a name that another retailer has, in any case, is refused.

    Names are checked against the table before the batch. The last request for a retailer
    counts, earlier ones are superseded; of several retailers asking for one name the first
    gets it.
    """
    judged = _flagged(requests.withColumn("match", F.col("id")), dim_retailer, F.col("id"), "known")
    bad = _bad_name(F.col("name"))
    sound = ~bad & F.col("known")
    last = judged.filter(sound).groupBy("match").agg(F.max("seq").alias("last_seq"))
    judged = judged.join(last, "match", "left").withColumn("match", _match(F.lower("name"), bad))

    # Owners of a name: two ids tell whether anybody but the asking retailer has it.
    owners = dim_retailer.groupBy(F.lower("name").alias("match")).agg(
        F.min("id").alias("lowest_owner"), F.max("id").alias("highest_owner"))
    judged = judged.join(owners, "match", "left")
    taken = F.coalesce(
        (F.col("lowest_owner") != F.col("id")) | (F.col("highest_owner") != F.col("id")),
        F.lit(False))
    judged = judged.withColumn("outcome", F.when(bad, INVALID).when(~F.col("known"), NOT_FOUND)
                               .when(F.col("seq") != F.col("last_seq"), SUPERSEDED)
                               .when(taken, NAME_TAKEN).otherwise(UPDATED))
    judged = _first_of(judged, F.col("outcome") == UPDATED)
    late = (F.col("outcome") == UPDATED) & (F.col("seq") != F.col("first_seq"))
    judged = judged.withColumn("outcome", F.when(late, NAME_TAKEN).otherwise(F.col("outcome")))

    renamed = judged.filter(F.col("outcome") == UPDATED).select("id", F.col("name").alias("new_name"))
    table = dim_retailer.join(renamed, "id", "left").select(
        "id", F.coalesce("new_name", "name").alias("name"))
    return Change(table, judged.select("seq", "id", "outcome"))


def delete_rows(table: DataFrame, requests: DataFrame, key: str) -> Change:
    """Delete rows by key; an unknown key is reported, also if deleted earlier in the batch."""
    judged = requests.withColumn("match", F.col(key))
    judged = _first_of(_flagged(judged, table, F.col(key), "known"), F.lit(True))
    outcome = F.when(F.col("known") & (F.col("seq") == F.col("first_seq")), DELETED)
    return Change(table.join(requests.select(key).distinct(), key, "left_anti").select(*table.columns),
                  judged.select("seq", key, outcome.otherwise(NOT_FOUND).alias("outcome")))


def insert_blueprints(blueprint: DataFrame, dim_factory: DataFrame, requests: DataFrame,
                      created_at: datetime, batch: str, max_bytes: int | None = None,
                      media_folder: str = BLUEPRINT_FOLDER) -> Change:
    """Add blueprint rows for known factories, known line types and SVG files.

    Ids come from `batch` and `seq`; every batch needs its own text. Files of more than
    `max_bytes` are refused, if it is given.
    """
    judged = _flagged(requests.withColumn("match", F.col("factory")), dim_factory,
                      F.col("factory_code"), "known")
    is_svg = F.lower("filename").endswith(".svg")
    outcome = (
        F.when(~F.coalesce(F.col("type").isin(PRODUCTION_LINES), F.lit(False)), "invalid_type")
        .when(~F.coalesce(is_svg, F.lit(False)), "not_svg")
        .when(~F.coalesce(F.col("content_type").isin(SVG_CONTENT_TYPES), F.lit(False)),
              "wrong_content_type")
        .when(~F.col("known"), "unknown_factory")
        .when(F.lit(False) if max_bytes is None else F.col("file_size") > max_bytes, "too_large")
        .otherwise(CREATED)
    )
    new_id = _generated_id(F.concat(F.lit(batch + ":"), F.col("seq").cast("string")))
    suffix = F.regexp_extract("filename", r"(\.[^.]*)$", 1)
    stamp = timestamp_literal(created_at)
    judged = judged.withColumn("outcome", outcome)
    judged = judged.withColumns({
        "id": F.when(F.col("outcome") == CREATED, new_id),
        "created_at": stamp, "updated_at": stamp,
    })
    added = judged.filter(F.col("outcome") == CREATED).withColumn(
        "file_path", F.concat(F.lit(media_folder), F.col("id"), suffix)
    ).select(*[F.col(f.name).cast(f.dataType) for f in TABLES["blueprint"]])
    return Change(blueprint.select(*added.columns).unionByName(added),
                  judged.select("seq", "factory", "id", "outcome"))
