"""Filtered lists of the dimensions and lookups by key.

Each list is the whole filtered table; `operators.paging.page` cuts a page out of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.predicates import where_equal, where_member, where_search
from tallymill.params import code_list

Codes = str | Sequence[str] | None

# Folder of stored files and the public prefix that stands for it.
MEDIA_FOLDER = "/app/media/"
PUBLIC_PREFIX = "/dw-media/"


def list_factories(dim_factory: DataFrame, is_active: bool | None = None,
                   has_onsite: bool | None = None, search: str | None = None) -> DataFrame:
    """Factories by status; the search looks at name and code."""
    rows = where_equal(where_equal(dim_factory, "is_active", is_active), "has_onsite", has_onsite)
    return where_search(rows, search, "factory_name", "factory_code").select(
        "factory_code", "factory_name", "salesman", "is_active", "has_onsite")


def list_products(dim_product: DataFrame, product_type: Codes = None,
                  search: str | None = None) -> DataFrame:
    """Products of some types whose name matches."""
    rows = where_member(dim_product, "product_type", code_list(product_type))
    return where_search(rows, search, "product_name").select(
        "id", "product_name", "product_type", "qc")


def list_materials(dim_material: DataFrame, search: str | None = None) -> DataFrame:
    """D3: materials whose name matches."""
    return where_search(dim_material, search, "name").select("id", "name", "qc", "unit")


def list_retailers(dim_retailer: DataFrame, search: str | None = None) -> DataFrame:
    """Retailers whose name matches."""
    return where_search(dim_retailer, search, "name").select("id", "name")


def list_formulas(bridge: DataFrame, product_name: Codes = None, material_name: Codes = None,
                  is_current: bool | None = True) -> DataFrame:
    """Bill-of-material lines, the current versions unless asked otherwise."""
    rows = where_member(bridge, "product_name", code_list(product_name))
    rows = where_member(rows, "material_name", code_list(material_name))
    return where_equal(rows, "is_current", is_current).select(
        "product_name", "material_name", "ratio", "version_number", "effective_date", "end_date",
        "is_current")


def public_url(path: Column) -> Column:
    """Public address of a stored file; null for a file outside the media folder."""
    inside = path.startswith(MEDIA_FOLDER)
    return F.when(inside, F.concat(F.lit(PUBLIC_PREFIX), F.substr(path, F.lit(len(MEDIA_FOLDER) + 1))))


def list_blueprints(blueprint: DataFrame, factory: str | None = None) -> DataFrame:
    """Blueprints, newest first, with their public address."""
    rows = where_equal(blueprint, "factory", factory)
    return _with_url(rows).orderBy(F.desc("created_at"), "id")


def _with_url(blueprint: DataFrame) -> DataFrame:
    return blueprint.withColumn("file_url", public_url(F.col("file_path")))


def look_up(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """One row per asked key with the table's columns, and whether it was found."""
    known = table.withColumn("found", F.lit(True))
    return keys.select(key).join(known, key, "left").withColumn(
        "found", F.coalesce("found", F.lit(False)))


def look_up_blueprints(keys: DataFrame, blueprint: DataFrame) -> DataFrame:
    """D7 for blueprints: with their public address."""
    return _with_url(look_up(keys, blueprint, "id"))
