"""Dimension lookups."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import age_years
from tidemark.operators.skew import fits_broadcast, lookup_join


def enrich(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    columns: dict[str, Column | str],
    dim_key: str = "id",
    how: str = "inner",
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add columns of a dimension with one row per key.

    ``columns`` maps the new fact column to a dimension column or expression; a fact column of
    the same name is replaced. Facts with an unknown key are dropped unless ``how='left'``.
    Dimensions may hold their key as text: it is cast to the fact's key type. ``counted`` is a
    table to find hot keys in, for dimensions too large to broadcast (see ``skew.lookup_join``).
    """
    wanted = [(F.col(source) if isinstance(source, str) else source).alias(name) for name, source in columns.items()]
    key_type = facts.schema[key].dataType
    lookup = dim.select(F.col(dim_key).try_cast(key_type).alias(key), *wanted)
    facts = facts.drop(*[name for name in columns if name in facts.columns])
    return lookup_join(facts, lookup, [key], how, counted)


def with_user(
    facts: DataFrame,
    users: DataFrame,
    as_of: datetime.date | None = None,
    how: str = "inner",
    counted: DataFrame | None = None,
) -> DataFrame:
    """Age on ``as_of`` (today if left out) and gender of the user."""
    day = F.current_date() if as_of is None else F.lit(as_of)
    columns = {"user_age": age_years("birthday", day), "user_gender": "gender"}
    return enrich(facts, users, "user_id", columns, how=how, counted=counted)


def with_province(facts: DataFrame, provinces: DataFrame, how: str = "inner") -> DataFrame:
    columns = {
        "province_name": "name",
        "province_area_code": "area_code",
        "province_iso_code": "iso_code",
        "province_3166_2_code": "iso_3166_2",
    }
    return enrich(facts, provinces, "province_id", columns, how=how)


def _with_levels(rows: DataFrame, spu: DataFrame, trademark: DataFrame, category3: DataFrame, how: str) -> DataFrame:
    rows = enrich(rows, spu, "spu_id", {"spu_name": "spu_name"}, how=how)
    rows = enrich(rows, trademark, "tm_id", {"tm_name": "tm_name"}, how=how)
    return enrich(rows, category3, "category3_id", {"category3_name": "name"}, how=how)


def with_product(
    facts: DataFrame,
    sku: DataFrame,
    spu: DataFrame,
    trademark: DataFrame,
    category3: DataFrame,
    with_price: bool = False,
    how: str = "inner",
    counted: DataFrame | None = None,
) -> DataFrame:
    """Names and ids of the product levels above ``sku_id``.

    Small dimensions are broadcast one after the other, with no shuffle of the facts. A sku table
    beyond the broadcast size is joined to the levels above it first, so that the facts, many
    times larger, are shuffled once and not once per level.
    """
    columns = {"sku_name": F.col("sku_name")}
    if with_price:
        columns["sku_price"] = F.col("price").try_cast("decimal(18,2)")
    for name in ("spu_id", "tm_id", "category3_id"):
        columns[name] = F.col(name).try_cast("bigint")
    if fits_broadcast(sku):
        return _with_levels(enrich(facts, sku, "sku_id", columns, how=how), spu, trademark, category3, how)
    products = sku.select(F.col("id"), *[source.alias(name) for name, source in columns.items()])
    products = _with_levels(products, spu, trademark, category3, how)
    wanted = {name: name for name in products.columns if name != "id"}
    return enrich(facts, products, "sku_id", wanted, how=how, counted=counted)
