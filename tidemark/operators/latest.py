"""Newest row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key.

    The limit on the row number lets each task keep one row per key before the shuffle, so a key with
    many versions costs no more than one with few.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place_in_key", place).where(F.col("place_in_key") <= 1).drop("place_in_key")


def latest_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the highest ``order`` values for every key."""
    return _first(rows, keys, [F.col(name).desc_nulls_last() for name in order])


def earliest_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the lowest ``order`` values for every key."""
    return _first(rows, keys, [F.col(name).asc_nulls_first() for name in order])
