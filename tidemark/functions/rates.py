"""Visit rates. Every rate is 0 where there is no visit to divide by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _per_visit(amount: Column, visits: Column, scale: int) -> Column:
    # round() on decimals rounds half up.
    ratio = amount.cast("decimal(28,0)") / F.nullif(visits, F.lit(0)).cast("decimal(20,0)")
    return F.round(F.coalesce(ratio, F.lit(0)), scale)


def bounce_rate(bounces: Column, visits: Column) -> Column:
    """Percent of visits that bounced, two decimals."""
    return _per_visit(bounces * 100, visits, 2)


def seconds_per_visit(millis: Column, visits: Column) -> Column:
    """Seconds per visit, one decimal: rounded to a whole millisecond first, then again."""
    return F.round(_per_visit(millis, visits, 0) / F.lit(1000).cast("decimal(4,0)"), 1)


def pages_per_visit(pages: Column, visits: Column) -> Column:
    return _per_visit(pages, visits, 2)
