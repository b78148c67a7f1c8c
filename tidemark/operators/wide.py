"""Wide order and payment rows from time-bounded joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import create_date, create_hour, text_to_time
from tidemark.operators.skew import spread_join


def interval_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    lower: str,
    upper: str,
    hot_rows: int | None = None,
) -> DataFrame:
    """Inner join on ``key`` where ``right_time - left_time`` lies in ``[lower, upper]``.

    Bounds are Spark interval texts such as ``'-5 seconds'`` and are inclusive. ``right`` is the
    side that may have many rows per key. Apart from the key the two sides must not share column
    names. On streams both sides need a watermark, from which Spark derives when to drop state.

    A key with very many rows is left to adaptive execution, which splits the partition it measures;
    with ``hot_rows`` keys are counted first and those above it spread from the start.
    """
    band = F.col(right_time).between(
        F.col(left_time) + F.expr(f"INTERVAL '{lower}'"), F.col(left_time) + F.expr(f"INTERVAL '{upper}'")
    )
    if hot_rows is None or left.isStreaming or right.isStreaming:
        return left.join(right, key).where(band)
    return spread_join(right, left, [key], hot_rows=hot_rows).where(band)


def with_event_time(rows: DataFrame, column: str = "create_time", watermark: str | None = None) -> DataFrame:
    """Add the event time ``rt`` from a text column, with a watermark on streams."""
    rows = rows.withColumn("rt", text_to_time(column))
    return rows.withWatermark("rt", watermark) if watermark and rows.isStreaming else rows


ORDER_COLUMNS = [
    "province_id",
    "order_status",
    "user_id",
    "total_amount",
    "activity_reduce_amount",
    "coupon_reduce_amount",
    "original_total_amount",
    "feight_fee",
    "create_time",
]

DETAIL_COLUMNS = [
    "sku_id",
    "order_price",
    "sku_num",
    "sku_name",
    "split_activity_amount",
    "split_coupon_amount",
    "split_total_amount",
]

ORDER_WIDE_COLUMNS = [
    "detail_id",
    "order_id",
    *DETAIL_COLUMNS,
    *ORDER_COLUMNS,
    "create_date",
    "create_hour",
    "rt",
]


def order_wide(
    orders: DataFrame,
    details: DataFrame,
    lower: str = "-5 seconds",
    upper: str = "5 seconds",
    watermark: str = "0 seconds",
    hot_rows: int | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per order detail that lies within the band around its order's time.

    ``keep`` names further columns of the orders, such as those of dimensions joined to them before.
    """
    left = with_event_time(orders, watermark=watermark).select(
        F.col("id").alias("order_id"),
        *ORDER_COLUMNS,
        create_date("create_time").alias("create_date"),
        create_hour("create_time").alias("create_hour"),
        "rt",
        *keep,
    )
    right = (
        with_event_time(details, watermark=watermark)
        .withColumnsRenamed({"rt": "detail_time", "id": "detail_id"})
        .select("detail_id", "order_id", *DETAIL_COLUMNS, "detail_time")
    )
    joined = interval_join(left, right, "order_id", "rt", "detail_time", lower, upper, hot_rows)
    return joined.select(*ORDER_WIDE_COLUMNS, *keep)


def payment_wide(
    wide: DataFrame,
    payments: DataFrame,
    lower: str = "-5 seconds",
    upper: str = "15 minutes",
    watermark: str = "0 seconds",
) -> DataFrame:
    """One row per paid order detail.

    Where an order and its payment both have a column (``user_id``, ``total_amount``), the
    payment's value stands. ``create_time`` is kept from both under separate names.
    """
    left = wide.drop("user_id", "total_amount", "create_date", "create_hour").withColumnsRenamed(
        {"create_time": "order_create_time", "rt": "order_time"}
    )
    right = with_event_time(payments, watermark=watermark).select(
        F.col("id").alias("payment_id"),
        "order_id",
        "user_id",
        "total_amount",
        "subject",
        "payment_type",
        F.col("create_time").alias("payment_create_time"),
        "callback_time",
        "rt",
    )
    if left.isStreaming or right.isStreaming:
        return interval_join(left, right, "order_id", "order_time", "rt", lower, upper).drop("order_time")
    after = F.col("rt") >= F.col("order_time") + F.expr(f"INTERVAL '{lower}'")
    before = F.col("rt") <= F.col("order_time") + F.expr(f"INTERVAL '{upper}'")
    return left.join(right, "order_id").where(after & before).drop("order_time")


# Columns filled from the other row.
FILLED_COLUMNS = [
    "order_status",
    "create_time",
    "create_date",
    "coupon_reduce_amount",
    "activity_reduce_amount",
    "original_total_amount",
    "feight_fee",
    "total_amount",
    "user_id",
    "sku_id",
    "sku_name",
    "order_price",
    "sku_num",
]


def fill_from(wide: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Fill nulls of a wide row from another row with the same key; all rows are kept, none is repeated.

    Of several other rows under one key the first value that is not null counts, by the order of values.
    """
    filled = [name for name in FILLED_COLUMNS if name in wide.columns and name not in keys]
    source = other.groupBy(*keys).agg(*[F.min(name).alias(f"other_{name}") for name in filled])
    return wide.join(source, keys, "left").select(
        *[F.coalesce(name, f"other_{name}").alias(name) if name in filled else F.col(name) for name in wide.columns]
    )
