"""Subject aggregates over tumbling event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import time_to_text
from tidemark.operators.facts import PRODUCT_AMOUNTS, PRODUCT_COUNTERS, VISITOR_COUNTERS
from tidemark.schemas import MONEY

PROVINCE_KEYS = [
    "province_id",
    "province_name",
    "province_area_code",
    "province_iso_code",
    "province_3166_2_code",
]


def _watermarked(rows: DataFrame, watermark: str) -> DataFrame:
    """Streams wait this long for late rows and drop rows that are later still."""
    return rows.withWatermark("rt", watermark) if rows.isStreaming else rows


def _bounds() -> list:
    return [F.col("window.start").alias("stt"), F.col("window.end").alias("edt")]


def format_bounds(stats: DataFrame) -> DataFrame:
    """Window bounds as text."""
    return stats.withColumns({"stt": time_to_text("stt"), "edt": time_to_text("edt")})


def stamp_now(stats: DataFrame) -> DataFrame:
    """Replace ``ts`` by the time of this run, as the version of its rows."""
    return stats.withColumn("ts", F.unix_millis(F.current_timestamp()))


def visitor_lateness(gap_ms: int = 10_000, watermark_ms: int = 2_000, slack_ms: int = 3_000) -> str:
    """How long visitor statistics have to wait for bounces judged with this gap and watermark.

    With the defaults this is the 15 seconds of ``visitor_stats``.
    """
    return f"{gap_ms + watermark_ms + slack_ms} milliseconds"


def visitor_stats(facts: DataFrame, window: str = "10 seconds", watermark: str = "15 seconds") -> DataFrame:
    """Visits, pages, entries, bounces and time on page by area, channel, version and new flag.

    A stream must wait as long as its inputs can be late; bounces come last (``visitor_lateness``).
    """
    keys = ["vc", "ch", "ar", "is_new"]
    sums = [F.sum(name).alias(name) for name in VISITOR_COUNTERS]
    return (
        _watermarked(facts, watermark)
        .groupBy(F.window("rt", window).alias("window"), *keys)
        .agg(*sums, F.min("ts").alias("ts"))
        .select(*_bounds(), *keys, *VISITOR_COUNTERS, "ts")
    )


def product_stats(facts: DataFrame, window: str = "10 seconds", watermark: str = "2 seconds") -> DataFrame:
    """Counters, amounts and distinct orders per sku.

    Facts are first reduced to one row per window, sku and order, marked by the kinds of fact it has;
    distinct orders are then a count of those marks. Both steps reduce before their shuffle, a best-selling
    sku is spread over its orders in the first one, and no step holds a set of order ids.
    """
    measures = [*PRODUCT_COUNTERS, *PRODUCT_AMOUNTS]
    marks = [F.max(F.when(F.col("fact") == kind, 1)).alias(f"has_{kind}") for kind in ("order", "payment", "refund")]
    per_order = (
        _watermarked(facts, watermark)
        .groupBy(F.window("rt", window).alias("window"), "sku_id", "order_id")
        .agg(*[F.sum(name).alias(name) for name in measures], *marks, F.min("ts").alias("ts"))
    )

    def orders(kind: str):
        return F.count(F.when(F.col(f"has_{kind}") == 1, F.col("order_id")))

    return (
        per_order.groupBy("window", "sku_id")
        .agg(
            *[F.sum(name).alias(name) for name in PRODUCT_COUNTERS],
            *[F.sum(name).cast("decimal(28,2)").alias(name) for name in PRODUCT_AMOUNTS],
            orders("order").alias("order_ct"),
            orders("payment").alias("paid_order_ct"),
            orders("refund").alias("refund_order_ct"),
            F.min("ts").alias("ts"),
        )
        .select(
            *_bounds(),
            "sku_id",
            *PRODUCT_COUNTERS,
            *PRODUCT_AMOUNTS,
            "order_ct",
            "paid_order_ct",
            "refund_order_ct",
            "ts",
        )
    )


def province_stats(wide: DataFrame, window: str = "10 seconds", watermark: str = "2 seconds") -> DataFrame:
    """Distinct orders and their amount per province, from wide order rows with ``rt``."""
    amount = F.coalesce(F.col("split_total_amount").cast(MONEY), F.lit(0).cast(MONEY))
    per_order = (
        _watermarked(wide, watermark)
        .groupBy(F.window("rt", window).alias("window"), *PROVINCE_KEYS, "order_id")
        .agg(F.sum(amount).alias("order_amount"), F.min(F.unix_millis("rt")).alias("ts"))
    )
    return (
        per_order.groupBy("window", *PROVINCE_KEYS)
        .agg(
            F.count("order_id").alias("order_count"),
            F.sum("order_amount").cast("decimal(28,2)").alias("order_amount"),
            F.min("ts").alias("ts"),
        )
        .select(*_bounds(), *PROVINCE_KEYS, "order_amount", "order_count", "ts")
    )


def sensor_totals(readings: DataFrame, window: str = "5 seconds", watermark: str = "20 seconds") -> DataFrame:
    """Sum of ``vc`` per sensor and window.

    Written in update mode, a window's total is repeated, grown, each time new rows reach it, and
    once more for rows that are late but not later than the watermark allows.
    """
    return (
        _watermarked(readings, watermark)
        .groupBy(F.window("rt", window).alias("window"), "id")
        .agg(F.sum("vc").alias("vc"))
        .select(*_bounds(), "id", "vc")
    )
