"""Dashboard reports over the aggregate tables.

Each report takes the day as a number ``yyyymmdd``; 0 means today. Reports by ``day`` instead
cover every day of the table at once, with the day as one more grouping column.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.constants import KEYWORD_WEIGHTS
from tidemark.functions.rates import bounce_rate, pages_per_visit, seconds_per_visit
from tidemark.operators.facts import VISITOR_COUNTERS

# Grouping columns of the product reports.
BY_TRADEMARK = ["tm_id", "tm_name"]
BY_CATEGORY = ["category3_id", "category3_name"]
BY_SPU = ["spu_id", "spu_name"]


def on_day(stats: DataFrame, date: int = 0) -> DataFrame:
    """Rows of one day.

    A table stored by ``dt`` is read from that partition only. Otherwise the day is a range of
    ``stt``, which Spark pushes through the window aggregation towards the scan.
    """
    if date:
        day = F.lit(datetime.datetime.strptime(str(date), "%Y%m%d").date())
    else:
        day = F.current_date()
    if "dt" in stats.columns:
        return stats.where(F.col("dt") == day)
    return stats.where((F.col("stt") >= day) & (F.col("stt") < F.date_add(day, 1)))


def by_day(stats: DataFrame) -> DataFrame:
    return stats.withColumn("day", F.to_date("stt"))


def _top(ranked: DataFrame, order: list[Column], limit: int, day: str | None) -> DataFrame:
    if day is None:
        return ranked.orderBy(*order).limit(limit)
    # Spark keeps only the first rows of each day per task before the shuffle.
    place = F.row_number().over(Window.partitionBy(day).orderBy(*order))
    return ranked.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def gmv(stats: DataFrame, date: int = 0) -> DataFrame:
    return on_day(stats, date).agg(F.sum("order_amount").alias("gmv"))


def gmv_by_day(stats: DataFrame) -> DataFrame:
    return by_day(stats).groupBy("day").agg(F.sum("order_amount").alias("gmv"))


def top_products(stats: DataFrame, by: list[str], limit: int = 10, day: str | None = None) -> DataFrame:
    """Order amount and orders by product level, largest first, without those that sold nothing."""
    keys = [day, *by] if day else by
    sold = (
        stats.groupBy(*keys)
        .agg(F.sum("order_amount").alias("order_amount"), F.sum("order_ct").alias("order_ct"))
        .where(F.col("order_amount") > 0)
    )
    return _top(sold, [F.desc("order_amount"), *by], limit, day)


def top_trademarks(stats: DataFrame, date: int = 0, limit: int = 10) -> DataFrame:
    return top_products(on_day(stats, date), BY_TRADEMARK, limit).drop("order_ct")


def top_categories(stats: DataFrame, date: int = 0, limit: int = 10) -> DataFrame:
    return top_products(on_day(stats, date), BY_CATEGORY, limit).drop("order_ct")


def top_spus(stats: DataFrame, date: int = 0, limit: int = 10) -> DataFrame:
    return top_products(on_day(stats, date), BY_SPU, limit)


def province_amounts(stats: DataFrame, date: int = 0) -> DataFrame:
    return (
        on_day(stats, date)
        .groupBy("province_id", "province_name")
        .agg(F.sum("order_amount").alias("order_amount"))
        .select("province_name", "order_amount")
    )


def province_amounts_by_day(stats: DataFrame) -> DataFrame:
    return (
        by_day(stats)
        .groupBy("day", "province_id", "province_name")
        .agg(F.sum("order_amount").alias("order_amount"))
    )


def visitors_by_flag(stats: DataFrame, date: int = 0) -> DataFrame:
    sums = [F.sum(name).alias(name) for name in VISITOR_COUNTERS]
    return on_day(stats, date).groupBy("is_new").agg(*sums)


def visitors_by_flag_and_day(stats: DataFrame) -> DataFrame:
    """Counts and rates of new and other visitors for every day."""
    sums = [F.sum(name).alias(name) for name in VISITOR_COUNTERS]
    return with_rates(by_day(stats).groupBy("day", "is_new").agg(*sums))


def with_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "uj_rate": bounce_rate(F.col("uj_ct"), F.col("sv_ct")),
            "dur_per_sv": seconds_per_visit(F.col("dur_sum"), F.col("sv_ct")),
            "pv_per_sv": pages_per_visit(F.col("pv_ct"), F.col("sv_ct")),
        }
    )


def _side_totals(grouped: GroupedData) -> DataFrame:
    new = F.col("is_new").eqNullSafe("1")
    totals = [
        F.coalesce(F.sum(F.when(belongs, F.col(name))), F.lit(0)).alias(f"{side}_{name}")
        for side, belongs in (("new", new), ("old", ~new))
        for name in VISITOR_COUNTERS
    ]
    return grouped.agg(*totals)


def _side_rows() -> Column:
    """One struct per measure, with a column per side, from the totals of both sides."""

    def measures(side: str) -> list[Column]:
        def total(name: str) -> Column:
            return F.col(f"{side}_{name}")

        return [
            total("uv_ct"),
            total("pv_ct"),
            bounce_rate(total("uj_ct"), total("sv_ct")),
            seconds_per_visit(total("dur_sum"), total("sv_ct")),
            pages_per_visit(total("pv_ct"), total("sv_ct")),
        ]

    names = ["visitors", "pages", "bounce_rate", "seconds_per_visit", "pages_per_visit"]
    rows = [
        F.struct(F.lit(name).alias("type"), new_.cast("decimal(20,2)").alias("new"), old_.cast("decimal(20,2)").alias("old"))
        for name, new_, old_ in zip(names, measures("new"), measures("old"))
    ]
    return F.inline(F.array(*rows))


def visitor_rates(stats: DataFrame, date: int = 0) -> DataFrame:
    """New against old visitors: one row per measure, one column per side.

    Every flag other than ``'1'`` counts as old; a side without visitors shows zeros.
    """
    return _side_totals(on_day(stats, date).groupBy()).select(_side_rows())


def visitor_rates_by_day(stats: DataFrame) -> DataFrame:
    """``visitor_rates`` for every day that has visitors."""
    return _side_totals(by_day(stats).groupBy("day")).select("day", _side_rows())


def _per_hour(grouped: GroupedData) -> DataFrame:
    return grouped.agg(
        F.sum("uv_ct").alias("uv_ct"),
        F.sum("pv_ct").alias("pv_ct"),
        F.sum("uj_ct").alias("uj_ct"),
        F.sum(F.when(F.col("is_new") == "1", F.col("uv_ct")).otherwise(0)).alias("new_uv"),
    )


def _hours(spark: SparkSession) -> DataFrame:
    return spark.range(24).select(F.col("id").cast("int").alias("hr"))


def visitors_by_hour(stats: DataFrame, date: int = 0) -> DataFrame:
    """Visitors, pages, bounces and new visitors for each of the 24 hours, zero where none."""
    counted = _per_hour(on_day(stats, date).groupBy(F.hour("stt").alias("hr")))
    # At most 24 rows can match.
    full = _hours(stats.sparkSession).join(F.broadcast(counted), "hr", "left").na.fill(0)
    return full.withColumn("hour_label", F.format_string("%02d", "hr")).orderBy("hr")


def visitors_by_hour_and_day(stats: DataFrame) -> DataFrame:
    """``visitors_by_hour`` for every day that has visitors: 24 rows each."""
    counted = _per_hour(by_day(stats).groupBy("day", F.hour("stt").alias("hr")))
    every = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hr")
    full = counted.select("day").distinct().select("day", every).join(counted, ["day", "hr"], "left").na.fill(0)
    return full.withColumn("hour_label", F.format_string("%02d", "hr"))


def keyword_score(source: str = "source") -> Column:
    """Weight of a keyword hit by its source, in any letter case."""
    weight = F.lit(0)
    for name, value in KEYWORD_WEIGHTS.items():
        weight = F.when(F.upper(source) == name, value).otherwise(weight)
    return weight


def _scored(grouped: GroupedData) -> DataFrame:
    return grouped.agg(F.sum(F.col("ct") * keyword_score()).alias("score"), F.sum("ct").alias("count"))


def top_keywords_by_day(stats: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` keywords with the highest score of every day."""
    scored = _scored(by_day(stats).groupBy("day", "keyword"))
    top = _top(scored, [F.desc("score"), F.col("keyword")], limit, "day")
    return top.select("day", "keyword", F.col("score").alias("ct"))


def top_keywords(stats: DataFrame, date: int = 0, limit: int = 20, order_by: str = "score") -> DataFrame:
    """Keywords by weighted score; ``order_by='count'`` orders by the unweighted count instead."""
    if order_by not in ("score", "count"):
        raise ValueError(f"order_by must be score or count, not {order_by!r}")
    scored = _scored(on_day(stats, date).groupBy("keyword"))
    return _top(scored, [F.desc(order_by), F.col("keyword")], limit, None).select(
        "keyword", F.col("score").alias("ct")
    )
