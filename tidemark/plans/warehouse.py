"""The pipelines end to end: from the inputs to wide rows, facts and aggregate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.constants import APPRAISE_GOOD
from tidemark.functions.times import text_to_millis
from tidemark.operators import dims, facts, skew, stats, visits, wide
from tidemark.plans import inputs
from tidemark.session import scratch_path
from tidemark.sources import tables

SIX_HOURS_MS = 6 * 3_600_000
# One event in a median of seven hours per user: a bounce is judged over hours, not seconds.
BOUNCE_GAP_MS = SIX_HOURS_MS
BOUNCE_CHUNK_MS = 24 * 3_600_000
# A stream pays per chunk and visitor, and visitors here have few pages a day. A bounce leaves at its gap,
# however long the chunk is.
STREAM_CHUNK_MS = 10 * BOUNCE_CHUNK_MS
# Shuffled bytes of a task that splits keywords, and about how many times the searches' bytes a shuffle of them holds.
WORD_TASK_BYTES = 1 << 20
WORDS_PER_TEXT = 4


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.page_log(inputs.table(spark, sf_dir, "events"))


def unique_visits(page_log: DataFrame) -> DataFrame:
    return visits.unique_visits(page_log, [inputs.TIE])


def bounces(page_log: DataFrame) -> DataFrame:
    return visits.bounces(page_log, [inputs.TIE], BOUNCE_GAP_MS, BOUNCE_CHUNK_MS)


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visits.with_visit_marks(pages(spark, sf_dir), [inputs.TIE], BOUNCE_GAP_MS)


def visitor_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page, visit and bounce facts, from one pass over the events."""
    return facts.single_visitor_facts(marked_pages(spark, sf_dir))


def visitor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.visitor_stats(facts.marked_visitor_facts(marked_pages(spark, sf_dir)), window="1 hour")


def plain_order_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order rows with their details, without dimensions."""
    return wide.order_wide(orders(spark, sf_dir), details(spark, sf_dir))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.order_info(inputs.table(spark, sf_dir, "orders"))


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.order_detail(inputs.table(spark, sf_dir, "lineitem"))


def with_user(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    users = inputs.user_info(inputs.table(spark, sf_dir, "customer"))
    return dims.with_user(rows, users, inputs.AS_OF, counted=orders(spark, sf_dir))


def with_province(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    provinces = inputs.base_province(
        inputs.table(spark, sf_dir, "nation"), inputs.table(spark, sf_dir, "region")
    )
    return dims.with_province(rows, provinces)


def with_product(
    rows: DataFrame,
    spark: SparkSession,
    sf_dir: str,
    with_price: bool = False,
    counted: DataFrame | None = None,
) -> DataFrame:
    part = inputs.table(spark, sf_dir, "part")
    return dims.with_product(
        rows,
        inputs.sku_info(part),
        inputs.spu_info(part),
        inputs.base_trademark(part),
        inputs.base_category3(part),
        with_price,
        counted=counted,
    )


def order_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users join the orders, which are fewer and narrower than wide rows; provinces come after the last shuffle."""
    known = with_user(orders(spark, sf_dir), spark, sf_dir)
    rows = wide.order_wide(known, details(spark, sf_dir), keep=("user_age", "user_gender"))
    rows = with_product(rows, spark, sf_dir, counted=details(spark, sf_dir))
    return with_province(rows, spark, sf_dir)


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.payment_info(inputs.table(spark, sf_dir, "orders"))


def payment_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments join on the partitioning of the order join, before the dimensions make rows wide."""
    paid = wide.payment_wide(plain_order_wide(spark, sf_dir), payments(spark, sf_dir))
    return with_payment_dimensions(paid, spark, sf_dir)


def with_payment_dimensions(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions of wide payments that were joined without them."""
    return with_product(with_province(with_user(rows, spark, sf_dir), spark, sf_dir), spark, sf_dir)


def product_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven kinds of fact: one pass over the events, one over the order details.

    Details are joined to their orders and payments once, and each row gives the facts it stands for.
    """
    events = inputs.table(spark, sf_dir, "events")
    kind = F.col("event_type")
    marked = inputs.page_log(events, "event_type")
    second = F.floor(F.col("ts") / 1000) * 1000
    from_pages = facts.page_product_facts(
        marked, kind == "click", kind == "purchase", F.col("page.item"), second
    )
    lines = inputs.table(spark, sf_dir, "lineitem")
    from_orders = facts.exploded_facts(_paid_details(lines, spark, sf_dir), _order_fact_array())
    return facts.union_facts(from_pages, from_orders)


def _paid_details(lines: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detail with the times of its order and payment; null where there is none.

    Times and values are computed after the join, so that only the columns they come from are shuffled.
    """
    lines = lines.withColumn("order_id", F.col("l_orderkey"))
    ordered = orders(spark, sf_dir).select(F.col("id").alias("order_id"), text_to_millis("create_time").alias("order_ms"))
    paid = payments(spark, sf_dir).select("order_id", text_to_millis("create_time").alias("paid_ms"))
    joined = lines.join(ordered.join(paid, "order_id", "left"), "order_id", "left")
    return inputs.order_detail_facts(joined, "order_ms", "paid_ms")


def _order_fact_array() -> Column:
    """The facts of one detail row: its order and payment if they lie in their bands, refund and comment."""
    amount, order_id, sku = F.col("split_total_amount"), F.col("order_id"), F.col("sku_id")
    near = (F.col("detail_ms") - F.col("order_ms")).between(-5_000, 5_000)
    in_time = near & (F.col("paid_ms") - F.col("order_ms")).between(-5_000, 900_000)
    order = facts.product_fact(
        "order", sku, F.col("order_ms"), order_id, order_sku_num=F.col("sku_num"), order_amount=amount
    )
    payment = facts.product_fact("payment", sku, F.col("paid_ms"), order_id, payment_amount=amount)
    refund = facts.product_fact("refund", sku, F.col("refund_ms"), order_id, refund_amount=F.col("refund_amount"))
    good = F.when(F.col("appraise") == APPRAISE_GOOD, 1).otherwise(0)
    comment = facts.product_fact(
        "comment", sku, F.col("comment_ms"), comment_ct=F.lit(1), good_comment_ct=good
    )
    return F.array(
        F.when(near, order),
        F.when(in_time, payment),
        F.when(F.col("refund_ms").isNotNull(), refund),
        F.when(F.col("comment_ms").isNotNull(), comment),
    )


def product_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All product measures per day; dimensions join the aggregate, not the facts."""
    daily = stats.product_stats(product_facts(spark, sf_dir), window="1 day")
    return with_product(daily, spark, sf_dir, with_price=True)


def sales_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order measures of ``product_stats``, all that the sales reports read."""
    sold = facts.order_facts(plain_order_wide(spark, sf_dir))
    return with_product(stats.product_stats(sold, window="1 day"), spark, sf_dir, with_price=True)


def stored_by_day(stats_rows: DataFrame, label: str) -> DataFrame:
    """An aggregate written once, by day, and read back: a report on it reads only its days' files."""
    spark = stats_rows.sparkSession
    path = scratch_path(spark, label)
    with skew.small_tasks(spark):
        tables.write_stats(stats_rows, path)
    return tables.read_versions(spark, path).drop("batch_id")


def stored_words(words: DataFrame, searches: DataFrame) -> DataFrame:
    """The words of a lateral join with ``searches``, written once in small tasks and read back.

    Spark joins the words of a keyword to its searches by the keyword, so every word is shuffled and sorted beside
    the whole text it is from: a task sorts many times the bytes it read.
    """
    spark = words.sparkSession
    path = scratch_path(spark, "words")
    with skew.small_tasks(spark, WORD_TASK_BYTES, WORDS_PER_TEXT * skew.estimated_bytes(searches)):
        words.write.parquet(path)
    return spark.read.schema(words.schema).parquet(path)


def stored_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_by_day(sales_stats(spark, sf_dir), "sales")


def stored_provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_by_day(province_stats(spark, sf_dir), "provinces")


def stored_visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_by_day(visitor_stats(spark, sf_dir), "visitors")


def province_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_province(plain_order_wide(spark, sf_dir), spark, sf_dir)
    return stats.province_stats(rows, window="1 day")
