"""Facts of one shape for the subject aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import APPRAISE_GOOD
from tidemark.functions.times import millis_to_time, text_to_millis
from tidemark.operators.logs import is_entry_page
from tidemark.schemas import MONEY

PRODUCT_COUNTERS = [
    "display_ct",
    "click_ct",
    "favor_ct",
    "cart_ct",
    "order_sku_num",
    "comment_ct",
    "good_comment_ct",
]
PRODUCT_AMOUNTS = ["order_amount", "payment_amount", "refund_amount"]
VISITOR_COUNTERS = ["uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum"]


def _product_fact(rows: DataFrame, kind: str, millis: Column, order_id: Column | None = None, **measures) -> DataFrame:
    """One fact row per input row; measures not given are 0."""
    zero_money = F.lit(0).cast(MONEY)
    return rows.select(
        F.lit(kind).alias("fact"),
        F.col("sku_id").cast("bigint").alias("sku_id"),
        (F.lit(None) if order_id is None else order_id).cast("bigint").alias("order_id"),
        *[measures.get(name, F.lit(0)).cast("bigint").alias(name) for name in PRODUCT_COUNTERS],
        *[F.coalesce(measures.get(name, zero_money).cast(MONEY), zero_money).alias(name) for name in PRODUCT_AMOUNTS],
        millis.alias("ts"),
        millis_to_time(millis).alias("rt"),
    )


def click_facts(pages: DataFrame) -> DataFrame:
    clicks = pages.where((F.col("page.page_id") == "good_detail") & (F.col("page.item_type") == "sku_id"))
    clicks = clicks.select(F.col("page.item").try_cast("bigint").alias("sku_id"), "ts")
    return _product_fact(clicks, "click", F.col("ts"), click_ct=F.lit(1))


def display_facts(pages: DataFrame) -> DataFrame:
    shown = pages.select(F.explode("displays").alias("display"), "ts").where(F.col("display.item_type") == "sku_id")
    shown = shown.select(F.col("display.item").try_cast("bigint").alias("sku_id"), "ts")
    return _product_fact(shown, "display", F.col("ts"), display_ct=F.lit(1))


def favor_facts(favors: DataFrame) -> DataFrame:
    return _product_fact(favors, "favor", text_to_millis("create_time"), favor_ct=F.lit(1))


def cart_facts(carts: DataFrame) -> DataFrame:
    return _product_fact(carts, "cart", text_to_millis("create_time"), cart_ct=F.lit(1))


def order_facts(wide: DataFrame) -> DataFrame:
    return _product_fact(
        wide,
        "order",
        text_to_millis("create_time"),
        F.col("order_id"),
        order_sku_num=F.col("sku_num"),
        order_amount=F.col("split_total_amount"),
    )


def payment_facts(paid: DataFrame) -> DataFrame:
    return _product_fact(
        paid,
        "payment",
        text_to_millis("payment_create_time"),
        F.col("order_id"),
        payment_amount=F.col("split_total_amount"),
    )


def refund_facts(refunds: DataFrame) -> DataFrame:
    return _product_fact(
        refunds,
        "refund",
        text_to_millis("create_time"),
        F.col("order_id"),
        refund_amount=F.col("refund_amount"),
    )


def comment_facts(comments: DataFrame) -> DataFrame:
    good = F.when(F.col("appraise") == APPRAISE_GOOD, 1).otherwise(0)
    return _product_fact(
        comments, "comment", text_to_millis("create_time"), comment_ct=F.lit(1), good_comment_ct=good
    )


def product_fact(kind: str, sku_id: Column, millis: Column, order_id: Column | None = None, **measures) -> Column:
    """One fact as a struct, for rows that give several; the fields are those of the single facts."""
    zero_money = F.lit(0).cast(MONEY)
    return F.struct(
        F.lit(kind).alias("fact"),
        sku_id.try_cast("bigint").alias("sku_id"),
        (F.lit(None) if order_id is None else order_id).cast("bigint").alias("order_id"),
        *[measures.get(name, F.lit(0)).cast("bigint").alias(name) for name in PRODUCT_COUNTERS],
        *[F.coalesce(measures.get(name, zero_money).cast(MONEY), zero_money).alias(name) for name in PRODUCT_AMOUNTS],
        millis.alias("ts"),
    )


def exploded_facts(rows: DataFrame, facts: Column) -> DataFrame:
    """One row per struct of the array ``facts``; nulls in it are no facts."""
    found = rows.select(F.explode(facts).alias("one")).where(F.col("one").isNotNull()).select("one.*")
    return found.withColumn("rt", millis_to_time("ts"))


def page_product_facts(pages: DataFrame, favor: Column, cart: Column, sku_id: Column, second: Column) -> DataFrame:
    """Clicks, displays, favors and carts in one pass over the pages.

    ``favor`` and ``cart`` say which pages stand for one; these facts have ``sku_id`` and the time
    ``second`` in milliseconds.
    """
    clicked = (F.col("page.page_id") == "good_detail") & (F.col("page.item_type") == "sku_id")
    click = F.when(clicked, product_fact("click", F.col("page.item"), F.col("ts"), click_ct=F.lit(1)))
    shown = F.transform(
        F.filter(F.coalesce("displays", F.array()), lambda display: display["item_type"] == "sku_id"),
        lambda display: product_fact("display", display["item"], F.col("ts"), display_ct=F.lit(1)),
    )
    marked = [
        F.when(favor, product_fact("favor", sku_id, second, favor_ct=F.lit(1))),
        F.when(cart, product_fact("cart", sku_id, second, cart_ct=F.lit(1))),
    ]
    return exploded_facts(pages, F.concat(F.array(click, *marked), shown))


def marked_visitor_facts(marked: DataFrame) -> DataFrame:
    """One visitor fact per page from ``visits.with_visit_marks``, with its visit and bounce counted on it."""
    entry = F.when(is_entry_page(), 1).otherwise(0)
    return _visitor_fact(
        marked,
        pv_ct=F.lit(1),
        sv_ct=entry,
        dur_sum=F.col("page.during_time"),
        uv_ct=F.col("is_visit").cast("int"),
        uj_ct=F.col("is_bounce").cast("int"),
    )


def single_visitor_facts(marked: DataFrame) -> DataFrame:
    """The same as separate facts per page, visit and bounce, as the union of the three streams has them."""
    together = marked_visitor_facts(marked)
    zeros = {name: F.lit(0).cast("bigint") for name in VISITOR_COUNTERS}

    def fact(**kept: Column) -> Column:
        values = {**zeros, **kept}
        return F.struct(*[values.get(name, F.col(name)).alias(name) for name in together.columns])

    page = fact(pv_ct=F.col("pv_ct"), sv_ct=F.col("sv_ct"), dur_sum=F.col("dur_sum"))
    visit = F.when(F.col("uv_ct") == 1, fact(uv_ct=F.col("uv_ct")))
    bounce = F.when(F.col("uj_ct") == 1, fact(uj_ct=F.col("uj_ct")))
    found = together.select(F.explode(F.array(page, visit, bounce)).alias("one"))
    return found.where(F.col("one").isNotNull()).select("one.*")


def union_facts(*facts: DataFrame) -> DataFrame:
    """All facts together; duplicates stay."""
    return reduce(DataFrame.unionByName, facts)


def _visitor_fact(rows: DataFrame, **measures: Column) -> DataFrame:
    return rows.select(
        *[F.col(f"common.{name}").alias(name) for name in ("vc", "ch", "ar", "is_new")],
        *[F.coalesce(measures.get(name, F.lit(0)), F.lit(0)).cast("bigint").alias(name) for name in VISITOR_COUNTERS],
        "ts",
        millis_to_time("ts").alias("rt"),
    )


def page_facts(pages: DataFrame) -> DataFrame:
    entry = F.when(is_entry_page(), 1).otherwise(0)
    return _visitor_fact(pages, pv_ct=F.lit(1), sv_ct=entry, dur_sum=F.col("page.during_time"))


def visit_facts(visits: DataFrame) -> DataFrame:
    return _visitor_fact(visits, uv_ct=F.lit(1))


def bounce_facts(bounced: DataFrame) -> DataFrame:
    return _visitor_fact(bounced, uj_ct=F.lit(1))


def province_facts(wide: DataFrame) -> DataFrame:
    """Wide order rows as province rows that count one order each, stamped with the current time."""
    return wide.select(
        "province_id",
        "province_name",
        "province_area_code",
        "province_iso_code",
        "province_3166_2_code",
        F.col("split_total_amount").alias("order_amount"),
        F.lit(1).cast("bigint").alias("order_count"),
        F.unix_millis(F.current_timestamp()).alias("ts"),
    )
