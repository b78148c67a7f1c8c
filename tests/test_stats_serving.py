import datetime
from decimal import Decimal

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tidemark.functions.rates import bounce_rate, pages_per_visit, seconds_per_visit
from tidemark.operators import facts, serving, stats
from tidemark.sources import tables

T0 = "2024-01-01 00:00:0"


def refunds(spark, rows):
    return spark.createDataFrame(rows, "sku_id bigint, order_id bigint, refund_amount decimal(18,2), create_time string")


def orders(spark, rows):
    return spark.createDataFrame(
        rows, "sku_id bigint, order_id bigint, sku_num bigint, split_total_amount decimal(18,2), create_time string"
    )


def money(text):
    return None if text is None else Decimal(text)


def test_one_order_is_counted_once_per_window(spark):
    sold = orders(spark, [(7, 1, 2, money("1.50"), T0 + "1"), (7, 1, 3, money("2.25"), T0 + "9"),
                          (7, 2, 1, None, T0 + "2"), (7, 1, 1, money("9"), "2024-01-01 00:00:10")])
    rows = stats.product_stats(facts.order_facts(sold)).orderBy("stt").collect()
    assert [(r.order_ct, r.order_sku_num, r.order_amount) for r in rows] == [(2, 6, money("3.75")), (1, 1, money("9.00"))]
    assert rows[0].ts == 1704067201000 and rows[0].edt - rows[0].stt == datetime.timedelta(seconds=10)


def test_orders_payments_and_refunds_are_counted_apart(spark):
    sold = facts.order_facts(orders(spark, [(7, 1, 1, money("5"), T0 + "1"), (7, 2, 1, money("5"), T0 + "1")]))
    back = facts.refund_facts(refunds(spark, [(7, 1, money("2"), T0 + "1"), (7, 1, money("2"), T0 + "2")]))
    paid = facts.payment_facts(
        orders(spark, [(7, 2, 1, money("5"), T0 + "1")]).withColumnRenamed("create_time", "payment_create_time")
    )
    row = stats.product_stats(facts.union_facts(sold, back, paid)).first()
    assert (row.order_ct, row.paid_order_ct, row.refund_order_ct) == (2, 1, 1)
    assert (row.order_amount, row.payment_amount, row.refund_amount) == (money("10"), money("5"), money("4"))


def test_click_display_favor_cart_and_comment_facts(spark):
    pages = spark.createDataFrame(
        [
            ({"page_id": "good_detail", "item_type": "sku_id", "item": "4"},
             [{"item": "8", "item_type": "sku_id"}, {"item": "9", "item_type": "activity_id"}], 1000),
            ({"page_id": "good_detail", "item_type": "keyword", "item": "4"}, None, 1000),
            ({"page_id": "home", "item_type": "sku_id", "item": "4"}, [], 1000),
        ],
        "page struct<page_id:string,item_type:string,item:string>, "
        "displays array<struct<item:string,item_type:string>>, ts bigint",
    )
    assert [(r.sku_id, r.click_ct) for r in facts.click_facts(pages).collect()] == [(4, 1)]
    assert [(r.sku_id, r.display_ct) for r in facts.display_facts(pages).collect()] == [(8, 1)]
    marks = spark.createDataFrame([(5, T0 + "1", "1201"), (5, T0 + "1", None)],
                                  "sku_id bigint, create_time string, appraise string")
    assert [r.favor_ct for r in facts.favor_facts(marks).collect()] == [1, 1]
    assert [r.cart_ct for r in facts.cart_facts(marks).collect()] == [1, 1]
    assert [(r.comment_ct, r.good_comment_ct) for r in facts.comment_facts(marks).collect()] == [(1, 1), (1, 0)]


def test_visitor_stats_union_and_text_bounds(spark, pages):
    log = pages([(1, "a", 1000, None, "0"), (2, "a", 2000, "home", "0"), (3, "a", 11000, "home", "0")])
    union = facts.union_facts(facts.page_facts(log), facts.visit_facts(log.limit(1)), facts.bounce_facts(log.limit(1)))
    rows = stats.format_bounds(stats.visitor_stats(union)).orderBy("stt").collect()
    assert [(r.uv_ct, r.pv_ct, r.sv_ct, r.uj_ct, r.dur_sum, r.ts) for r in rows] == [
        (1, 2, 1, 1, 200, 1000), (0, 1, 0, 0, 100, 11000)]
    assert (rows[0].stt, rows[0].edt) == ("1970-01-01 00:00:00", "1970-01-01 00:00:10")


def province_rows(spark):
    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(1, "p", "a", "i", "j", 5, money("12.56"), at), (1, "p", "a", "i", "j", 5, money("1.00"), at),
         (1, "p", "a", "i", "j", 6, None, at)],
        "province_id bigint, province_name string, province_area_code string, province_iso_code string, "
        "province_3166_2_code string, order_id bigint, split_total_amount decimal(18,2), rt timestamp",
    )


def test_province_stats_keep_cents(spark):
    row = stats.province_stats(province_rows(spark)).first()
    assert (row.order_count, row.order_amount) == (2, money("13.56"))
    assert [r.order_count for r in facts.province_facts(province_rows(spark)).collect()] == [1, 1, 1]
    assert stats.stamp_now(stats.province_stats(province_rows(spark))).first().ts > 1_700_000_000_000


def test_rates(spark):
    def rate(function, a, b):
        row = spark.createDataFrame([(a, b)], "a bigint, b bigint")
        return row.select(function(F.col("a"), F.col("b"))).first()[0]

    assert rate(bounce_rate, 1, 0) == 0
    assert rate(bounce_rate, 1, 3) == money("33.33") and rate(bounce_rate, 1, 800) == money("0.13")
    assert rate(seconds_per_visit, 12549, 5) == money("2.5")
    assert rate(seconds_per_visit, 12746, 5) == money("2.5")  # 2549.2 -> 2549 -> 2.5
    assert rate(pages_per_visit, 5, 8) == money("0.63")


def visitor_table(spark, rows):
    return spark.createDataFrame(
        rows, "stt timestamp, is_new string, uv_ct bigint, pv_ct bigint, sv_ct bigint, uj_ct bigint, dur_sum bigint"
    )


def hour(number, day=15):
    return datetime.datetime(2024, 1, day, number)


def test_visitors_by_hour_has_24_rows(spark):
    table = visitor_table(spark, [(hour(3), "1", 2, 5, 1, 1, 0), (hour(3), "0", 1, 5, 1, 1, 0),
                                  (hour(17), "0", 4, 1, 1, 0, 0), (hour(17, 16), "0", 9, 9, 9, 9, 9)])
    rows = serving.visitors_by_hour(table, 20240115).collect()
    assert len(rows) == 24 and sum(r.uv_ct == 0 for r in rows) == 22
    assert (rows[3].hour_label, rows[3].uv_ct, rows[3].new_uv) == ("03", 3, 2)


def test_visitor_rates_shows_zeros_for_a_missing_side(spark):
    table = visitor_table(spark, [(hour(3), "1", 2, 6, 4, 1, 10000), (hour(4), "x", 1, 1, 0, 0, 0)])
    rows = {r.type: (r.new, r.old) for r in serving.visitor_rates(table, 20240115).collect()}
    assert rows["visitors"] == (2, 1) and rows["bounce_rate"] == (25, 0)
    assert rows["seconds_per_visit"] == (money("2.5"), 0) and rows["pages_per_visit"] == (money("1.5"), 0)
    empty = {r.type: (r.new, r.old) for r in serving.visitor_rates(table, 20240201).collect()}
    assert set(empty.values()) == {(0, 0)} and len(empty) == 5
    flags = {r.is_new: r.pv_ct for r in serving.visitors_by_flag(table, 20240115).collect()}
    assert flags == {"1": 6, "x": 1}


def product_table(spark):
    return spark.createDataFrame(
        [(hour(1), 1, "one", money("5"), 2), (hour(2), 1, "one", money("6"), 1), (hour(2), 2, "two", money("11"), 9),
         (hour(2), 3, "three", money("0"), 1), (hour(2, 16), 4, "four", money("99"), 1)],
        "stt timestamp, tm_id bigint, tm_name string, order_amount decimal(18,2), order_ct bigint",
    )


def test_top_products(spark):
    table = product_table(spark)
    assert serving.gmv(table, 20240115).first().gmv == 22
    rows = serving.top_trademarks(table, 20240115).collect()
    assert [(r.tm_name, r.order_amount) for r in rows] == [("one", 11), ("two", 11)]  # none that sold nothing
    assert [r.tm_id for r in serving.top_trademarks(table, 20240115, limit=1).collect()] == [1]
    daily = serving.top_products(serving.by_day(table), serving.BY_TRADEMARK, 1, day="day")
    assert sorted((r.day.day, r.tm_id) for r in daily.collect()) == [(15, 1), (16, 4)]
    assert {r.day.day: r.gmv for r in serving.gmv_by_day(table).collect()} == {15: 22, 16: 99}


def test_day_zero_is_today(spark):
    now = spark.range(1).select(F.current_timestamp().alias("stt"), F.lit(3).alias("order_amount"))
    assert serving.gmv(now).first().gmv == 3


def test_a_stored_table_is_read_for_the_one_day(spark, scratch):
    path = scratch("stats")
    table = product_table(spark).withColumns({"edt": F.col("stt"), "ts": F.lit(1)})
    tables.write_stats(table, path, version=0)
    tables.write_stats(table.where("tm_id = 2").withColumns({"ts": F.lit(2), "order_amount": F.lit(money("20"))}), path, 1)
    newest = tables.newest_versions(tables.read_versions(spark, path), ["tm_id"])
    report = serving.gmv(newest, 20240115)
    assert report.first().gmv == 31
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "dt#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_keyword_score(spark):
    table = spark.createDataFrame(
        [(hour(1), "a", "search", 1), (hour(1), "a", "ORDER", 1), (hour(2), "a", "other", 1), (hour(1), "b", "click", 5),
         (hour(1), "c", "cart", 2)],
        "stt timestamp, keyword string, source string, ct bigint",
    )
    assert [tuple(r) for r in serving.top_keywords(table, 20240115).collect()] == [("a", 13), ("b", 5), ("c", 4)]
    counted = serving.top_keywords(table, 20240115, limit=2, order_by="count")
    assert [tuple(r) for r in counted.collect()] == [("b", 5), ("a", 13)]
    with pytest.raises(ValueError):
        serving.top_keywords(table, 20240115, order_by="name")


def test_reducing_before_the_shuffle(spark):
    """A best-selling sku is reduced on the map side and spread over its orders."""
    sold = orders(spark, [(7, n, 1, money("1"), T0 + "1") for n in range(50)])
    plan = stats.product_stats(facts.order_facts(sold))._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Expand" not in plan and "collect" not in plan
    assert rows_of(stats.product_stats(facts.order_facts(sold)).select("order_ct")) == ["(50,)"]
