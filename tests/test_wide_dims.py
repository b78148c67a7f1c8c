import datetime

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.times import age_years
from tidemark.operators import dims, skew, wide


def at(millis):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=millis)


def test_both_ends_of_the_band_match(spark):
    left = spark.createDataFrame([(1, at(0))], "k bigint, a timestamp")
    right = spark.createDataFrame(
        [(1, at(-5000), "x"), (1, at(5000), "y"), (1, at(5001), "z"), (2, at(0), "other")],
        "k bigint, b timestamp, name string",
    )
    joined = wide.interval_join(left, right, "k", "a", "b", "-5 seconds", "5 seconds")
    assert sorted(r.name for r in joined.collect()) == ["x", "y"]


def order(spark, seconds=0):
    time = (datetime.datetime(2024, 1, 1, 9) + datetime.timedelta(seconds=seconds)).strftime("%Y-%m-%d %H:%M:%S")
    return spark.createDataFrame(
        [(1, 3, "1001", 7, 30, 0, 0, 30, 5, None, time, None)], "id int, province_id int, order_status string, "
        "user_id int, total_amount int, activity_reduce_amount int, coupon_reduce_amount int, "
        "original_total_amount int, feight_fee int, expire_time string, create_time string, operate_time string",
    )


def details(spark):
    return spark.createDataFrame(
        [(n, 1, 100 + n, 10, 2, "given", f"2024-01-01 09:00:0{n}", 20, 1, 1) for n in (1, 2, 9)],
        "id int, order_id int, sku_id int, order_price int, sku_num int, sku_name string, create_time string, "
        "split_total_amount int, split_activity_amount int, split_coupon_amount int",
    )


def payments(spark, *times):
    return spark.createDataFrame(
        [(50 + n, 1, 8, 99, "subject", "1101", time, None) for n, time in enumerate(times)],
        "id int, order_id int, user_id int, total_amount int, subject string, payment_type string, "
        "create_time string, callback_time string",
    )


def test_order_wide_takes_details_near_their_order(spark):
    rows = wide.order_wide(order(spark), details(spark)).collect()
    assert sorted(r.detail_id for r in rows) == [1, 2]
    assert {(r.create_date, r.create_hour, r.order_status) for r in rows} == {("2024-01-01", "09", "1001")}


def test_payment_wide_has_one_row_per_detail_and_the_payments_values(spark):
    orders = wide.order_wide(order(spark), details(spark))
    paid = wide.payment_wide(orders, payments(spark, "2024-01-01 09:15:00", "2024-01-01 08:59:55",
                                              "2024-01-01 09:15:01", "2024-01-01 08:59:54"))
    rows = paid.collect()
    assert sorted((r.payment_id, r.detail_id) for r in rows) == [(50, 1), (50, 2), (51, 1), (51, 2)]
    assert {(r.user_id, r.total_amount, r.order_create_time) for r in rows} == {(8, 99, "2024-01-01 09:00:00")}
    assert {r.payment_create_time for r in rows} == {"2024-01-01 09:15:00", "2024-01-01 08:59:55"}


def test_payment_band_is_exact_to_the_millisecond(spark):
    left = spark.createDataFrame([(1, at(0))], "k bigint, a timestamp")
    right = spark.createDataFrame([(1, at(900_000)), (1, at(900_001))], "k bigint, b timestamp")
    assert wide.interval_join(left, right, "k", "a", "b", "-5 seconds", "15 minutes").count() == 1


def test_fill_from_repeats_no_row(spark):
    own = spark.createDataFrame([(1, None), (2, "x")], "order_id int, order_status string")
    other = spark.createDataFrame([(1, "b"), (1, "a"), (1, None)], "order_id int, order_status string")
    assert sorted(map(tuple, wide.fill_from(own, other, ["order_id"]).collect())) == [(1, "a"), (2, "x")]


def test_fill_from_keeps_own_values(spark):
    schema = "order_id int, order_status string, sku_name string, split_total_amount int"
    own = spark.createDataFrame([(1, None, "a", None), (2, "x", "b", 3)], schema)
    other = spark.createDataFrame([(1, "o", "z", 9)], schema)
    filled = wide.fill_from(own, other, ["order_id"])
    assert sorted(map(tuple, filled.collect())) == [(1, "o", "a", None), (2, "x", "b", 3)]


@pytest.fixture
def skewed(spark):
    many = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("k"), "id"
    )
    one = spark.range(800).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    return many, one


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_spreading_a_hot_key_does_not_change_the_join(spark, skewed, how, hot_rows):
    many, one = skewed
    spread = skew.spread_join(many, one, ["k"], how, hot_rows=hot_rows)
    assert rows_of(spread) == rows_of(many.join(one, "k", how))


def test_a_hot_key_reaches_several_tasks(spark, skewed):
    many, one = skewed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = skew.spread_join(many, one, ["k"], hot_rows=10).where("k = 0")
        assert joined.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hot_keys_are_few(spark, skewed):
    many, _ = skewed
    assert [r.k for r in skew.hot_keys(many, ["k"], 10).collect()] == [0]


def test_spread_join_takes_maps(spark):
    many = spark.createDataFrame([(1, {"a": "b"})] * 4, "k int, m map<string,string>")
    one = spark.createDataFrame([(1, "x")], "k int, v string")
    assert skew.spread_join(many, one, ["k"], hot_rows=1).count() == 4


def test_enrich_drops_or_keeps_unknown_keys(spark):
    facts = spark.createDataFrame([(1, "old"), (9, "old")], "sku_id bigint, sku_name string")
    dim = spark.createDataFrame([("1", "new")], "id string, sku_name string")
    inner = dims.enrich(facts, dim, "sku_id", {"sku_name": "sku_name"})
    left = dims.enrich(facts, dim, "sku_id", {"sku_name": "sku_name"}, how="left")
    assert [tuple(r) for r in inner.collect()] == [(1, "new")]
    assert sorted(map(tuple, left.collect())) == [(1, "new"), (9, None)]


def test_age_is_days_over_365(spark):
    row = spark.createDataFrame([("1990-12-17",)], "birthday string")
    age = row.select(age_years("birthday", F.lit(datetime.date(2021, 12, 16))).alias("age"))
    assert age.first().age == 31


def test_products_do_not_depend_on_the_way_they_are_joined(spark, scratch, monkeypatch):
    def stored(rows, schema):
        path = scratch("dim")
        spark.createDataFrame(rows, schema).write.parquet(path)
        return spark.read.parquet(path)

    facts = stored([(n,) for n in (1, 2, 3, 9)], "sku_id bigint")
    tables = [
        stored([(str(n), f"s{n}", "9.5", str(n % 2), "5", "6") for n in (1, 2, 3)],
               "id string, sku_name string, price string, spu_id string, tm_id string, category3_id string"),
        stored([("0", "even"), ("1", "odd")], "id string, spu_name string"),
        stored([("5", "brand")], "id string, tm_name string"),
        stored([("6", "category")], "id string, name string"),
    ]
    small = dims.with_product(facts, *tables, with_price=True)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        large = dims.with_product(facts, *tables, with_price=True)
        assert "Broadcast" not in large._jdf.queryExecution().executedPlan().toString().split("is_hot")[0]
        assert rows_of(large) == rows_of(small)
        assert large.count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_schemas_are_valid(spark):
    for name in ("LOG", "CHANGE", "RULE", "ORDER_INFO", "ORDER_DETAIL", "PAYMENT_INFO", "SENSOR"):
        assert spark.createDataFrame([], getattr(schemas, name)).count() == 0


def test_hot_keys_may_be_counted_on_another_table(spark, skewed):
    many, one = skewed
    joined = many.withColumn("w", F.col("id") + 1).where("id > 5")
    spread = skew.spread_join(joined, one, ["k"], hot_rows=10, counted=many.select("k"))
    assert rows_of(spread) == rows_of(joined.join(one, "k"))


def test_salts_follow_from_the_count(spark, skewed):
    many, _ = skewed
    assert [(r.k, r.salts) for r in skew.hot_keys(many, ["k"], 10).collect()] == [(0, 30)]
    assert [(r.k, r.salts) for r in skew.hot_keys(many, ["k"], 100).collect()] == [(0, 3)]


def test_small_lookups_are_broadcast_whatever_their_estimate(spark, skewed):
    many, one = skewed
    few = one.groupBy((F.col("k") % 6).alias("k")).agg(F.max("v").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = skew.lookup_join(many, few, ["k"])._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_lookup_beyond_the_broadcast_size_is_spread(spark, skewed, how, monkeypatch):
    many, one = skewed
    expected = rows_of(many.join(one, "k", how))
    monkeypatch.setattr(skew, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        spread = skew.lookup_join(many, one, ["k"], how, counted=many)
        assert "salt" in spread._jdf.queryExecution().optimizedPlan().toString()
        assert rows_of(spread) == expected
        assert rows_of(skew.lookup_join(many, one, ["k"], how)) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
