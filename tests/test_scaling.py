"""What keeps the cost of streams, tasks and shuffles in proportion to the input."""

import glob
import os

import pytest
from conftest import ids, rows_of
from pyspark.sql import functions as F
from test_logs_visits import random_pages
from test_streams import closing, in_order, real, trade

from tidemark.operators import facts, keywords, logs, skew, stats, visits, wide
from tidemark.plans import catalog, inputs, replay, warehouse
from tidemark.sources.tables import batch_writer
from tidemark.streaming import jobs, processors

PARTITIONS = "spark.sql.shuffle.partitions"


def test_state_partitions_follow_the_cores_and_the_size(spark, monkeypatch):
    held = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, "200")
    try:
        chain = replay.Replay(spark)
        chain.source(spark.range(1000).toDF("id"), F.lit(0))
        assert chain.state_partitions() == spark.sparkContext.defaultParallelism
        monkeypatch.setattr(replay, "STATE_BYTES", 10)
        assert chain.state_partitions() >= 400
    finally:
        spark.conf.set(PARTITIONS, held)


def test_a_stream_keeps_its_own_number_of_partitions(spark, pages, stream_of, scratch):
    held, checkpoint, path = spark.conf.get(PARTITIONS), scratch("checkpoint"), scratch("found")
    stream = processors.bounces_stream(stream_of(pages([(1, "a", 1000, None, "0")]), pages([closing(-1)])), "event_id")
    jobs.run_available(stream, lambda rows, n: rows.write.mode("append").parquet(path), checkpoint, partitions=2)
    assert ids(real(spark.read.parquet(path))) == [1]
    assert sorted(name for name in os.listdir(f"{checkpoint}/state/0") if name.isdigit()) == ["0", "1"]
    assert spark.conf.get(PARTITIONS) == held


@pytest.mark.parametrize("kind", ["flag", "visit", "bounce"])
def test_all_visitors_in_one_group(spark, pages, stream_of, scratch, kind):
    rows = random_pages(300, 8, 200_000, 5)
    stream = stream_of(*[pages(part) for part in in_order(rows, 2)], pages([closing(-1)]))
    batch = pages(rows)
    if kind == "flag":
        found, wanted = processors.repair_new_flag_stream(stream, "event_id", groups=1), logs.repair_new_flag(batch, ["event_id"])
    elif kind == "visit":
        found, wanted = processors.unique_visits_stream(stream, "event_id", groups=1), visits.unique_visits(batch, ["event_id"])
    else:
        found = processors.bounces_stream(stream, "event_id", 10_000, 20_000, groups=1)
        wanted = visits.bounces(batch, ["event_id"], 10_000)
    path = scratch("found")
    jobs.run_to_table(found, path, scratch("checkpoint"))
    assert rows_of(real(spark.read.parquet(path)).drop("batch_id")) == rows_of(wanted)


def test_the_size_of_a_join_is_that_of_its_tables(spark):
    rows = spark.range(1000)
    many = rows.join(rows.withColumnRenamed("id", "other"), F.expr("id % 7 = other % 5"))
    assert skew.read_bytes(many) == 2 * skew.read_bytes(rows) < skew.estimated_bytes(many)


def test_small_tasks_only_within(spark):
    held = spark.conf.get(skew.TASK_SETTING)
    with skew.small_tasks(spark):
        assert spark.conf.get(skew.TASK_SETTING) == f"{skew.TASK_BYTES}b"
    assert spark.conf.get(skew.TASK_SETTING) == held
    spark.conf.set(skew.TASK_SETTING, "1m")
    try:
        with skew.small_tasks(spark):
            assert spark.conf.get(skew.TASK_SETTING) == "1m"
    finally:
        spark.conf.set(skew.TASK_SETTING, held)


def test_small_tasks_ask_for_partitions_by_size(spark):
    held = spark.conf.get(skew.PARTITIONS_SETTING)
    with skew.small_tasks(spark, 1 << 20, (int(held) + 3) << 20):
        assert spark.conf.get(skew.PARTITIONS_SETTING) == str(int(held) + 3)
        assert spark.conf.get(skew.TASK_SETTING) == f"{1 << 20}b"
        with skew.small_tasks(spark, 1 << 20, 1 << 20):
            assert spark.conf.get(skew.PARTITIONS_SETTING) == str(int(held) + 3)
    with skew.small_tasks(spark, 1, 1 << 60):
        assert spark.conf.get(skew.PARTITIONS_SETTING) == str(skew.MOST_PARTITIONS)
    assert spark.conf.get(skew.PARTITIONS_SETTING) == held


@pytest.mark.parametrize("name", ["sql_keyword_dictionary", "sql_keyword_split"])
def test_words_of_a_lateral_join_are_made_in_small_tasks(spark, scratch, monkeypatch, name):
    folder = scratch("tables")
    turns = [(i, 0, "user", f"red shoes {i}" if i % 3 else f"tea, tea {i % 2}") for i in range(40)]
    turns += [(1, 1, "user", "?!"), (1, 2, "user", "?!"), (1, 3, "user", None), (1, 4, "assistant", "red")]
    turns = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    turns.coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    benchmark = spark.createDataFrame([(0, "red ed shoes tea")], "item_id bigint, text string")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    monkeypatch.setattr(warehouse, "WORD_TASK_BYTES", 64)
    coalescing = "spark.sql.adaptive.coalescePartitions.enabled"
    held, parts = spark.conf.get(coalescing), int(spark.conf.get(skew.PARTITIONS_SETTING))
    spark.conf.set(coalescing, "false")
    try:
        found = catalog.QUERIES[name](spark, folder)
        assert len(found.inputFiles()) > parts
    finally:
        spark.conf.set(coalescing, held)
    runs = (inputs.LETTER_RUNS, inputs.DIGIT_RUNS) if name == "sql_keyword_dictionary" else ()
    searches = keywords.search_keywords(inputs.search_pages(turns))
    wanted = keywords.split_keywords(searches, "keyword", inputs.dictionary(benchmark), *runs).select("ts", "word")
    assert found.columns == wanted.columns and rows_of(found) == rows_of(wanted)
    assert sorted(r.word for r in found.where("word = '?!'").collect()) == ["?!", "?!"]


def test_columns_joined_to_orders_before_their_details(spark):
    orders, details, _ = trade(spark, 5)
    found = wide.order_wide(orders.withColumn("user_age", F.col("id") + 20), details, keep=("user_age",))
    assert rows_of(found.drop("user_age")) == rows_of(wide.order_wide(orders, details))
    assert found.where(F.col("user_age") != F.col("order_id") + 20).count() == 0


def test_detail_facts_after_a_join_keep_its_columns(spark):
    schema = (
        "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_returnflag string, l_linestatus string"
    )
    lines = spark.createDataFrame([(7, 3, 1, 2.0, 5.5, "R", "F"), (None, 4, 2, 1.0, 1.0, "A", "O")], schema)
    found = inputs.order_detail_facts(lines.withColumn("order_ms", F.col("l_orderkey")), "order_ms")
    assert rows_of(found.drop("order_ms")) == rows_of(inputs.order_detail_facts(lines))
    assert sorted(r.order_ms or 0 for r in found.collect()) == [0, 7]


def test_state_as_it_is_held_not_every_change(spark, stream_of, scratch):
    held = spark.range(100).select(F.timestamp_seconds("id").alias("rt"), F.col("id").alias("id"), F.lit(1).alias("vc"))
    counts = stats.sensor_totals(stream_of(held, held), "10 seconds", "1 seconds")
    for changelog in (True, False):
        checkpoint = scratch("checkpoint")
        jobs.run_available(counts, batch_writer(scratch("found")), checkpoint, partitions=2, changelog=changelog)
        assert bool(glob.glob(f"{checkpoint}/state/0/*/*.changelog")) == changelog


def test_one_row_per_order_for_all_kinds_of_fact(spark):
    schema = "fact string, sku_id bigint, order_id bigint, ts bigint"
    made = [("order", 1, 7), ("payment", 1, 7), ("refund", 1, 7), ("order", 1, 7), ("order", 1, 8), ("refund", 1, None)]
    made += [("click", 1, None), ("order", 2, None), ("payment", None, 7)]
    rows = spark.createDataFrame([(*row, 1000) for row in made], schema)
    amounts = [F.lit(1).cast("decimal(18,2)").alias(name) for name in facts.PRODUCT_AMOUNTS]
    rows = rows.select("*", *[F.lit(1).cast("bigint").alias(name) for name in facts.PRODUCT_COUNTERS], *amounts)
    found = stats.product_stats(rows.withColumn("rt", F.timestamp_millis("ts")))
    got = {r.sku_id: (r.order_ct, r.paid_order_ct, r.refund_order_ct, r.click_ct) for r in found.collect()}
    assert got == {1: (2, 1, 1, 7), 2: (0, 0, 0, 1), None: (0, 1, 0, 1)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("fact#" not in line.split("], [")[0] for line in plan.splitlines() if "Aggregate" in line)
