"""Joins of two streams by micro-batch: the rows of Spark's own join, without a state of every row."""

import os

import pytest
from conftest import rows_of
from pyspark.sql import functions as F
from test_streams import text, trade

from tidemark.functions.times import text_to_time
from tidemark.operators import wide
from tidemark.plans import replay
from tidemark.sources.tables import batch_writer
from tidemark.streaming import jobs
from tidemark.streaming.pending import PendingJoin, Side, both_sides


def order_sides():
    return Side(text_to_time("create_time"), "5 seconds"), Side(text_to_time("create_time"), "5 seconds")


def by_time(rows, parts):
    """The rows in parts, in order of time; rows without a time come with the first."""
    rows = sorted(rows.collect(), key=lambda row: row.create_time or "")
    size = -(-len(rows) // parts)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


@pytest.fixture
def streams(spark, stream_of):
    """Streams of lists of rows, one list per micro-batch."""
    return lambda schema, *parts: stream_of(*[spark.createDataFrame(part, schema) for part in parts])


@pytest.fixture
def joined(spark, scratch):
    def run(left, right, sides, join):
        path, pending = scratch("pairs"), scratch("pending")
        write = PendingJoin(pending, *sides, join).writer(batch_writer(path))
        jobs.run_available(both_sides(left, right), write, scratch("checkpoint"))
        return spark.read.parquet(path).drop("batch_id"), pending

    return run


def test_orders_and_payments_over_many_micro_batches(spark, streams, joined):
    orders, details, payments = trade(spark, 60)
    # Details of one order in several parts, orders without a time or key, an order that comes twice.
    orders = orders.unionByName(orders.where("id % 9 = 0")).unionByName(orders.where("id = 3").withColumn("id", F.lit(None).cast("int")))
    orders = orders.withColumn("create_time", F.expr("if(id = 5, null, create_time)"))
    details = details.withColumn("order_id", F.expr("if(id % 31 = 0, null, order_id)"))
    left, right = (streams(rows.schema, *by_time(rows, 7)) for rows in (orders, details))
    found, pending = joined(left, right, order_sides(), wide.order_wide)
    wanted = wide.order_wide(orders, details)
    assert wanted.count() > 60 and rows_of(found) == rows_of(wanted)
    assert found.columns == wanted.columns
    waiting = spark.read.parquet(f"{pending}/rows").groupBy("batch_id").count().collect()
    assert len(waiting) == 7 and max(row["count"] for row in waiting) < 15

    rows = wanted.collect()
    rows.sort(key=lambda row: row.rt)
    wide_rows = streams(wanted.schema, rows[:50], rows[50:90], rows[90:])
    sides = Side(F.col("rt"), "15 minutes", "5 seconds"), Side(text_to_time("create_time"), "5 seconds")
    paid, _ = joined(wide_rows, streams(payments.schema, *by_time(payments, 3)), sides, wide.payment_wide)
    assert rows_of(paid) == rows_of(wide.payment_wide(wanted, payments))


def test_late_rows_are_dropped_as_in_the_join_of_spark(spark, streams, joined, scratch):
    orders, details, _ = trade(spark, 1)
    order, detail = orders.first().asDict(), details.first().asDict()

    def sold(*pairs):
        return [{**order, "id": n, "create_time": text(at)} for n, at in pairs]

    def lines(*pairs):
        return [{**detail, "id": n, "order_id": n, "create_time": text(at)} for n, at in pairs]

    # Order 3 and detail 4 come late; orders 1 and 2 wait for their details, 5 comes after its detail.
    left = [sold((1, 100)), sold((2, 109)), sold((9, 110)), sold((3, 90), (5, 113)), sold((8, 200))]
    right = [lines((7, 102)), lines((1, 105), (2, 110)), lines((9, 111), (5, 112)), lines((3, 112), (4, 90)), lines((8, 201))]
    streamed = [(streams(orders.schema, *left), streams(details.schema, *right)) for _ in range(2)]
    found, _ = joined(*streamed[0], order_sides(), wide.order_wide)
    path = scratch("spark")
    jobs.run_to_table(wide.order_wide(*streamed[1]), path, scratch("checkpoint"))
    assert sorted(row.order_id for row in found.collect()) == [1, 2, 5, 8, 9]
    assert rows_of(found) == rows_of(spark.read.parquet(path).drop("batch_id"))


def test_a_repeated_micro_batch_gives_the_same_rows(spark, scratch):
    orders, details, _ = trade(spark, 20)
    path = scratch("pairs")
    write = PendingJoin(scratch("pending"), *order_sides(), wide.order_wide).writer(batch_writer(path))
    middle = text(100)
    for batch_id, where in ((0, f"create_time < '{middle}'"), (1, f"create_time >= '{middle}'")):
        rows = both_sides(orders.where(where), details.where(where))
        write(rows, batch_id)
        write(rows, batch_id)
    assert rows_of(spark.read.parquet(path).drop("batch_id")) == rows_of(wide.order_wide(orders, details))


def test_a_chain_keeps_one_part_and_no_state_of_its_join(spark):
    orders, details, _ = trade(spark, 30)
    chain = replay.Replay(spark)
    part = F.expr("case when create_time < '{}' then 0 when create_time < '{}' then 1 else 2 end".format(text(100), text(200)))
    left, right = chain.source(orders, part), chain.source(details, part)
    ordered = chain.joined(left, right, order_sides(), wide.order_wide, "order-wide")
    path = chain.job(ordered, "found")
    chain.run()
    assert rows_of(chain.read(path)) == rows_of(wide.order_wide(orders, details))
    kept = spark.read.parquet(chain.sources[1][0])
    assert 0 < kept.count() == details.where(part == 2).count()
    assert not os.path.exists(f"{chain.jobs[0][2]}/state")
