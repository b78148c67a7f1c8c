"""Streams over several micro-batches give the batch result on rows that are not late."""

import datetime
import random

import pytest
from conftest import ids, rows_of
from pyspark.sql import functions as F
from test_logs_visits import random_pages

from tidemark.operators import changes, facts, keywords, logs, stats, visits, wide
from tidemark.operators.dims import enrich
from tidemark.sources import tables
from tidemark.streaming import jobs, processors

FAR = 10**10


def in_order(rows, parts):
    rows = sorted(rows, key=lambda row: (row[2], row[0]))
    size = -(-len(rows) // parts)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def closing(event_id):
    return (event_id, "closing", FAR, "home", "0")


@pytest.fixture
def finish(spark, scratch):
    def run(stream, mode="append"):
        path = scratch("result")
        jobs.run_to_table(stream, path, scratch("checkpoint"), mode)
        return spark.read.parquet(path)

    return run


def real(rows):
    return rows.where("common.mid <> 'closing'")


def test_new_flag(pages, stream_of, finish):
    rows = random_pages(300, 8, 200_000, 1)
    stream = stream_of(*[pages(part) for part in in_order(rows, 4)], pages([closing(-1)]))
    found = real(finish(processors.repair_new_flag_stream(stream, "event_id"))).drop("batch_id")
    assert rows_of(found) == rows_of(logs.repair_new_flag(pages(rows), ["event_id"]))


def test_new_flag_out_of_order_within_the_watermark(pages, stream_of, finish):
    batches = [[(1, "a", 5000, None, "1")], [(2, "a", 4000, None, "1")], [(3, "a", 9000, None, "1")], [closing(-1)]]
    stream = stream_of(*[pages(part) for part in batches])
    found = real(finish(processors.repair_new_flag_stream(stream, "event_id", "10 seconds")))
    flags = {r.event_id: r.is_new for r in found.select("event_id", "common.is_new").collect()}
    assert flags == {1: "0", 2: "1", 3: "0"}


def test_bounces(pages, stream_of, finish):
    rows = random_pages(300, 8, 200_000, 2)
    stream = stream_of(*[pages(part) for part in in_order(rows, 4)], pages([closing(-1)]))
    found = real(finish(processors.bounces_stream(stream, "event_id", 10_000, 20_000)))
    assert ids(found) == ids(visits.bounces(pages(rows), ["event_id"], 10_000))


def test_a_late_page_is_dropped(pages, stream_of, finish):
    # Page 2 would keep page 1 from bouncing, but comes when its time is past. Spark drops rows by
    # the watermark of the micro-batch before, hence the two batches in between.
    batches = [
        [(1, "a", 1000, None, "0")],
        [(8, "b", 60_000, "home", "0")],
        [(9, "b", 61_000, "home", "0")],
        [(2, "a", 2000, "home", "0")],
        [closing(-1)],
    ]
    stream = stream_of(*[pages(part) for part in batches])
    assert ids(real(finish(processors.bounces_stream(stream, "event_id", 10_000, 10_000)))) == [1]


def test_unique_visits(pages, stream_of, finish):
    rows = random_pages(200, 8, 3 * 86_400_000, 3)
    stream = stream_of(*[pages(part) for part in in_order(rows, 3)], pages([(-1, "closing", FAR, None, "0")]))
    found = real(finish(processors.unique_visits_stream(stream, "event_id"))).drop("batch_id")
    assert rows_of(found) == rows_of(visits.unique_visits(pages(rows), ["event_id"]))


def test_the_earliest_visit_counts_not_the_first_to_arrive(pages, stream_of, finish):
    batches = [[(1, "a", 36_000_000, None, "0")], [(2, "a", 32_000_000, None, "0")], [(3, "a", 90_000_000, None, "0")]]
    stream = stream_of(*[pages(part) for part in batches], pages([closing(-1)]), pages([(-2, "end", FAR, None, "0")]))
    found = finish(processors.unique_visits_stream(stream, "event_id", watermark="2 hours"))
    assert ids(found.where("event_id > 0")) == [2, 3]


def test_visits_bounces_and_statistics_run_at_the_same_time(spark, pages, scratch):
    """A dozen micro-batches through the three jobs with their defaults; none of the results comes too late."""
    rows = random_pages(1500, 40, 220_000, 11)
    end = [(-1, "closing", FAR, "home", "0")]
    source, folders = scratch("pages"), {name: scratch(name) for name in ("visits", "bounces", "stats")}
    pages([]).write.parquet(source)
    log = spark.readStream.schema(pages([]).schema).parquet(source)
    found = {
        "visits": processors.unique_visits_stream(log, "event_id"),
        "bounces": processors.bounces_stream(log, "event_id"),
    }
    followed = {}
    for name, stream in found.items():
        spark.createDataFrame([], stream.schema).write.parquet(f"{folders[name]}/batch_id=-1")
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch_id int"
        followed[name] = spark.readStream.schema(schema).parquet(folders[name]).drop("batch_id")
    union = facts.union_facts(
        facts.page_facts(log), facts.visit_facts(followed["visits"]), facts.bounce_facts(followed["bounces"])
    )
    found["stats"] = stats.visitor_stats(union)
    for batch in [*in_order(rows, 12), end]:
        pages(batch).coalesce(1).write.mode("append").parquet(source)
        for name, stream in found.items():
            jobs.run_to_table(stream, folders[name], f"{folders[name]}-checkpoint")
    log = pages(rows)
    union = facts.union_facts(
        facts.page_facts(log),
        facts.visit_facts(visits.unique_visits(log, ["event_id"])),
        facts.bounce_facts(visits.bounces(log, ["event_id"])),
    )
    done = spark.read.parquet(folders["stats"]).drop("batch_id").where("stt < '2000-01-01' or ts < 1000000000")
    assert rows_of(done) == rows_of(stats.visitor_stats(union))


def text(second):
    return (datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)).strftime("%Y-%m-%d %H:%M:%S")


def trade(spark, count, seed=4):
    rng = random.Random(seed)
    orders, details, payments = [], [], []
    for n in range(count):
        orders.append((n, 1, "1001", 7, 10, 0, 0, 10, 1, text(n * 10)))
        for d in range(3):
            details.append((n * 10 + d, n, rng.randrange(4), 5, 1, "", text(n * 10 + rng.randrange(-7, 8)), 5, 0, 0))
        payments.append((n, n, 8, 11, "s", "1101", text(n * 10 + rng.randrange(-8, 1000)), ""))
    order_schema = ("id int, province_id int, order_status string, user_id int, total_amount int, "
                    "activity_reduce_amount int, coupon_reduce_amount int, original_total_amount int, "
                    "feight_fee int, create_time string")
    detail_schema = ("id int, order_id int, sku_id int, order_price int, sku_num int, sku_name string, "
                     "create_time string, split_total_amount int, split_activity_amount int, split_coupon_amount int")
    payment_schema = ("id int, order_id int, user_id int, total_amount int, subject string, payment_type string, "
                      "create_time string, callback_time string")
    return (
        spark.createDataFrame(orders, order_schema),
        spark.createDataFrame(details, detail_schema),
        spark.createDataFrame(payments, payment_schema),
    )


def test_wide_rows_and_product_stats(spark, stream_of, finish):
    orders, details, payments = trade(spark, 40)
    batch_wide = wide.order_wide(orders, details)
    stream_wide = finish(wide.order_wide(stream_of(orders), stream_of(details))).drop("batch_id")
    assert stream_wide.count() > 40 and rows_of(stream_wide) == rows_of(batch_wide)

    batch_paid = wide.payment_wide(batch_wide, payments)
    again = stream_of(stream_wide).withWatermark("rt", "0 seconds")
    stream_paid = finish(wide.payment_wide(again, stream_of(payments))).drop("batch_id")
    assert 0 < stream_paid.count() < stream_wide.count() and rows_of(stream_paid) == rows_of(batch_paid)

    end = batch_wide.limit(1).withColumns({"create_time": F.lit("2100-01-01 00:00:00"), "sku_id": F.lit(-1)})
    sold = facts.order_facts(stream_of(*[batch_wide.orderBy("create_time"), end]))
    found = finish(stats.product_stats(sold)).drop("batch_id").where("sku_id >= 0")
    assert rows_of(found) == rows_of(stats.product_stats(facts.order_facts(batch_wide)))


def test_windows_close_as_time_passes(spark, pages, stream_of, finish):
    def batch(*times):
        return pages([(n, "a", ts, "home", "0") for n, ts in enumerate(times)])

    stream = stream_of(batch(1000, 2000), batch(40_000), batch(41_000), batch(3000), batch(100_000))
    rows = finish(stats.visitor_stats(facts.page_facts(stream))).orderBy("stt").collect()
    # The page at 3 s comes after its window was closed and is dropped.
    assert [(r.pv_ct, r.ts) for r in rows] == [(2, 1000), (2, 40_000)]


def test_update_mode_repeats_growing_totals(spark, stream_of, finish):
    def readings(*rows):
        schema = "id string, rt timestamp, vc double"
        return spark.createDataFrame([(i, datetime.datetime(2024, 1, 1, 0, 0, s), v) for i, s, v in rows], schema)

    stream = stream_of(readings(("s", 1, 1.0), ("s", 2, 2.0)), readings(("s", 30, 9.0)), readings(("s", 3, 4.0)))
    found = finish(stats.sensor_totals(stream, watermark="60 seconds"), "update")
    totals = [(r.batch_id, r.vc) for r in found.where("second(stt) = 0").orderBy("batch_id").collect()]
    assert [vc for _, vc in totals] == [3.0, 7.0]
    newest = tables.newest_versions(found, ["id"]).orderBy("stt").collect()
    assert [r.vc for r in newest] == [7.0, 9.0]


def test_keywords(spark, scratch, stream_of):
    def searches(*rows):
        at = [(k, s * 1000, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)) for k, s in rows]
        return spark.createDataFrame(at, "keyword string, ts bigint, rt timestamp")

    dictionary = spark.createDataFrame([("手机",), ("手",)], "word string")
    rows = [("手机 x", 1), ("手机 x", 2), ("天", 3), ("手", 12)]
    stream = stream_of(searches(*rows[:2]), searches(*rows[2:]), searches(("end", 10**6)))
    path = scratch("keywords")
    jobs.run_available(
        keywords.keyword_counts(stream), jobs.keyword_writer(path, lambda: dictionary), scratch("checkpoint")
    )
    found = spark.read.parquet(path).drop("batch_id")
    assert rows_of(found) == rows_of(keywords.keyword_stats(searches(*rows), dictionary))


def test_dimension_rows_added_while_the_stream_runs_are_seen(spark, scratch, stream_of):
    dim_path, out = scratch("dim"), scratch("out")

    def add(*rows):
        spark.createDataFrame(rows, "id string, name string").write.mode("append").parquet(dim_path)

    add(("1", "one"))
    lookups = []

    def read_dim():
        if lookups:
            add(("2", "two"))
        lookups.append(1)
        return spark.read.parquet(dim_path)

    fact = [spark.createDataFrame([(n,)], "k bigint") for n in (1, 2)]
    writer = jobs.fresh_lookup_writer(out, read_dim, lambda rows, dim: enrich(rows, dim, "k", {"name": "name"}))
    jobs.run_available(stream_of(*fact), writer, scratch("checkpoint"))
    assert sorted(r.name for r in spark.read.parquet(out).collect()) == ["one", "two"]


def test_rules_added_while_the_stream_runs_are_used(spark, scratch, stream_of):
    raw = [
        spark.createDataFrame([("s.d.user", "CREATE", None, {"id": str(n)}, n)],
                              "topic string, op string, before map<string,string>, after map<string,string>, seq bigint")
        for n in (1, 2)
    ]
    seen = []

    def read_rules():
        seen.append(1)
        rows = [("user", "insert", "kafka" if len(seen) == 1 else "hbase", "t", "id", "id", None)]
        return changes.current_rules(spark.createDataFrame(
            rows, "sourceTable string, operateType string, sinkType string, sinkTable string, sinkColumns string, "
            "sinkPk string, sinkExtend string"))

    topics, dimensions = scratch("topics"), scratch("dimensions")
    jobs.run_available(
        changes.normalise_changes(stream_of(*raw)), jobs.route_writer(topics, dimensions, read_rules), scratch("checkpoint")
    )
    assert [r.value for r in spark.read.schema("value string, topic string").parquet(f"{topics}/batch_id=0").collect()] == [
        '{"id":"1"}']
    assert [r.pk for r in tables.read_dimensions(spark, dimensions).collect()] == ["2"]


def test_a_failing_batch_raises(spark, scratch, stream_of):
    def fail(rows, batch_id):
        raise RuntimeError("no")

    with pytest.raises(Exception, match="no"):
        jobs.run_available(stream_of(spark.createDataFrame([(1,)], "x int")), fail, scratch("checkpoint"))
