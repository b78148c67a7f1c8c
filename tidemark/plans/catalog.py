"""Every registered query by name. Each takes a session and a table folder.

Money leaves as double, times and days as text, so that results compare with any SQL engine's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import records, times
from tidemark.functions.times import time_to_text
from tidemark.operators import changes, facts, keywords, logs, serving, stats, visits, wide
from tidemark.operators.latest import latest_rows
from tidemark.plans import inputs, streams, warehouse
from tidemark.session import scratch_path
from tidemark.sources import tables
from tidemark.sources.buckets import BucketTable
from tidemark.sources.changes import read_rules

Query = Callable[[SparkSession, str], DataFrame]

DAY = 20240115


def plain(rows: DataFrame) -> DataFrame:
    """Decimals as double; timestamps and dates as text."""
    columns = []
    for field in rows.schema:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.TimestampType):
            column = time_to_text(column)
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return rows.select(*columns)


def _stats(rows: DataFrame) -> DataFrame:
    return plain(stats.format_bounds(rows))


def _page_columns(pages: DataFrame) -> DataFrame:
    """The fields of a page log that the other columns follow from."""
    return pages.select(
        "event_id",
        "ts",
        F.col("common.mid").alias("mid"),
        F.col("common.is_new").alias("is_new"),
        F.col("page.page_id").alias("page_id"),
        F.col("page.during_time").alias("during_time"),
    )


# Serving reports


def gmv_day(spark, sf_dir):
    return plain(serving.gmv(warehouse.stored_sales(spark, sf_dir), DAY))


def gmv_by_day(spark, sf_dir):
    return plain(serving.gmv_by_day(warehouse.stored_sales(spark, sf_dir)))


def top_trademark(spark, sf_dir):
    return plain(serving.top_trademarks(warehouse.stored_sales(spark, sf_dir), DAY))


def top_category(spark, sf_dir):
    return plain(serving.top_categories(warehouse.stored_sales(spark, sf_dir), DAY))


def top_spu(spark, sf_dir):
    return plain(serving.top_spus(warehouse.stored_sales(spark, sf_dir), DAY))


def _top_by_day(keys: list[str]) -> Query:
    def query(spark, sf_dir):
        daily = serving.by_day(warehouse.stored_sales(spark, sf_dir))
        return plain(serving.top_products(daily, keys, 10, day="day"))

    return query


def province_amount(spark, sf_dir):
    return plain(serving.province_amounts(warehouse.stored_provinces(spark, sf_dir), DAY))


def province_amount_by_day(spark, sf_dir):
    return plain(serving.province_amounts_by_day(warehouse.stored_provinces(spark, sf_dir)))


def visitor_by_flag(spark, sf_dir):
    return plain(serving.visitors_by_flag(warehouse.stored_visitors(spark, sf_dir), DAY))


def visitor_by_flag_and_day(spark, sf_dir):
    return plain(serving.visitors_by_flag_and_day(warehouse.stored_visitors(spark, sf_dir)))


def visitor_by_hour(spark, sf_dir):
    return plain(serving.visitors_by_hour(warehouse.stored_visitors(spark, sf_dir), DAY))


def visitor_rates(spark, sf_dir):
    return plain(serving.visitor_rates(warehouse.stored_visitors(spark, sf_dir), DAY))


def visitor_by_hour_and_day(spark, sf_dir):
    return plain(serving.visitors_by_hour_and_day(warehouse.stored_visitors(spark, sf_dir)))


def visitor_rates_by_day(spark, sf_dir):
    return plain(serving.visitor_rates_by_day(warehouse.stored_visitors(spark, sf_dir)))


def _keyword_hits(spark, sf_dir):
    """Item hits by source: searches, carts and clicks from the page log, orders from details."""
    pages = warehouse.pages(spark, sf_dir)
    source = (
        F.when(F.col("page.last_page_id") == "search", "search")
        .when(F.col("page.page_id") == "payment", "CART")
        .when(F.col("page.page_id") == "good_detail", "CLICK")
        .otherwise("other")
    )
    seen = pages.select(F.col("page.item").alias("keyword"), source.alias("source"), F.timestamp_millis("ts").alias("rt"))
    ordered = warehouse.plain_order_wide(spark, sf_dir).select(
        F.col("sku_id").cast("string").alias("keyword"), F.lit("ORDER").alias("source"), "rt"
    )
    counted = (
        seen.unionByName(ordered)
        .groupBy(F.window("rt", "1 day").alias("window"), "keyword", "source")
        .agg(F.count("*").alias("ct"))
        .select(F.col("window.start").alias("stt"), "keyword", "source", "ct")
    )
    return warehouse.stored_by_day(counted, "keyword-hits")


def keyword_score(spark, sf_dir):
    return serving.top_keywords(_keyword_hits(spark, sf_dir), DAY, 20)


def keyword_score_by_day(spark, sf_dir):
    return plain(serving.top_keywords_by_day(_keyword_hits(spark, sf_dir), 20))


# Aggregates and facts


def visitor_stats(spark, sf_dir):
    return _stats(warehouse.visitor_stats(spark, sf_dir))


def product_stats(spark, sf_dir):
    return _stats(warehouse.product_stats(spark, sf_dir))


def province_stats(spark, sf_dir):
    return _stats(warehouse.province_stats(spark, sf_dir))


def keyword_stats(spark, sf_dir):
    pages = inputs.search_pages(inputs.table(spark, sf_dir, "conversations"))
    words = inputs.dictionary(inputs.table(spark, sf_dir, "benchmark"))
    counted = keywords.keyword_stats(
        keywords.search_keywords(pages),
        words,
        window="1 day",
        dictionary_runs=inputs.LETTER_RUNS,
        word_runs=inputs.DIGIT_RUNS,
    )
    return _stats(counted)


def keyword_segment(spark, sf_dir):
    """Words of all documents, by source of the document."""
    documents = inputs.table(spark, sf_dir, "documents").select("source", "text")
    words = inputs.dictionary(inputs.table(spark, sf_dir, "benchmark"))
    split = keywords.split_keywords(documents, "text", words)
    return split.groupBy("source", "word").agg(F.count("*").alias("ct"))


def search_filter(spark, sf_dir):
    pages = inputs.search_pages(inputs.table(spark, sf_dir, "conversations"))
    return keywords.search_keywords(pages).drop("rt")


def visitor_facts(spark, sf_dir):
    return plain(warehouse.visitor_facts(spark, sf_dir).drop("rt"))


def product_facts(spark, sf_dir):
    return plain(warehouse.product_facts(spark, sf_dir).drop("rt"))


# Visits and logs


def unique_visit(spark, sf_dir):
    return _page_columns(warehouse.unique_visits(warehouse.pages(spark, sf_dir)))


def bounce_detail(spark, sf_dir):
    return _page_columns(warehouse.bounces(warehouse.pages(spark, sf_dir)))


def new_flag_repair(spark, sf_dir):
    return _page_columns(logs.repair_new_flag(warehouse.pages(spark, sf_dir), [inputs.TIE]))


def _raw_lines(spark, sf_dir):
    return inputs.raw_logs(inputs.table(spark, sf_dir, "events"))


def dirty_split(spark, sf_dir):
    """Good and dirty lines, each with its id, in one pass."""
    tagged = records.parse_or_keep(_raw_lines(spark, sf_dir), inputs.LOG_WITH_TIE)
    found = F.regexp_extract("dirty", r'"event_id":(\d+)$', 1)
    return tagged.select(
        F.when(F.col("dirty").isNull(), "good").otherwise("dirty").alias("kind"),
        F.coalesce(F.col("event_id").cast("string"), found).alias("event_id"),
    )


def _parsed(spark, sf_dir):
    return records.parse_or_keep(_raw_lines(spark, sf_dir), inputs.LOG_WITH_TIE).where(F.col("dirty").isNull()).drop("dirty")


def log_split(spark, sf_dir):
    """Start and page logs from text lines, dirty lines left out."""
    tagged = logs.tag_logs(_parsed(spark, sf_dir))
    is_start = F.col("kind") == "start"
    return tagged.select(
        "kind",
        F.col("common.mid").alias("mid"),
        "ts",
        F.when(is_start, F.col("start.entry")).otherwise(F.col("page.page_id")).alias("detail"),
        F.when(is_start, F.col("start.loading_time")).otherwise(F.col("page.during_time")).alias("millis"),
    )


def display_explode(spark, sf_dir):
    return logs.display_logs(logs.page_logs(_parsed(spark, sf_dir)), [inputs.TIE])


# Wide rows and dimensions


def order_wide(spark, sf_dir):
    return plain(warehouse.order_wide(spark, sf_dir).drop("rt"))


def payment_wide(spark, sf_dir):
    return plain(warehouse.payment_wide(spark, sf_dir).drop("rt"))


def dim_enrich(spark, sf_dir):
    """Every detail, inside or outside the band, with its product levels."""
    details = warehouse.details(spark, sf_dir)
    named = warehouse.with_product(details, spark, sf_dir, with_price=True, counted=details)
    sums = [F.sum("split_total_amount").alias("amount"), F.sum("sku_num").alias("sku_num"), F.count("*").alias("rows")]
    return plain(named.groupBy("spu_name", "tm_name", "category3_name").agg(*sums))


def user_age(spark, sf_dir):
    orders = inputs.order_info(inputs.table(spark, sf_dir, "orders")).select("id", "user_id")
    return warehouse.with_user(orders, spark, sf_dir)


def order_fill(spark, sf_dir):
    """Wide orders without their order fields, filled from other rows of the same detail."""
    rows = warehouse.plain_order_wide(spark, sf_dir).select(
        "order_id", "order_status", "user_id", "total_amount", "split_total_amount"
    )
    odd = F.col("order_id") % 2 == 1
    missing = rows.withColumns(
        {
            "order_status": F.when(odd, F.col("order_status")),
            "user_id": F.when(~odd, F.col("user_id")),
            "split_total_amount": F.when(odd, F.col("split_total_amount")),
        }
    )
    orders = inputs.order_info(inputs.table(spark, sf_dir, "orders")).withColumnRenamed("id", "order_id")
    return plain(wide.fill_from(missing, orders, ["order_id"]))


def province_rows(spark, sf_dir):
    rows = warehouse.with_province(warehouse.plain_order_wide(spark, sf_dir), spark, sf_dir)
    return plain(facts.province_facts(rows).drop("ts"))


def wide_json(spark, sf_dir):
    """Wide orders as JSON messages, read back."""
    rows = warehouse.plain_order_wide(spark, sf_dir).drop("rt")
    lines = records.to_json_lines(rows)
    back = records.parse_json(lines, "detail_id bigint, order_id bigint, create_time string, split_total_amount decimal(18,2)")
    return plain(back)


def time_parts(spark, sf_dir):
    """Order times as text, number, day and hour."""
    orders = inputs.order_info(inputs.table(spark, sf_dir, "orders"))
    time = times.text_to_time("create_time")
    return orders.select(
        "id",
        "create_time",
        times.text_to_millis("create_time").alias("millis"),
        times.millis_to_text(times.text_to_millis("create_time")).alias("again"),
        times.day_number(time).alias("day_number"),
        F.hour(time).alias("hour"),
        times.create_date("create_time").alias("create_date"),
        times.create_hour("create_time").alias("create_hour"),
    )


def unique_visit_second(spark, sf_dir):
    """One visit per visitor and second."""
    return _page_columns(visits.unique_visits(warehouse.pages(spark, sf_dir), [inputs.TIE], "second"))


def sql_keyword_split(spark, sf_dir):
    """Searches split by the SQL table function in a lateral join."""
    found = keywords.search_keywords(inputs.search_pages(inputs.table(spark, sf_dir, "conversations")))
    found.createOrReplaceTempView("searched_keywords")
    keywords.register_split_function(spark, inputs.dictionary(inputs.table(spark, sf_dir, "benchmark")))
    words = spark.sql("SELECT ts, word FROM searched_keywords, LATERAL split_keyword(keyword)")
    return warehouse.stored_words(words, found)


def sql_keyword_dictionary(spark, sf_dir):
    """The SQL table function with runs of letters looked up in the dictionary."""
    found = keywords.search_keywords(inputs.search_pages(inputs.table(spark, sf_dir, "conversations")))
    found.createOrReplaceTempView("searched_keywords")
    dictionary = inputs.dictionary(inputs.table(spark, sf_dir, "benchmark"))
    name = "split_by_dictionary"
    keywords.register_split_function(spark, dictionary, name, inputs.LETTER_RUNS, inputs.DIGIT_RUNS)
    words = spark.sql(f"SELECT ts, word FROM searched_keywords, LATERAL {name}(keyword)")
    return warehouse.stored_words(words, found)


# Records and names


def sensor_csv(spark, sf_dir):
    """Events as lines of comma-separated text, read back as typed readings."""
    events = inputs.table(spark, sf_dir, "events")
    line = F.concat_ws(",", "user_id", F.unix_millis(F.col("ts").cast("timestamp")), "value")
    return records.parse_sensor_lines(events.select(line.alias("value")))


def camel_columns(spark, sf_dir):
    return records.camel_case_columns(inputs.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))


def code_names(spark, sf_dir):
    """Payments by the name of their type."""
    payments = warehouse.payments(spark, sf_dir).withColumnRenamed("payment_type", "code")
    named = payments.join(F.broadcast(records.business_codes(spark)), "code")
    return named.groupBy("code", "code_group", "meaning").agg(F.count("*").alias("ct"))


def cdc_rule_defaults(spark, sf_dir):
    """Changes routed by a stored rule table whose rules name no key."""
    path = scratch_path(spark, "rules")
    inputs.rule_table(spark).drop("sinkPk").write.json(path)
    routed = changes.route_changes(changes.drop_deletes(_envelopes(spark, sf_dir)), read_rules(spark, path))
    return routed.groupBy("sinkTable", "type", "Pk").agg(F.count("*").alias("ct"))


# Database changes


def _envelopes(spark, sf_dir):
    customer = inputs.captured_changes(inputs.table(spark, sf_dir, "customer"), "customer", "c_custkey")
    orders = inputs.captured_changes(inputs.table(spark, sf_dir, "orders"), "orders", "o_orderkey")
    return changes.normalise_changes(customer.unionByName(orders))


def _routed(spark, sf_dir):
    kept = changes.drop_deletes(_envelopes(spark, sf_dir))
    return changes.route_changes(kept, changes.current_rules(inputs.rule_table(spark)))


def cdc_normalise(spark, sf_dir):
    return _envelopes(spark, sf_dir).select(
        "database",
        "tableName",
        "type",
        "seq",
        F.size("before").alias("before_columns"),
        F.size("after").alias("after_columns"),
        F.coalesce(F.element_at("after", F.lit("c_name")), F.element_at("after", F.lit("o_orderstatus"))).alias("value"),
    )


def cdc_route(spark, sf_dir):
    """Where each routed change goes, in one pass."""
    routed = changes.with_output(_routed(spark, sf_dir))
    return routed.select("output", "tableName", "type", "seq", "sinkTable", "Pk")


def cdc_project(spark, sf_dir):
    """Routed changes with the names and values their rule keeps."""
    return _routed(spark, sf_dir).select(
        "sinkTable",
        "seq",
        F.array_join(F.array_sort(F.map_keys("after")), ",").alias("names"),
        F.coalesce(F.element_at("after", F.lit("c_name")), F.element_at("after", F.lit("o_custkey"))).alias("value"),
    )


def dim_latest(spark, sf_dir):
    """Newest image of every customer, and the newest one within every market segment."""
    dims = changes.dimension_changes(_routed(spark, sf_dir))
    by_segment = dims.withColumn("pk", F.element_at("after", F.lit("c_mktsegment")))
    latest = changes.latest_dimensions(dims.unionByName(by_segment))
    return latest.select("sinkTable", "pk", "seq", F.element_at("after", F.lit("c_name")).alias("c_name"))


def versioned_replace(spark, sf_dir):
    """Two runs of an aggregate in one stored table; readers see the newer row of each key.

    The first run lacks the bounces and is older by one.
    """
    facts_now = facts.marked_visitor_facts(warehouse.marked_pages(spark, sf_dir))
    path = scratch_path(spark, "visitor-versions")
    keys = ["vc", "ch", "ar", "is_new"]
    first = stats.visitor_stats(facts_now.withColumn("uj_ct", F.lit(0).cast("bigint")), window="1 hour")
    second = stats.visitor_stats(facts_now, window="1 hour")
    tables.write_stats(first.withColumn("ts", F.lit(1).cast("bigint")), path, version=0)
    tables.write_stats(second.withColumn("ts", F.lit(2).cast("bigint")), path, version=1)
    newest = tables.newest_versions(tables.read_versions(spark, path), keys)
    return _stats(newest.drop("dt", "batch_id"))


def cdc_snapshots(spark, sf_dir):
    """Changes found between two versions of a table, by digests of its buckets."""
    found = None
    for name, key, column in (("customer", "c_custkey", "c_mktsegment"), ("orders", "o_orderkey", "o_orderpriority")):
        rows = inputs.table(spark, sf_dir, name)
        stored = BucketTable(spark, scratch_path(spark, f"{name}-versions"), rows.schema, [key], buckets=256)
        stored.create()
        stored.capture(inputs.older_version(rows, key, column), 1)
        changed = stored.capture(rows, 2)
        some = changed.select(
            F.lit(name).alias("tableName"),
            "op",
            F.element_at(F.coalesce("after", "before"), F.lit(key)).alias("pk"),
            F.element_at("before", F.lit(column)).alias("before"),
            F.element_at("after", F.lit(column)).alias("after"),
            "seq",
        )
        found = some if found is None else found.unionByName(some)
    return found


# Streams


def stream_visitor_stats(spark, sf_dir):
    return _stats(streams.visitor_stats(spark, sf_dir))


def stream_product_stats(spark, sf_dir):
    return _stats(streams.product_stats(spark, sf_dir))


def stream_province_stats(spark, sf_dir):
    return _stats(streams.province_stats(spark, sf_dir))


def stream_keyword_stats(spark, sf_dir):
    return _stats(streams.keyword_stats(spark, sf_dir))


def stream_bounce(spark, sf_dir):
    return _page_columns(streams.bounces(spark, sf_dir))


def stream_new_flag(spark, sf_dir):
    return _page_columns(streams.new_flag(spark, sf_dir))


def stream_unique_visit(spark, sf_dir):
    return _page_columns(streams.unique_visits(spark, sf_dir))


def stream_late_pages(spark, sf_dir):
    """Pages per hour where one in fifty comes a part late; those whose hour has closed are not counted."""
    rows = streams.late_pages(spark, sf_dir)
    return _stats(rows.groupBy("stt", "edt").agg(F.sum("pv_ct").alias("pv_ct")))


def stream_order_wide(spark, sf_dir):
    return plain(streams.order_wide(spark, sf_dir).drop("rt"))


def stream_payment_wide(spark, sf_dir):
    return plain(streams.payment_wide(spark, sf_dir).drop("rt"))


def stream_cdc_route(spark, sf_dir):
    """Dimension rows as readers of the routed stream see them."""
    _, dimensions = streams.routed_changes(spark, sf_dir)
    latest = latest_rows(dimensions.drop("batch_id"), ["sinkTable", "pk"], ["seq"])
    return latest.select("sinkTable", "pk", "seq", F.element_at("after", F.lit("c_name")).alias("c_name"))


def stream_topics(spark, sf_dir):
    topics, _ = streams.routed_changes(spark, sf_dir)
    return topics.select(
        "topic",
        F.get_json_object("value", "$.o_orderkey").alias("o_orderkey"),
        F.get_json_object("value", "$.o_custkey").alias("o_custkey"),
        F.get_json_object("value", "$.o_orderstatus").alias("o_orderstatus"),
    )


def stream_topic_table(spark, sf_dir):
    """Pages written to a topic, opened as a SQL table and read with a computed column."""
    return plain(streams.topic_table(spark, sf_dir))


def stream_window_update(spark, sf_dir):
    """Of every window the newest total, and how often a total was put out."""
    totals = streams.window_totals(spark, sf_dir)
    times = totals.groupBy("stt", "edt", "id").agg(F.count("*").alias("times"))
    return plain(tables.newest_versions(totals, ["id"]).drop("batch_id").join(times, ["stt", "edt", "id"]))


def stream_window_firings(spark, sf_dir):
    """Every firing of every window: at its end, on its timer and for each late row, with the total by then."""
    return plain(streams.window_firings(spark, sf_dir))


def stream_dim_upsert(spark, sf_dir):
    """Dimension rows of the routed stream in a table of buckets, where readers need not look for the newest."""
    dimensions = streams.upserted_dimensions(spark, sf_dir)
    return dimensions.select("sinkTable", "pk", "seq", F.element_at("after", F.lit("c_name")).alias("c_name"))


def stream_rule_changes(spark, sf_dir):
    """Where each change goes while rules change in mid-stream."""
    routed = changes.with_output(streams.routed_by_streamed_rules(spark, sf_dir))
    return routed.select("output", "tableName", "type", "seq", "sinkTable")


QUERIES: dict[str, Query] = {
    "gmv_day": gmv_day,
    "gmv_by_day": gmv_by_day,
    "top_trademark": top_trademark,
    "top_trademark_by_day": _top_by_day(serving.BY_TRADEMARK),
    "top_category": top_category,
    "top_category_by_day": _top_by_day(serving.BY_CATEGORY),
    "top_spu": top_spu,
    "top_spu_by_day": _top_by_day(serving.BY_SPU),
    "province_amount": province_amount,
    "province_amount_by_day": province_amount_by_day,
    "visitor_by_flag": visitor_by_flag,
    "visitor_by_flag_and_day": visitor_by_flag_and_day,
    "visitor_by_hour": visitor_by_hour,
    "visitor_by_hour_and_day": visitor_by_hour_and_day,
    "visitor_rates": visitor_rates,
    "visitor_rates_by_day": visitor_rates_by_day,
    "keyword_score": keyword_score,
    "keyword_score_by_day": keyword_score_by_day,
    "visitor_stats": visitor_stats,
    "product_stats": product_stats,
    "province_stats": province_stats,
    "keyword_stats": keyword_stats,
    "keyword_segment": keyword_segment,
    "search_filter": search_filter,
    "visitor_facts": visitor_facts,
    "product_facts": product_facts,
    "unique_visit": unique_visit,
    "bounce_detail": bounce_detail,
    "new_flag_repair": new_flag_repair,
    "dirty_split": dirty_split,
    "log_split": log_split,
    "display_explode": display_explode,
    "order_wide": order_wide,
    "payment_wide": payment_wide,
    "dim_enrich": dim_enrich,
    "user_age": user_age,
    "order_fill": order_fill,
    "province_rows": province_rows,
    "wide_json": wide_json,
    "time_parts": time_parts,
    "unique_visit_second": unique_visit_second,
    "sql_keyword_split": sql_keyword_split,
    "sql_keyword_dictionary": sql_keyword_dictionary,
    "sensor_csv": sensor_csv,
    "camel_columns": camel_columns,
    "code_names": code_names,
    "cdc_rule_defaults": cdc_rule_defaults,
    "cdc_normalise": cdc_normalise,
    "cdc_route": cdc_route,
    "cdc_project": cdc_project,
    "dim_latest": dim_latest,
    "versioned_replace": versioned_replace,
    "stream_visitor_stats": stream_visitor_stats,
    "stream_product_stats": stream_product_stats,
    "stream_province_stats": stream_province_stats,
    "stream_keyword_stats": stream_keyword_stats,
    "stream_bounce": stream_bounce,
    "stream_new_flag": stream_new_flag,
    "stream_unique_visit": stream_unique_visit,
    "stream_late_pages": stream_late_pages,
    "stream_order_wide": stream_order_wide,
    "stream_payment_wide": stream_payment_wide,
    "stream_cdc_route": stream_cdc_route,
    "stream_topics": stream_topics,
    "stream_topic_table": stream_topic_table,
    "stream_window_update": stream_window_update,
    "stream_window_firings": stream_window_firings,
    "stream_dim_upsert": stream_dim_upsert,
    "stream_rule_changes": stream_rule_changes,
    "cdc_snapshots": cdc_snapshots,
}
