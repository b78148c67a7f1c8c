"""The warehouse's inputs, derived by Spark from the given tables.

The given tables have no page log and no order times, so those are computed row by row from
columns that are there. Every row of a table is used; nothing is sampled or cut.

- ``events`` is the page log. ``signup`` and ``view`` open a visit, ``click`` comes from a search,
  the others from the home page. ``view`` shows a product.
- ``orders`` and ``lineitem`` are orders and their details, placed in the month of the events.
  Some details lie outside the time band of their order, some payments come too early or late.
- ``part``, ``customer``, ``nation`` and ``region`` are the dimensions.
- ``conversations`` are what was searched for; the words of ``benchmark`` are the dictionary.
"""

from __future__ import annotations

import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.constants import TIME_FORMAT

MONTH_START = 1_704_067_200  # 2024-01-01 00:00:00 UTC
MONTH_SECONDS = 30 * 86_400
AS_OF = datetime.date(2024, 1, 31)
TIE = "event_id"

LOG_WITH_TIE = schemas.LOG + ", event_id bigint"

# What is added to the key of a row that an older version had.
GONE = 1_000_000_000

# The given texts have no Chinese: dictionary words are looked for in runs of letters instead.
LETTER_RUNS = r"\p{L}+"
DIGIT_RUNS = r"\p{N}+"

RULES = [
    ("orders", "insert", "kafka", "dwd_order_info", "o_orderkey,o_custkey,o_orderstatus", "o_orderkey", None),
    ("orders", "update", "clickhouse", "order_changes", "o_orderkey", "o_orderkey", None),
    ("customer", "insert", "hbase", "dim_user_info", "c_custkey,c_name,c_mktsegment", "c_custkey", None),
    ("customer", "update", "hbase", "dim_user_info", "c_custkey,c_name,c_mktsegment", "c_custkey", None),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _millis(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def page_log(events: DataFrame, *keep: str) -> DataFrame:
    """Events as page logs with ``common``, ``page``, ``displays``, ``ts`` and ``event_id``, and columns to ``keep``."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    page_id = (
        F.when(kind == "view", "good_detail")
        .when(kind == "click", "good_list")
        .when(kind == "signup", "register")
        .when(kind == "purchase", "payment")
        .otherwise("home")
    )
    last_page = F.when(kind.isin("signup", "view"), F.lit(None)).when(kind == "click", "search").otherwise("home")

    def display(i: Column) -> Column:
        return F.struct(
            F.lit("query").alias("display_type"),
            ((k * i) % 100).cast("string").alias("item"),
            F.when(i % 2 == 1, "sku_id").otherwise("activity_id").alias("item_type"),
            i.cast("int").alias("order"),
            i.cast("int").alias("pos_id"),
        )

    shown = F.when(k % 4 > 0, F.transform(F.sequence(F.lit(1), k % 4), display))
    no_text = F.lit(None).cast("string")
    return events.select(
        F.struct(
            F.concat(F.lit("ar"), F.col("user_id") % 5).alias("ar"),
            no_text.alias("ba"),
            F.concat(F.lit("ch"), k % 3).alias("ch"),
            F.when(kind == "signup", "1").otherwise("0").alias("is_new"),
            no_text.alias("md"),
            F.col("user_id").cast("string").alias("mid"),
            no_text.alias("os"),
            F.col("user_id").cast("string").alias("uid"),
            F.concat(F.lit("v"), k % 4).alias("vc"),
        ).alias("common"),
        F.struct(
            F.floor(F.col("value") * 100).cast("bigint").alias("during_time"),
            k.cast("string").alias("item"),
            F.when(kind == "click", "keyword").otherwise("sku_id").alias("item_type"),
            last_page.alias("last_page_id"),
            page_id.alias("page_id"),
            no_text.alias("source_type"),
        ).alias("page"),
        shown.alias("displays"),
        _millis("ts").alias("ts"),
        "event_id",
        *keep,
    )


def raw_logs(events: DataFrame) -> DataFrame:
    """Log lines as text: ``error`` events as start logs, the others as page logs.

    Lines of ``purchase`` events from the first channel lost their closing brace.
    """
    pages = page_log(events)
    is_start = F.col("page.page_id") == "home"
    start = F.struct(
        F.lit("icon").alias("entry"), F.col("page.during_time").alias("loading_time")
    )
    text = F.to_json(
        F.struct(
            "common",
            F.when(~is_start, F.col("page")).alias("page"),
            F.when(is_start, start).alias("start"),
            F.when(~is_start, F.col("displays")).alias("displays"),
            "ts",
            "event_id",
        )
    )
    broken = (F.col("page.page_id") == "payment") & (F.col("common.ch") == "ch0")
    lines = pages.select(text.alias("text"), broken.alias("broken"))
    cut = F.expr("substr(text, 1, length(text) - 1)")
    return lines.select(F.when(F.col("broken"), cut).otherwise(F.col("text")).alias("value"))


def _order_second(key: str) -> Column:
    return F.lit(MONTH_START) + (F.col(key) * 7919) % MONTH_SECONDS


def _time_text(second: Column) -> Column:
    return F.date_format(F.timestamp_seconds(second), TIME_FORMAT)


def _money(column: str) -> Column:
    return F.col(column).cast(schemas.MONEY)


def order_info(orders: DataFrame) -> DataFrame:
    zero = F.lit(0).cast(schemas.MONEY)
    return orders.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 25).alias("province_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_custkey").alias("user_id"),
        _money("o_totalprice").alias("total_amount"),
        zero.alias("activity_reduce_amount"),
        zero.alias("coupon_reduce_amount"),
        _money("o_totalprice").alias("original_total_amount"),
        (F.col("o_orderkey") % 20).cast(schemas.MONEY).alias("feight_fee"),
        _time_text(_order_second("o_orderkey")).alias("create_time"),
    )


def order_detail(lineitem: DataFrame) -> DataFrame:
    """Details from 4 seconds before to 8 seconds after their order."""
    second = _order_second("l_orderkey") + F.col("l_linenumber") * 2 - 6
    return lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("sku_id"),
        _money("l_extendedprice").alias("order_price"),
        F.col("l_quantity").cast("bigint").alias("sku_num"),
        F.lit("").alias("sku_name"),
        _time_text(second).alias("create_time"),
        _money("l_extendedprice").alias("split_total_amount"),
        _money("l_discount").alias("split_activity_amount"),
        _money("l_tax").alias("split_coupon_amount"),
    )


def payment_info(orders: DataFrame) -> DataFrame:
    """Payments from 10 seconds before to 1189 seconds after their order."""
    second = _order_second("o_orderkey") + F.col("o_orderkey") % 1200 - 10
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        _money("o_totalprice").alias("total_amount"),
        F.col("o_orderpriority").alias("subject"),
        F.when(F.col("o_orderstatus") == "F", "1101").otherwise("1102").alias("payment_type"),
        _time_text(second).alias("create_time"),
        _time_text(second + 1).alias("callback_time"),
    )


def order_refund_info(lineitem: DataFrame) -> DataFrame:
    return lineitem.where(F.col("l_returnflag") == "R").select(
        F.col("l_partkey").alias("sku_id"),
        F.col("l_orderkey").alias("order_id"),
        _money("l_extendedprice").alias("refund_amount"),
        _time_text(_order_second("l_orderkey") + 3600).alias("create_time"),
    )


def comment_info(lineitem: DataFrame) -> DataFrame:
    return lineitem.where(F.col("l_returnflag") == "A").select(
        F.col("l_partkey").alias("sku_id"),
        F.when(F.col("l_linestatus") == "F", "1201").otherwise("1203").alias("appraise"),
        _time_text(_order_second("l_orderkey") + 7200).alias("create_time"),
    )


def order_detail_facts(lineitem: DataFrame, *keep: str) -> DataFrame:
    """Details with the times and values of the facts they give, and columns to ``keep``, from one pass over the table.

    The same values as ``order_detail``, ``order_refund_info`` and ``comment_info``; times in milliseconds.
    """
    second = _order_second("l_orderkey")
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("sku_id"),
        F.col("l_quantity").cast("bigint").alias("sku_num"),
        _money("l_extendedprice").alias("split_total_amount"),
        _money("l_extendedprice").alias("refund_amount"),
        ((second + F.col("l_linenumber") * 2 - 6) * 1000).alias("detail_ms"),
        F.when(F.col("l_returnflag") == "R", (second + 3600) * 1000).alias("refund_ms"),
        F.when(F.col("l_returnflag") == "A", (second + 7200) * 1000).alias("comment_ms"),
        F.when(F.col("l_linestatus") == "F", "1201").otherwise("1203").alias("appraise"),
        *keep,
    )


def _marked(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("event_type") == kind).select(
        F.get_json_object("props", "$.k").cast("bigint").alias("sku_id"),
        F.date_format(F.col("ts").cast("timestamp"), TIME_FORMAT).alias("create_time"),
    )


def favor_info(events: DataFrame) -> DataFrame:
    return _marked(events, "click")


def cart_info(events: DataFrame) -> DataFrame:
    return _marked(events, "purchase")


def user_info(customer: DataFrame) -> DataFrame:
    born = F.date_add(F.lit("1950-01-01").cast("date"), ((F.col("c_custkey") * 37) % 20_000).cast("int"))
    return customer.select(
        F.col("c_custkey").cast("string").alias("id"),
        born.cast("string").alias("birthday"),
        F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F").alias("gender"),
    )


def base_province(nation: DataFrame, region: DataFrame) -> DataFrame:
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("string").alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("0"), F.col("n_nationkey")).alias("area_code"),
        F.concat(F.lit("N-"), F.col("n_nationkey")).alias("iso_code"),
        F.concat(F.col("r_name"), F.lit("-"), F.col("n_nationkey")).alias("iso_3166_2"),
    )


def _trademark_id() -> Column:
    return F.regexp_extract("p_brand", r"(\d+)$", 1)


def _category_id() -> Column:
    return (F.length("p_type") * 100 + F.ascii("p_type")).cast("string")


def sku_info(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("sku_name"),
        F.col("p_retailprice").cast("string").alias("price"),
        F.col("p_size").cast("string").alias("spu_id"),
        _trademark_id().alias("tm_id"),
        _category_id().alias("category3_id"),
    )


def spu_info(part: DataFrame) -> DataFrame:
    names = part.groupBy(F.col("p_size").cast("string").alias("id"))
    return names.agg(F.min("p_name").alias("spu_name"))


def base_trademark(part: DataFrame) -> DataFrame:
    return part.groupBy(_trademark_id().alias("id")).agg(F.min("p_brand").alias("tm_name"))


def base_category3(part: DataFrame) -> DataFrame:
    return part.groupBy(_category_id().alias("id")).agg(F.min("p_type").alias("name"))


def captured_changes(rows: DataFrame, name: str, key: str) -> DataFrame:
    """Rows of a table as captured change records, of all four kinds by turns."""
    turn = F.col(key) % 4
    image = F.expr("map_from_arrays(array({}), array({}))".format(
        ", ".join(f"'{column}'" for column in rows.columns),
        ", ".join(f"cast(`{column}` as string)" for column in rows.columns),
    ))
    op = F.when(turn == 0, "CREATE").when(turn == 1, "READ").when(turn == 2, "UPDATE").otherwise("DELETE")
    return rows.select(
        F.lit(f"server.shop.{name}").alias("topic"),
        op.alias("op"),
        F.when(turn >= 2, image).alias("before"),
        F.when(turn < 3, image).alias("after"),
        F.col(key).cast("bigint").alias("seq"),
    )


def older_version(rows: DataFrame, key: str, column: str) -> DataFrame:
    """A table as it was before: of 500 keys one was not there yet, one had another value, one has since gone."""
    turn = F.pmod(F.col(key), F.lit(500))
    before = rows.where(turn != 1).withColumn(column, F.when(turn == 2, "old").otherwise(F.col(column)))
    gone = rows.where(turn == 3).withColumn(key, F.col(key) + GONE)
    return before.unionByName(gone)


def rule_table(spark: SparkSession) -> DataFrame:
    # From Arrow, so that Spark knows how small the table is.
    names = spark.createDataFrame([], schemas.RULE).columns
    columns = {name: pa.array([rule[i] for rule in RULES], pa.string()) for i, name in enumerate(names)}
    return spark.createDataFrame(pa.table(columns))


def later_rules(rules: DataFrame, arrival: int) -> DataFrame:
    """The rules that change before part ``arrival``: first that of new orders, then that of changed customers."""
    table, kind = ("orders", "insert") if arrival == 1 else ("customer", "update")
    changed = rules.where((F.col("sourceTable") == table) & (F.col("operateType") == kind))
    target = F.concat("sinkTable", F.lit(f"_{arrival}"))
    return changed.withColumns({"sinkTable": target, "seq": F.lit(arrival).cast("bigint")})


def search_pages(conversations: DataFrame) -> DataFrame:
    """Conversation turns as pages: a user's turn is a search for its text."""
    second = F.lit(MONTH_START) + (F.col("conv_id") * 3600) % MONTH_SECONDS + F.col("turn") * 60
    last_page = F.when(F.col("role") == "user", "search").otherwise("home")
    return conversations.select(
        F.struct(F.col("text").alias("item"), last_page.alias("last_page_id")).alias("page"),
        (second * 1000).alias("ts"),
    )


def dictionary(benchmark: DataFrame) -> DataFrame:
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{2,}"), F.lit(0)))
    return benchmark.select(words.alias("word")).distinct()


def sensors(events: DataFrame, *keep: str) -> DataFrame:
    """Events as readings of one sensor per user, and columns to ``keep``."""
    return events.select(
        F.col("user_id").cast("string").alias("id"),
        F.col("value").cast(schemas.MONEY).alias("vc"),
        F.col("ts").cast("timestamp").alias("rt"),
        *keep,
    )
