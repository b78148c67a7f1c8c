import json

from conftest import rows_of

from pyspark.sql import functions as F

from tidemark.constants import BUSINESS_CODES
from tidemark.functions import records, times
from tidemark.operators import keywords
from tidemark.sources import changes as change_source
from tidemark.sources import topics


def words(spark, *found):
    return spark.createDataFrame([(word,) for word in found], "word string")


def split(spark, text, *dictionary, **runs):
    rows = spark.createDataFrame([(1, text)], "id int, text string")
    return sorted(r.word for r in keywords.split_keywords(rows, "text", words(spark, *dictionary), **runs).collect())


def test_overlapping_dictionary_words_are_all_found(spark):
    assert split(spark, "孙悟空大闹天宫", "孙悟空", "悟空", "大闹天宫", "大闹", "天宫", "龙") == sorted(
        ["孙悟空", "悟空", "大闹天宫", "大闹", "天宫"])


def test_letters_and_digits_are_words_themselves(spark):
    assert split(spark, "Redmi手机 K30,128G", "手机") == sorted(["redmi", "手机", "k30", "128g"])


def test_a_repeated_word_counts_each_time(spark):
    assert split(spark, "手机手机", "手机") == ["手机", "手机"]


def test_a_text_without_a_word_gives_itself(spark):
    assert split(spark, "天地", "手机") == ["天地"]
    assert split(spark, "!!", "手机") == ["!!"]
    assert split(spark, "天地") == ["天地"]
    assert split(spark, None, "手机") == []


def test_the_longest_word_is_found(spark):
    long = "天" * 40
    assert split(spark, long, long, "地") == [long]


def test_against_brute_force(spark):
    import random

    rng = random.Random(5)
    found = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(12)}
    text = "".join(rng.choice("abc ") for _ in range(300))
    expected = sorted(
        run[i:j] for run in text.split() for i in range(len(run)) for j in range(i + 1, len(run) + 1) if run[i:j] in found
    )
    assert split(spark, text, *found, dictionary_runs=r"\p{L}+", word_runs=r"\p{N}+") == expected


def test_search_filter_and_counts(spark):
    pages = spark.createDataFrame(
        [({"last_page_id": "search", "item": "手机"}, 1000), ({"last_page_id": "search", "item": "手机"}, 2000),
         ({"last_page_id": "search"}, 1000), ({"last_page_id": "home", "item": "手机"}, 1000),
         ({"last_page_id": "search", "item": "天"}, 11000)],
        "page map<string,string>, ts bigint",
    )
    found = keywords.search_keywords(pages)
    assert found.count() == 3
    rows = keywords.keyword_stats(found, words(spark, "手机", "手")).collect()
    assert sorted((r.keyword, r.ct, r.source, r.ts) for r in rows) == sorted(
        [("手机", 2, "search", 1000), ("手", 2, "search", 1000), ("天", 1, "search", 11000)])


def test_sensor_lines(spark):
    lines = spark.createDataFrame([("s1,1000,2.5",), ("s2,x,1",)], "value string")
    rows = records.parse_sensor_lines(lines).collect()
    assert [tuple(r) for r in rows] == [("s1", 1000, 2.5), ("s2", None, 1.0)]


def test_column_names_and_json(spark):
    rows = spark.createDataFrame([(1, None)], "USER_ID int, sku_name string")
    assert records.camel_case_columns(rows).columns == ["userId", "skuName"]
    assert records.to_json_lines(rows).first().value == '{"USER_ID":1}'


def test_code_table(spark):
    codes = records.business_codes(spark)
    assert codes.count() == len(BUSINESS_CODES) and codes.where("code = '1201'").first().meaning == "good"


def test_time_conversions(spark):
    row = spark.createDataFrame([("2021-12-16 03:04:05",)], "t string").select(
        times.text_to_millis("t").alias("ms"), times.create_hour("t").alias("hour"), times.create_date("t").alias("date"),
        times.day_number(times.text_to_time("t")).alias("day"),
        times.millis_to_text(times.text_to_millis("t")).alias("back"),
        times.text_to_millis(F.lit("not a time")).alias("bad"),
    ).first()
    assert tuple(row) == (1639623845000, "03", "2021-12-16", 20211216, "2021-12-16 03:04:05", None)


def test_messages_go_to_the_topic_they_name_and_back(spark, scratch, stream_of):
    root = scratch("topics")
    messages = spark.createDataFrame([("a", '{"x":1}'), ("b", '{"x":2}'), ("a", '{"x":3}')], "topic string, value string")
    for stream, topic in ((stream_of(messages), None), (stream_of(messages.select("value")), "c")):
        writer = topics.topic_writer(stream, topic, scratch("checkpoint"), root=root)
        writer.trigger(availableNow=True).start().awaitTermination()
    table = topics.register_topic_table(
        spark, "topic_a", topics.read_topic(spark, "a", root=root), "x bigint", F.timestamp_millis("x"))
    assert table.isStreaming and table.columns == ["x", "rt"]
    query = spark.sql("SELECT x FROM topic_a").writeStream.format("memory").queryName("read_a")
    query.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.x for r in spark.table("read_a").collect()) == [1, 3]
    assert spark.read.text(f"{root}/topic=c").count() == 3


def test_processing_time_is_shifted(spark):
    row = topics.with_processing_time(spark.range(1)).select((F.col("proctime") - F.current_timestamp()).cast("string"))
    assert "08:00:00" in row.first()[0]


def test_console_writer(spark, scratch, stream_of):
    rows = spark.createDataFrame([(1,)], "x int")
    writer = topics.console_writer(stream_of(rows), scratch("checkpoint"))
    writer.trigger(availableNow=True).start().awaitTermination()


def test_change_lines_and_rules(spark, scratch):
    line = {"database": "d", "tableName": "t", "before": {}, "after": {"id": "1"}, "type": "insert", "seq": 4}
    row = change_source.parse_changes(spark.createDataFrame([(json.dumps(line),)], "value string")).first()
    assert (row.tableName, row.after, row.seq) == ("t", {"id": "1"}, 4)
    path = scratch("rules")
    spark.createDataFrame([('{"sourceTable":"t","operateType":"insert","sinkTable":"s"}',)], "value string").write.text(path)
    assert change_source.read_rules(spark, path).first().sinkPk == "id"


def test_the_sql_table_function_splits_like_the_operator(spark):
    dictionary = words(spark, "手机", "手", "小米")
    rows = spark.createDataFrame(
        [(1, "小米手机 K30"), (2, "天地"), (3, "手机手机"), (4, None), (5, "天地")], "id int, keyword string"
    )
    rows.createOrReplaceTempView("searches")
    keywords.register_split_function(spark, dictionary)
    found = spark.sql("SELECT id, word FROM searches, LATERAL split_keyword(keyword)")
    expected = keywords.split_keywords(rows, "keyword", dictionary).select("id", "word")
    assert rows_of(found) == rows_of(expected) and expected.count() == 10
