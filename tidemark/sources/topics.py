"""Message topics, as sources, SQL tables and sinks.

With ``bootstrap`` a topic is a Kafka topic (the Kafka package must be on Spark's class path);
without it a topic is a folder of text files under ``root``, one message per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.functions.records import parse_json, parse_sensor_lines
from tidemark.functions.times import millis_to_time


def read_topic(
    spark: SparkSession,
    topic: str,
    root: str | None = None,
    bootstrap: str | None = None,
    starting: str = "latest",
    **options: str,
) -> DataFrame:
    """A stream of messages in the text column ``value``."""
    if bootstrap:
        reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
        reader = reader.option("subscribe", topic).option("startingOffsets", starting).options(**options)
        return reader.load().select(F.col("value").cast("string").alias("value"))
    return spark.readStream.options(**options).text(f"{root}/topic={topic}")


def topic_writer(
    messages: DataFrame, topic: str | None, checkpoint: str, root: str | None = None, bootstrap: str | None = None
) -> DataStreamWriter:
    """Write ``value`` to one topic or, where ``topic`` is None, to the topic each row names.

    As folders, a topic takes one writing query: Spark logs a query's finished files in its folder.
    """
    if bootstrap and topic is not None:
        messages = messages.select(F.lit(topic).alias("topic"), "value")
    columns = ["value"] if topic is not None and not bootstrap else ["topic", "value"]
    writer = messages.select(*columns).writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    if bootstrap:
        return writer.format("kafka").option("kafka.bootstrap.servers", bootstrap)
    if topic is not None:
        return writer.format("text").option("path", f"{root}/topic={topic}")
    return writer.format("text").partitionBy("topic").option("path", root)


def register_topic_table(
    spark: SparkSession,
    name: str,
    lines: DataFrame,
    schema: str,
    event_time: Column | None = None,
    watermark: str = "2 seconds",
) -> DataFrame:
    """A SQL view over JSON messages, with the event time ``rt`` if one is given."""
    table = parse_json(lines, schema)
    if event_time is not None:
        table = table.withColumn("rt", event_time)
        if table.isStreaming:
            table = table.withWatermark("rt", watermark)
    table.createOrReplaceTempView(name)
    return table


def with_processing_time(rows: DataFrame, shift: str = "8 hours") -> DataFrame:
    """Add ``proctime``, the time of processing moved by ``shift``."""
    return rows.withColumn("proctime", F.current_timestamp() + F.expr(f"INTERVAL '{shift}'"))


def read_sensor_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Sensor readings from CSV lines on a socket (for trying things out; not fault tolerant)."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return parse_sensor_lines(lines).withColumn("rt", millis_to_time("ts"))


def console_writer(rows: DataFrame, checkpoint: str, mode: str = "append") -> DataStreamWriter:
    writer = rows.writeStream.format("console").outputMode(mode).option("truncate", "false")
    return writer.option("checkpointLocation", checkpoint)
