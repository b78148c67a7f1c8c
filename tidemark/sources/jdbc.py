"""Database tables over JDBC. The driver jar is the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.records import camel_case_columns
from tidemark.sources.tables import BatchWriter


def read_query(spark: SparkSession, url: str, query: str, camel_case: bool = False, **options: str) -> DataFrame:
    """Rows of a query, optionally with ``under_score`` columns renamed to ``underScore``."""
    rows = spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()
    return camel_case_columns(rows) if camel_case else rows


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    split_column: str,
    lower: int,
    upper: int,
    partitions: int,
    **options: str,
) -> DataFrame:
    """A whole table, read in parallel by ranges of a numeric column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    reader = reader.option("partitionColumn", split_column).option("numPartitions", partitions)
    return reader.option("lowerBound", lower).option("upperBound", upper).load()


def jdbc_batch_writer(url: str, table: str, drop: list[str] | None = None, **options: str) -> BatchWriter:
    """A ``foreachBatch`` function that appends by column name, in batches of many rows.

    JDBC appends are not idempotent: a retried micro-batch is written twice. The batch number is
    stored as ``batch_id``, so the reader can keep the newest version of a row.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        rows = rows.drop(*(drop or [])).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        writer = rows.write.format("jdbc").mode("append").option("url", url).option("dbtable", table)
        writer.option("batchsize", 10_000).options(**options).save()

    return write
