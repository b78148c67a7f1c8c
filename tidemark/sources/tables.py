"""Stored tables: append per micro-batch, newest version on read, compaction.

A micro-batch is written to its own folder ``batch_id=<n>``, which a repeated run of the same
batch overwrites: a batch that is retried after a failure leaves one copy of its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.latest import latest_rows

BatchWriter = Callable[[DataFrame, int], None]


def batch_writer(
    path: str,
    partition_by: list[str] | None = None,
    drop: list[str] | None = None,
    transform: Callable[[DataFrame], DataFrame] | None = None,
) -> BatchWriter:
    """A ``foreachBatch`` function that appends to the table at ``path``.

    ``drop`` names columns that are computed along the way but not stored. ``transform`` is
    applied to every micro-batch first; what it reads, it reads afresh each time.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        rows = transform(rows) if transform else rows
        writer = rows.drop(*(drop or [])).write.mode("overwrite")
        writer.partitionBy(*(partition_by or [])).parquet(f"{path}/batch_id={batch_id}")

    return write


def with_day(stats: DataFrame) -> DataFrame:
    """The day a window starts, by which aggregate tables are stored."""
    return stats.withColumn("dt", F.to_date("stt"))


def write_stats(stats: DataFrame, path: str, version: int = 0) -> None:
    """Append one run of an aggregate to its table, stored by day.

    Rebalancing brings the rows of a day together, so that it is stored as few large files, and
    splits a day that is too large for one task.
    """
    rows = with_day(stats).hint("rebalance", "dt")
    rows.write.mode("overwrite").partitionBy("dt").parquet(f"{path}/batch_id={version}")


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def newest_versions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with the same window and keys, the one with the highest ``ts``, then batch."""
    windowed = [name for name in ("dt", "stt", "edt") if name in rows.columns]
    order = [name for name in ("ts", "batch_id") if name in rows.columns]
    return latest_rows(rows, [*windowed, *keys], order)


def read_dimensions(spark: SparkSession, path: str, compacted: str | None = None) -> DataFrame:
    """The newest row per dimension key, from the changes appended so far.

    With a ``compacted`` table only the batches after it are read beside it, not the whole history.
    """
    changes = spark.read.parquet(path)
    if compacted is not None:
        base = spark.read.parquet(compacted)
        upto = base.agg(F.max("upto")).first()[0]
        base = base.where(F.col("upto") == upto).drop("upto")
        later = changes.where(F.col("batch_id") > upto).drop("batch_id")
        return latest_rows(base.unionByName(later), ["sinkTable", "pk"], ["seq"])
    return latest_rows(changes.drop("batch_id"), ["sinkTable", "pk"], ["seq"])


def compact_dimensions(spark: SparkSession, path: str, target: str, compacted: str | None = None) -> None:
    """Write the newest rows as a table of their own, for readers that need no history.

    It holds the changes up to the last batch there is; each run adds a version of its own to ``target``.
    With an earlier ``compacted`` table the work is that of the changes since.
    """
    upto = spark.read.parquet(path).agg(F.max("batch_id")).first()[0]
    rows = read_dimensions(spark, path, compacted)
    rows.write.mode("overwrite").partitionBy("sinkTable").parquet(f"{target}/upto={upto}")
