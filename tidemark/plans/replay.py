"""Given tables as streams: their rows arrive a part at a time, in order of event time.

A ``Replay`` holds the sources and jobs of a chain. Each round adds the next part of every source to its
folder and then runs every job on what is new, so all jobs of the chain move on together, each from its
own checkpoint. A last round adds closing rows far in the future, so that the last windows and timers
close.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tidemark.operators.skew import estimated_bytes, read_bytes
from tidemark.plans import inputs
from tidemark.session import scratch_path
from tidemark.sources.tables import BatchWriter, batch_writer
from tidemark.streaming import jobs
from tidemark.streaming.pending import PendingJoin, Side, both_sides

PARTS = 3
# Bytes of the sources, by Spark's estimate, for each state partition.
STATE_BYTES = 32 << 20
FAR = datetime.datetime(2100, 1, 1, tzinfo=datetime.timezone.utc)
FAR_MS = int(FAR.timestamp()) * 1000


def part_of(second: Column) -> Column:
    """The part a time belongs to: thirds of the month, all else with the nearest. Nulls come first."""
    part = F.floor((second - inputs.MONTH_START) * PARTS / inputs.MONTH_SECONDS)
    return F.coalesce(F.greatest(F.least(part, F.lit(PARTS - 1)), F.lit(0)), F.lit(0)).cast("int")


def millis_part(column: str = "ts") -> Column:
    return part_of(F.floor(F.col(column) / 1000))


def text_part(column: str = "create_time") -> Column:
    return part_of(F.unix_seconds(F.col(column).try_cast("timestamp")))


class Replay:
    """``changelog`` says how the jobs store their state (see ``processors.use_rocksdb``)."""

    def __init__(self, spark: SparkSession, changelog: bool = True) -> None:
        self.spark, self.changelog = spark, changelog
        self.sources: list[tuple[str, DataFrame, Column]] = []
        self.jobs: list[tuple[DataFrame, BatchWriter, str, str]] = []
        self.rounds = set(range(PARTS))
        # Called with the number of each round before its jobs run.
        self.hooks: list[Callable[[int], None]] = []

    def _folder(self, label: str, schema: StructType) -> str:
        path = scratch_path(self.spark, label)
        self.spark.createDataFrame([], schema).write.parquet(path)
        return path

    def source(self, rows: DataFrame, part: Column, late: bool = False, **closing: Column) -> DataFrame:
        """The rows as a stream; ``part`` (0 and up, below ``PARTS``) says when a row arrives.

        With ``late`` rows of the last part may come one round later. With ``closing`` values a row of
        these, null elsewhere, comes in the last round.
        """
        if late:
            self.rounds.add(PARTS)
        if closing:
            self.rounds.add(PARTS + 1)
        path = self._folder("source", rows.schema)
        if closing:
            values = [
                closing[field.name].alias(field.name)
                if field.name in closing
                else F.lit(None).cast(field.dataType).alias(field.name)
                for field in rows.schema
            ]
            last = self.spark.range(1).select(*values)
            rows = rows.withColumn("arrival", part).unionByName(last.withColumn("arrival", F.lit(PARTS + 1)))
        else:
            rows = rows.withColumn("arrival", part)
        self.sources.append((path, rows, F.col("arrival")))
        return self.spark.readStream.schema(rows.drop("arrival").schema).parquet(path)

    def job(self, stream: DataFrame, label: str, mode: str = "append", write: BatchWriter | None = None) -> str:
        """A job that writes ``stream`` to a table; its path. Jobs run in the order they are added."""
        path = scratch_path(self.spark, label)
        self.jobs.append((stream, write or batch_writer(path), scratch_path(self.spark, f"{label}-checkpoint"), mode))
        return path

    def chained(self, stream: DataFrame, label: str) -> DataFrame:
        """A job's output as the stream the next job reads, the way it would read a topic."""
        path, found = self._topic(stream.schema, label)
        self.jobs.append((stream, batch_writer(path), scratch_path(self.spark, f"{label}-checkpoint"), "append"))
        return found

    def joined(
        self,
        left: DataFrame,
        right: DataFrame,
        sides: tuple[Side, Side],
        join: Callable[[DataFrame, DataFrame], DataFrame],
        label: str,
    ) -> DataFrame:
        """The pairs of two streams as the stream the next job reads."""
        empty = (self.spark.createDataFrame([], side.schema) for side in (left, right))
        path, found = self._topic(join(*empty).schema, label)
        self.pairs(left, right, sides, join, label, batch_writer(path))
        return found

    def pairs(
        self,
        left: DataFrame,
        right: DataFrame,
        sides: tuple[Side, Side],
        join: Callable[[DataFrame, DataFrame], DataFrame],
        label: str,
        write: BatchWriter,
    ) -> None:
        """A job that gives the pairs of two streams to ``write`` (see ``PendingJoin``)."""
        pending = PendingJoin(scratch_path(self.spark, f"{label}-pending"), *sides, join)
        self.job(both_sides(left, right), label, write=pending.writer(write))

    def _topic(self, schema: StructType, label: str) -> tuple[str, DataFrame]:
        path = scratch_path(self.spark, label)
        stored = StructType(list(schema.fields)).add("batch_id", IntegerType())
        self.spark.createDataFrame([], schema).write.parquet(f"{path}/batch_id=-1")
        return path, self.spark.readStream.schema(stored).parquet(path).drop("batch_id")

    def state_partitions(self) -> int:
        """One state partition per core, or as many more as the size of the sources asks for."""
        context = self.spark.sparkContext
        least = min(int(self.spark.conf.get(jobs.SHUFFLE_PARTITIONS)), context.defaultParallelism)
        size = sum(min(estimated_bytes(rows), read_bytes(rows)) for _, rows, _ in self.sources)
        return max(least, -(-size // STATE_BYTES))

    def run(self) -> None:
        partitions = self.state_partitions()
        for arrival in sorted(self.rounds):
            for path, rows, part in self.sources:
                # Every job has read the part before: it goes.
                rows.where(part == arrival).drop("arrival").write.mode("overwrite").parquet(path)
            for hook in self.hooks:
                hook(arrival)
            for stream, write, checkpoint, mode in self.jobs:
                jobs.run_available(stream, write, checkpoint, mode, partitions, self.changelog)

    def read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path).drop("batch_id")


def run_one(
    spark: SparkSession,
    build: Callable[[Replay], DataFrame],
    label: str,
    mode: str = "append",
    changelog: bool = True,
) -> DataFrame:
    """Run a chain whose last job writes what ``build`` returns, and read that."""
    replay = Replay(spark, changelog)
    path = replay.job(build(replay), label, mode)
    replay.run()
    return replay.read(path)
