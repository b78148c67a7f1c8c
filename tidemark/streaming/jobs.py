"""Running streams, and streams that need fresh tables per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.changes import dimension_changes, drop_deletes, route_changes, topic_messages
from tidemark.operators.keywords import word_counts
from tidemark.sources.tables import BatchWriter, batch_writer
from tidemark.streaming.processors import use_rocksdb

SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"


def run_available(
    stream: DataFrame,
    write: BatchWriter,
    checkpoint: str,
    mode: str = "append",
    partitions: int | None = None,
    changelog: bool = True,
) -> None:
    """Process all input there is, then stop. An error in the stream is raised here.

    ``partitions`` is the number of state partitions, by default that of the session's shuffles. Every
    one is committed in every micro-batch. A checkpoint keeps the number it began with. For ``changelog``
    see ``use_rocksdb``.
    """
    spark = stream.sparkSession
    use_rocksdb(spark, changelog)
    held = spark.conf.get(SHUFFLE_PARTITIONS)
    # A stream works on a copy of the settings that it makes at its start.
    spark.conf.set(SHUFFLE_PARTITIONS, str(partitions or held))
    try:
        query = start(stream, write, checkpoint, mode, availableNow=True)
    finally:
        spark.conf.set(SHUFFLE_PARTITIONS, held)
    query.awaitTermination()


def start(
    stream: DataFrame, write: BatchWriter, checkpoint: str, mode: str = "append", **trigger
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all input there is into the table at ``path``."""
    run_available(stream, batch_writer(path), checkpoint, mode)


def fresh_lookup_writer(
    path: str, read_lookup: Callable[[], DataFrame], join: Callable[[DataFrame, DataFrame], DataFrame]
) -> BatchWriter:
    """Join every micro-batch to a table read at that moment.

    A table read once keeps the list of files it had then; a stream that runs for days would not
    see rows added later.
    """
    return batch_writer(path, transform=lambda rows: join(rows, read_lookup()))


def route_writer(topics_path: str, dims_path: str, read_rules: Callable[[], DataFrame]) -> BatchWriter:
    """Route every micro-batch of changes by the rules as they are then.

    Facts go to ``topics_path`` by topic, dimension changes to ``dims_path`` by table.
    """
    write_topics = batch_writer(topics_path, ["topic"], transform=topic_messages)
    write_dims = batch_writer(dims_path, ["sinkTable"], transform=dimension_changes)

    def write(changes: DataFrame, batch_id: int) -> None:
        routed = route_changes(drop_deletes(changes), read_rules()).persist()
        write_topics(routed, batch_id)
        write_dims(routed, batch_id)
        routed.unpersist()

    return write


def keyword_writer(path: str, read_dictionary: Callable[[], DataFrame], **runs: str) -> BatchWriter:
    """Split the keywords of every micro-batch of closed windows.

    A window leaves ``keyword_counts`` as a whole in one micro-batch, so words can be summed there.
    """
    return batch_writer(path, transform=lambda counts: word_counts(counts, read_dictionary(), **runs))
