"""A change log as a streaming source with offsets of its own.

A log is a folder of versions that are only ever added: ``changes/version=<v>`` holds the rows of one
version, ``snapshots/version=<v>`` the whole state after it. A version is there once Spark has marked its
folder as a success, so readers never see half of one. The source gives the newest snapshot first and
then every later version; what has been read is in the stream's own checkpoint.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StructType

# The source runs in processes of its own, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHANGES, SNAPSHOTS = "changes", "snapshots"
# Column added to every row: the version it belongs to.
VERSION = "version"


def append_changes(rows: DataFrame, path: str, version: int) -> None:
    """Add a version to the log. Repeating it after a failure leaves one copy."""
    rows.write.mode("overwrite").parquet(f"{path}/{CHANGES}/{VERSION}={version}")


def append_snapshot(rows: DataFrame, path: str, version: int) -> None:
    """Add the state after ``version``, so that new readers need not read what came before."""
    rows.write.mode("overwrite").parquet(f"{path}/{SNAPSHOTS}/{VERSION}={version}")


@dataclass
class LogFile(InputPartition):
    """A file of one version: the unit a task reads."""

    path: str
    version: int


class ChangeLogReader(DataSourceStreamReader):
    """Offsets are versions. The first one also names the snapshot the stream begins with.

    Spark writes an offset down before it runs the micro-batch up to it, so a batch that is repeated
    reads the same versions, and the same snapshot, however the log has grown since.
    """

    def __init__(self, path: str, schema: StructType, versions_per_batch: int) -> None:
        self.path, self.schema, self.step = path.rstrip("/"), schema, versions_per_batch
        self.at: int | None = None

    def _folder(self):
        """The file system and the path on it."""
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.path)

    def _versions(self, kind: str) -> list[int]:
        """Finished versions, rising."""
        from pyarrow.fs import FileSelector, FileType

        system, root = self._folder()
        found = []
        for entry in system.get_file_info(FileSelector(f"{root}/{kind}", allow_not_found=True)):
            name, _, number = entry.base_name.partition("=")
            if entry.type == FileType.Directory and name == VERSION:
                if system.get_file_info(f"{entry.path}/_SUCCESS").type == FileType.File:
                    found.append(int(number))
        return sorted(found)

    def initialOffset(self) -> dict:
        return {"version": -1, "snapshot": -1}

    def latestOffset(self) -> dict:
        """The newest version, or the next few where a batch is bounded.

        A gap ends what can be read: versions after one that is not finished yet wait for it.
        """
        snapshots, changes = self._versions(SNAPSHOTS), self._versions(CHANGES)
        first = snapshots[-1] if snapshots else -1
        whole = max(first, self.at if self.at is not None else -1)
        if whole < 0 and changes:
            whole = changes[0] - 1
        there = set(changes)
        start = whole
        while whole + 1 in there and (self.step <= 0 or whole - start < self.step):
            whole += 1
        return {"version": whole, "snapshot": first}

    def partitions(self, start: dict, end: dict) -> list[LogFile]:
        from pyarrow.fs import FileSelector

        self.at = end["version"]
        system, root = self._folder()
        folders = []
        after = start["version"]
        if after < 0 and end["snapshot"] >= 0:
            after = end["snapshot"]
            folders.append((f"{root}/{SNAPSHOTS}/{VERSION}={after}", after))
        folders += [(f"{root}/{CHANGES}/{VERSION}={v}", v) for v in self._versions(CHANGES) if after < v <= end["version"]]
        return [
            LogFile(entry.path, version)
            for folder, version in folders
            for entry in sorted(system.get_file_info(FileSelector(folder)), key=lambda entry: entry.path)
            if entry.base_name.endswith(".parquet")
        ]

    def read(self, partition: LogFile) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = self._folder()
        wanted = to_arrow_schema(self.schema)
        with system.open_input_file(partition.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(batch_size=4096):
                marked = pa.array([partition.version] * batch.num_rows, pa.int64())
                columns = [marked if name == VERSION else batch.column(name) for name in wanted.names]
                table = pa.Table.from_arrays(columns, names=wanted.names).cast(wanted)
                yield from table.to_batches()

    def commit(self, end: dict) -> None:
        """Nothing to do: the log is never cut, and the checkpoint holds what has been read."""

    def stop(self) -> None:
        pass


class ChangeLogSource(DataSource):
    """``spark.readStream.format("change_log")`` with the options ``path`` and ``versionsPerBatch``."""

    @classmethod
    def name(cls) -> str:
        return "change_log"

    def streamReader(self, schema: StructType) -> ChangeLogReader:
        return ChangeLogReader(self.options["path"], schema, int(self.options.get("versionsPerBatch", "0")))


def read_changelog(spark: SparkSession, path: str, schema: str | StructType, versions_per_batch: int = 0) -> DataFrame:
    """The log as a stream: rows of ``schema`` and their ``version``, the newest snapshot first.

    Executors and the driver's Python must reach ``path`` by a file system that Arrow knows: a mounted
    folder or an object store. ``versions_per_batch`` bounds a micro-batch; 0 takes all there is. With the
    trigger "available now" a run that finds a micro-batch begun by a failed one finishes that batch; what
    is newer comes with the next run.
    """
    spark.dataSource.register(ChangeLogSource)
    fields = spark.createDataFrame([], schema).schema
    whole = StructType(list(fields.fields)).add(VERSION, LongType())
    reader = spark.readStream.format("change_log").schema(whole).option("path", path)
    return reader.option("versionsPerBatch", versions_per_batch).load()
