import os

import pytest

from tidemark.sources import changelog
from tidemark.sources.tables import batch_writer
from tidemark.streaming import jobs

SCHEMA = "id bigint, name string, tags map<string,string>"


def frame(spark, names, first=0):
    return spark.createDataFrame([(first + i, name, {"k": name}) for i, name in enumerate(names)], SCHEMA)


@pytest.fixture
def log(scratch):
    return scratch("log")


@pytest.fixture
def run(spark, scratch, log):
    """Read what is new into a table; its rows as (batch, version, name)."""
    path, checkpoint = scratch("read"), scratch("read-checkpoint")

    def read(write=None, **options):
        stream = changelog.read_changelog(spark, log, SCHEMA, **options)
        jobs.run_available(stream, write or batch_writer(path), checkpoint)
        rows = spark.read.parquet(path).select("batch_id", "version", "name", "tags").collect()
        assert all(row["tags"] == {"k": row["name"]} for row in rows if row["name"])
        return sorted((row["version"], row["name"]) for row in rows)

    return read


def test_snapshot_first_then_every_version_once(spark, log, run):
    changelog.append_changes(frame(spark, ["lost in the snapshot"]), log, 0)
    changelog.append_snapshot(frame(spark, ["s1", "s2"]).repartition(2), log, 1)
    changelog.append_changes(frame(spark, ["a"]), log, 2)
    first = [(1, "s1"), (1, "s2"), (2, "a")]
    assert run() == first
    # Started again from its checkpoint: nothing lost, nothing twice, also when there is nothing new.
    assert run() == first
    changelog.append_changes(frame(spark, ["b", "c"]).repartition(2), log, 3)
    changelog.append_snapshot(frame(spark, ["later snapshot"]), log, 3)
    changelog.append_changes(frame(spark, [None]), log, 4)
    assert sorted(run(), key=str) == sorted([*first, (3, "b"), (3, "c"), (4, None)], key=str)


def test_without_a_snapshot_and_empty_versions(spark, log, run):
    changelog.append_changes(frame(spark, ["a"]), log, 0)
    changelog.append_changes(frame(spark, []), log, 1)
    changelog.append_changes(frame(spark, ["b"]), log, 2)
    assert run() == [(0, "a"), (2, "b")]


def test_unfinished_versions_wait(spark, log, run):
    changelog.append_changes(frame(spark, ["a"]), log, 0)
    changelog.append_changes(frame(spark, ["half"]), log, 1)
    changelog.append_changes(frame(spark, ["b"]), log, 2)
    mark = f"{log.removeprefix('file://')}/changes/version=1/_SUCCESS"
    os.rename(mark, f"{mark}-held")
    assert run() == [(0, "a")]
    os.rename(f"{mark}-held", mark)
    assert run() == [(0, "a"), (1, "half"), (2, "b")]


def test_a_failed_batch_reads_the_same_rows_again(spark, log, run, scratch):
    changelog.append_snapshot(frame(spark, ["s"]), log, 0)
    changelog.append_changes(frame(spark, ["a"]), log, 1)
    seen = []

    def fail(rows, batch_id):
        seen.append((batch_id, sorted(row["name"] for row in rows.collect())))
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(write=fail)
    # The log has grown, and a newer snapshot is there: the batch begun is still the same.
    changelog.append_changes(frame(spark, ["b"]), log, 2)
    changelog.append_snapshot(frame(spark, ["newer snapshot"]), log, 2)
    assert seen == [(0, ["a", "s"])]
    # A run over all there is only finishes the batch it finds begun; the next one goes on.
    assert run() == [(0, "s"), (1, "a")]
    assert run() == [(0, "s"), (1, "a"), (2, "b")]


def test_columns_are_taken_by_name(spark, log):
    reader = changelog.ChangeLogReader(log, frame(spark, []).schema.add("version", "long"), 0)
    assert reader.latestOffset() == reader.initialOffset()
    changelog.append_changes(frame(spark, ["a"]).select("tags", "name", "id"), log, 5)
    end = reader.latestOffset()
    assert end == {"version": 5, "snapshot": -1}
    files = reader.partitions(reader.initialOffset(), end)
    assert [batch.to_pylist() for one in files for batch in reader.read(one)] == [
        [{"id": 0, "name": "a", "tags": [("k", "a")], "version": 5}]
    ]
    bounded = changelog.ChangeLogReader(log, frame(spark, []).schema, 1)
    changelog.append_changes(frame(spark, ["b"]), log, 6)
    assert bounded.latestOffset()["version"] == 5
    bounded.partitions(bounded.initialOffset(), bounded.latestOffset())
    assert bounded.latestOffset()["version"] == 6
