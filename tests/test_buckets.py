import glob
import os
import random

import pytest

from tidemark.operators.latest import latest_rows
from tidemark.sources.buckets import BucketTable, upsert_writer
from tidemark.streaming import jobs

SCHEMA = "id bigint, name string, amount double, seq bigint"


@pytest.fixture
def make(spark, scratch):
    def build(buckets=40, label="buckets"):
        table = BucketTable(spark, scratch(label), spark.createDataFrame([], SCHEMA).schema, ["id"], buckets)
        table.create()
        return table

    return build


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_upserts_keep_the_newest_row_of_every_key(spark, make):
    table, rng, held, states = make(), random.Random(1), {}, []
    for version in range(1, 5):
        batch = [(rng.randrange(60), f"n{rng.randrange(9)}", None, rng.randrange(100) + version * 20) for _ in range(25)]
        batch = list({(row[0], row[3]): row for row in batch}.values())
        table.upsert(spark.createDataFrame([*batch, (None, "lost", 1.0, 999)], SCHEMA), version, ["seq"])
        for row in batch:
            if row[0] not in held or held[row[0]][3] < row[3]:
                held[row[0]] = row
        states.append(sorted(held.values(), key=repr))
        assert rows_of(table.read()) == states[-1]
    # Older versions stay readable; an empty batch makes none.
    table.upsert(spark.createDataFrame([], SCHEMA), 9, ["seq"])
    assert table.versions() == [0, 1, 2, 3, 4]
    assert [rows_of(table.read(version)) for version in range(5)] == [[], *states]


def test_a_version_writes_only_the_buckets_it_touches(spark, make):
    table = make()
    table.upsert(spark.range(400).selectExpr("id", "'a' name", "1.5D amount", "1L seq"), 1, ["seq"])
    table.upsert(spark.createDataFrame([(7, "b", 2.0, 2)], SCHEMA), 2, ["seq"])
    written = glob.glob(f"{table.path}/rows/version=2/bucket=*")
    assert len(glob.glob(f"{table.path}/rows/version=1/bucket=*")) == 40 and len(written) == 1
    # The files of all other buckets are not read either: an upsert works with them gone to pieces.
    for path in glob.glob(f"{table.path}/rows/version=1/bucket=*/*.parquet"):
        if os.path.basename(os.path.dirname(path)) != os.path.basename(written[0]):
            with open(path, "wb") as file:
                file.write(b"broken")
    table.upsert(spark.createDataFrame([(7, "c", 3.0, 3)], SCHEMA), 3, ["seq"])
    bucket = int(written[0].rsplit("=", 1)[1])
    assert ("c",) in table._held(table.manifest(3), [bucket]).where("id = 7").select("name").collect()


def test_retried_and_late_versions(spark, make):
    table = make(3)
    table.upsert(spark.createDataFrame([(1, "a", 1.0, 5), (2, "b", 1.0, 5)], SCHEMA), 1, ["seq"])
    for _ in range(2):
        table.upsert(spark.createDataFrame([(1, "old", 1.0, 4), (2, "new", 1.0, 6), (3, "c", 1.0, 1)], SCHEMA), 2, ["seq"])
    assert rows_of(table.read()) == [(1, "a", 1.0, 5), (2, "new", 1.0, 6), (3, "c", 1.0, 1)]
    # Equally old: the stored row stays.
    table.upsert(spark.createDataFrame([(3, "d", 1.0, 1)], SCHEMA), 3, ["seq"])
    assert (3, "c", 1.0, 1) in rows_of(table.read())
    # A version whose manifest was never written does not exist.
    spark.createDataFrame([(1, "lost", 1.0, 9)], SCHEMA).write.parquet(f"{table.path}/rows/version=4/bucket=0")
    assert "lost" not in {row[1] for row in rows_of(table.read())}


def test_stream_of_upserts(spark, make, stream_of, scratch):
    batches = [[(1, "a", 1.0, 1), (2, "b", 2.0, 2)], [(1, "c", 3.0, 3)], [(3, "d", None, 4), (1, "x", 0.0, 2)]]
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in batches]
    table = make(8)
    jobs.run_available(stream_of(*frames), upsert_writer(table, ["seq"]), scratch("upsert-checkpoint"))
    whole = spark.createDataFrame([row for rows in batches for row in rows], SCHEMA)
    assert rows_of(table.read()) == rows_of(latest_rows(whole, ["id"], ["seq"]).select(*whole.columns))


def changes(frame):
    return in_order((r["op"], r["before"], r["after"], r["seq"]) for r in frame.collect())


def in_order(found):
    return sorted(found, key=lambda change: (change[0], sorted((change[1] or change[2]).items(), key=repr).__repr__()))


def as_text(row):
    return {k: None if v is None else str(v) for k, v in zip(("id", "name", "amount", "seq"), row, strict=True)}


@pytest.mark.parametrize("buckets", [1, 5, 300])
def test_captured_changes_against_all_rows(spark, make, buckets):
    table, rng, before = make(buckets), random.Random(buckets), {}
    for version in range(1, 4):
        after = {i: row for i, row in before.items() if rng.random() > 0.1}
        for i in rng.sample(range(80), 30):
            after[i] = (i, rng.choice([None, "", "a", "b"]), rng.choice([None, 1.5, float("nan")]), rng.randrange(3))
        found = changes(table.capture(spark.createDataFrame(list(after.values()), SCHEMA).repartition(3), version))
        wanted = []
        for i in sorted({*before, *after}):
            old, new = before.get(i), after.get(i)
            if repr(old) != repr(new):
                op = "CREATE" if old is None else "DELETE" if new is None else "UPDATE"
                texts = [None if row is None else {k: "NaN" if v == "nan" else v for k, v in as_text(row).items()} for row in (old, new)]
                wanted.append((op, *texts, version))
        assert found == in_order(wanted)
        assert repr(rows_of(table.read())) == repr(sorted(after.values(), key=repr))
        before = after
    assert changes(table.capture(spark.createDataFrame(list(before.values()), SCHEMA), 4)) == []
    assert table.versions()[-1] == 3
    assert {c[0] for c in changes(table.capture(spark.createDataFrame([], SCHEMA), 5))} == {"DELETE"}
    assert rows_of(table.read()) == [] and len(rows_of(table.read(3))) == len(before)


def test_capture_leaves_unchanged_buckets_alone(spark, make):
    table = make(64)
    rows = spark.range(500).selectExpr("id", "'a' name", "1.5D amount", "1L seq")
    table.capture(rows, 1)
    one = rows.selectExpr("id", "if(id = 7, 'b', name) name", "amount", "seq")
    leaves = one.withColumn("bucket", table._bucket()).groupBy("bucket").agg(*table._digest())
    touched = table.changed_buckets(leaves.selectExpr("cast(bucket as bigint) node", "n", "digest"), 1)
    assert len(touched) == 1
    for path in glob.glob(f"{table.path}/rows/version=1/bucket=*/*.parquet"):
        if f"/bucket={touched[0]}/" not in path:
            with open(path, "wb") as file:
                file.write(b"broken")
    found = changes(table.capture(one, 2))
    assert [(c[0], c[1]["name"], c[2]["name"], c[2]["id"]) for c in found] == [("UPDATE", "a", "b", "7")]
    assert len(glob.glob(f"{table.path}/rows/version=2/bucket=*")) == 1
