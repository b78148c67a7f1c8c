import gzip
import hashlib
import io
import os

import pytest

from tidemark.llm import warc

PAGES = "page_id bigint, url string, html string, shard int, payload string"
LONG = "<p>" + "täxt " * 40


def rows():
    pages = [(i, f"http://h{i % 3}.example/ü\n{i}", LONG if i % 4 == 0 else f"<p>{i}" + "x" * i) for i in range(200)]
    pages += [(500, None, None), (501, "u", None), (502, "u", ""), (503, "s", "same"), (504, "s", "same"), (None, "n", LONG), (7, "again", LONG)]
    pages += [(2, pages[2][1], pages[2][2]), (600, "big", "é" * 300_000)]
    return [(*page, 1, "p") for page in pages]


def wanted(pages):
    first = {}
    for page, _, html, *_ in pages:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, url, html, *_ in pages:
        data = (html or "").encode()
        other = first.get(data) if first.get(data) != page else None
        out.append((page, url, None if other is not None else data, len(data), hashlib.sha256(data).hexdigest(), "response" if other is None else "revisit", other))
    return sorted(map(repr, out))


def test_archive_gives_the_pages_back(spark, scratch):
    pages = spark.createDataFrame(rows(), PAGES).repartition(5)
    path = scratch("warc")
    manifest = warc.write_archive(pages, path, roll_bytes=4000, shard_rows=40)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows())
    assert manifest.count() > 6
    found = warc.read_archive(spark, path)
    assert sorted(repr(tuple(row[:2]) + (None if row[2] is None else bytes(row[2]),) + tuple(row[3:])) for row in found.collect()) == wanted(rows())


def test_same_rows_give_the_same_bytes_and_no_temporary_files(spark, scratch):
    sums = []
    for n in (2, 5):
        path = scratch("warc")
        pages = spark.createDataFrame(rows(), PAGES).repartition(n)
        found = warc.write_archive(pages, path, roll_bytes=20_000, shard_rows=1000).orderBy("name").collect()
        assert not [name for name in os.listdir(path) if name.startswith("_tmp")]
        for row in found:
            with open(f"{path}/{row['name']}", "rb") as file:
                assert hashlib.sha256(file.read()).hexdigest() == row["sha256"]
        sums.append([row["sha256"] for row in found])
    assert sums[0] == sums[1]


def test_any_layout_gives_the_same_shards(spark, scratch):
    n = 30_000
    made = spark.range(n).selectExpr(
        "id * 7919 % 100003 AS page_id", "concat('u', id) AS url", "repeat(concat('<p>', id % 9000), 1 + id % 40) AS html"
    )
    sums = []
    for layout in (made.repartition(2), made.repartition(7, "url"), made.orderBy("url").coalesce(3)):
        path = scratch("warc")
        found = warc.write_archive(layout, path, roll_bytes=200_000, shard_rows=100, shard_bytes=150_000).orderBy("name").collect()
        sums.append([(row["name"], row["records"], row["sha256"]) for row in found])
        assert max(row["records"] for row in found) <= 101
        assert len(found) > 250
    assert sums[0] == sums[1] == sums[2]


def test_left_over_temporary_files_are_removed(spark, scratch):
    path = scratch("warc")
    os.makedirs(path)
    with open(f"{path}/_tmp-gone-part-000000-00000.warc.gz", "wb") as file:
        file.write(b"half a fi")
    warc.write_archive(spark.createDataFrame(rows(), PAGES), path)
    assert not [name for name in os.listdir(path) if name.startswith("_tmp")]
    assert warc.read_archive(spark, path).count() == len(rows())


def test_a_changed_file_is_found(spark, scratch):
    path = scratch("warc")
    name = warc.write_archive(spark.createDataFrame(rows()[:1], PAGES), path).first()["name"]
    with open(f"{path}/{name}", "rb") as file:
        data = gzip.decompress(file.read()).replace(b"x", b"y").replace("täxt".encode(), "tüxt".encode())
    with open(f"{path}/{name}", "wb") as file:
        file.write(gzip.compress(data))
    with pytest.raises(Exception, match="digest"):
        warc.read_archive(spark, path).collect()


def test_records_are_read_in_small_steps():
    data = b"".join(warc.record_bytes(i, f"u{i}", b"p" * i, "d", None) for i in range(50))
    assert [len(block) for _, block in warc.read_records(io.BytesIO(data), size=7)] == list(range(50))
    with pytest.raises(ValueError, match="within a record"):
        list(warc.read_records(io.BytesIO(data[:-5])))


def test_empty_table(spark, scratch):
    path = scratch("warc")
    warc.write_archive(spark.createDataFrame([], PAGES), path)
    assert warc.read_archive(spark, path).count() == 0
