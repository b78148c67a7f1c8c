"""Deterministic sharded WARC archives (operator 8).

Records are sorted by key range and written by one task per range, into files that are rolled by
compressed size. Headers and digests are made anew from the payload. A task writes under a temporary
name, renames, and leaves a manifest; the driver commits the archive with a manifest of manifests, so
files of failed or repeated attempts are never read. Ranges are cut at exact running sums of bytes in
the order of the keys, never at sampled quantiles, so the same rows give the same bytes in any layout.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SLICE_ROWS, lookup, stored

ROLL_BYTES = 32 << 20
# Payloads shorter than this are always written out.
REVISIT_BYTES = 100
# A range is full at this many bytes of payload or at this many records, whichever comes first.
SHARD_BYTES = 256 << 20
SHARD_ROWS = 10_000
# What a record weighs beside its payload.
HEAD_BYTES = 512
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, name string, records bigint, bytes bigint, sha256 string"
RECORD = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and "://" not in path else path)
    return fs.LocalFileSystem(), path


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a gzip member with headers in fixed order. A revisit carries no payload, only its size."""
    name = "null" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}|{url}|{digest}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-Id: {name}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if url is not None:
        # A line break or a sign outside ASCII in a URL would break the header, so it is kept as JSON text.
        head.insert(4, f"WARC-Target-URI: {json.dumps(url)[1:-1]}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    block = b"" if refers_to is not None else payload
    head.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(head).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, compresslevel=1, mtime=0)


def read_records(stream: io.RawIOBase, size: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive, one gzip member in memory at a time."""
    unpack, raw, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(size)
        if not data:
            break
        raw.append(unpack.decompress(data))
        rest = unpack.unused_data
        if unpack.eof:
            head, _, block = b"".join(raw).partition(b"\r\n\r\n")
            lines = head.decode("ascii").split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            yield fields, block[: int(fields["Content-Length"])]
            unpack, raw = zlib.decompressobj(31), []
    if any(raw):
        raise ValueError("the archive ends within a record")


def with_digest(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes and payload_digest; a null html is an empty payload."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    size = F.octet_length("payload").cast("bigint")
    return rows.withColumns({"payload_bytes": size, "payload_digest": F.sha2("payload", 256)})


def find_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the pages that repeat another page's payload, without payloads.

    Among equal payloads of ``REVISIT_BYTES`` or more the smallest page_id is the response. Rows that
    repeat that page_id are responses too, as they are the same page; a row with a null page_id is a
    revisit if its payload has a response with an id.
    """
    return _revisits(with_digest(pages))


def _revisits(known: DataFrame) -> DataFrame:
    """``find_revisits`` of rows whose digests are known."""
    rows = known.where(F.col("payload_bytes") >= REVISIT_BYTES).select("page_id", "payload_digest")
    groups = rows.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("uses"))
    found = lookup(rows, groups.where("uses > 1"), ["payload_digest"], "uses")
    return found.where(F.col("refers_to").isNotNull() & ~F.col("refers_to").eqNullSafe(F.col("page_id"))).distinct()


def shard_starts(known: DataFrame, shard_bytes: int, shard_rows: int) -> list[tuple[bool, int, str]]:
    """The first key of every shard, in order, as ``(page_id is not null, page_id, payload_digest)``.

    A record weighs its payload, at least an equal share of a shard of ``shard_rows``; a shard is the keys
    whose running weight begins within one more ``shard_bytes``. Running weights are exact: keys are sorted
    by Spark, their weights summed by partition and then within each, so where the sort cut them does not
    matter. Rows of one key stay together. One key per shard reaches the driver, about 40 bytes each.
    """
    least = max(1, shard_bytes // shard_rows)
    weight = F.sum(F.greatest(F.col("payload_bytes") + HEAD_BYTES, F.lit(least))).alias("weight")
    keys = [F.col(name).asc_nulls_first() for name in ("page_id", "payload_digest")]
    groups = known.groupBy("page_id", "payload_digest").agg(weight)
    # Written down, as the bounds of the sort are sampled anew whenever it runs.
    groups = stored(groups.repartitionByRange(*keys).withColumn("piece", F.spark_partition_id()), "warc-keys")
    done, before = 0, []
    for piece, total in groups.groupBy("piece").agg(F.sum("weight")).orderBy("piece").collect():
        before.append((piece, done))
        done += total
    if not before:
        return []
    pieces = F.broadcast(groups.sparkSession.createDataFrame(before, "piece int, before bigint"))
    earlier = Window.partitionBy("piece").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.sum("weight").over(earlier), F.lit(0)) + F.col("before")
    placed = groups.join(pieces, "piece").withColumn("running", running).withColumn("shard", F.expr(f"running div {shard_bytes}"))
    firsts = placed.groupBy("shard").agg(F.min(F.struct(F.col("page_id").isNotNull(), "page_id", "payload_digest")).alias("first"))
    return [(row[0], row[1] or 0, row[2]) for row, in firsts.orderBy("shard").select("first").collect()]


def write_archive(
    pages: DataFrame, path: str, roll_bytes: int = ROLL_BYTES, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Write one record per page below ``path`` and return the manifest, one row per file.

    ``path`` must be a folder that every executor reaches. Pages are dealt out by ranges of page_id and
    digest (``shard_starts``) and sorted within them, so the same rows give the same files whatever their
    layout. Payloads are shuffled once: what is known of revisits is sorted in before the pages it is
    about. Only page_id, url and html are read, so other columns cannot clash. An empty table gives an
    archive of no files. Files under temporary names that failed attempts left are removed at the end.
    """
    rows = with_digest(pages)
    known = stored(rows.select("page_id", "payload_digest", "payload_bytes"), "warc-digests")
    starts = shard_starts(known, shard_bytes, shard_rows)
    records = rows.withColumn("answer", F.lit(1)).unionByName(_revisits(known).withColumn("answer", F.lit(0)), allowMissingColumns=True)

    def shard_of(page_ids: pa.Array, digests: pa.Array) -> pa.Array:
        asked = zip(page_ids.to_pylist(), digests.to_pylist(), strict=True)
        return pa.array([bisect_right(starts, (page is not None, page or 0, digest)) - 1 for page, digest in asked], pa.int32())

    # Named types, as the function travels without this module's annotations.
    shard_of.__annotations__ = {"page_ids": pa.Array, "digests": pa.Array, "return": pa.Array}
    dealt = records.withColumn("shard", F.arrow_udf(shard_of, "int")("page_id", "payload_digest"))
    keys = [F.col(name).asc_nulls_first() for name in ("shard", "page_id", "payload_digest", "answer", "url")]
    dealt = dealt.repartitionById(max(1, len(starts)), "shard").sortWithinPartitions(*keys)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _place(path)
        attempt, made, open_file, shard, n_files, known = uuid.uuid4().hex, [], None, None, 0, {}

        def close() -> None:
            out, temporary, name, state = open_file
            out.close()
            try:
                store.move(temporary, f"{folder}/{name}")
            except OSError:
                # Some file systems do not replace: an earlier attempt has left the same bytes there.
                if store.get_file_info(f"{folder}/{name}").type == fs.FileType.NotFound:
                    raise
                store.delete_file(temporary)
            made.append({"shard": shard, "name": name, **state, "sha256": state["sha256"].hexdigest()})

        for batch in batches:
            for row in (row for i in range(0, batch.num_rows, SLICE_ROWS) for row in batch.slice(i, SLICE_ROWS).to_pylist()):
                if open_file and row["shard"] != shard:
                    close()
                    open_file = None
                if row["shard"] != shard:
                    shard, n_files = row["shard"], 0
                about = (row["page_id"], row["payload_digest"])
                if row["answer"] == 0:
                    known = {about: row["refers_to"]}
                    continue
                data = record_bytes(row["page_id"], row["url"], row["payload"], about[1], known.get(about))
                if open_file and open_file[3]["bytes"] + len(data) > roll_bytes:
                    close()
                    open_file = None
                if open_file is None:
                    name = f"part-{shard:06d}-{n_files:05d}.warc.gz"
                    n_files += 1
                    temporary = f"{folder}/_tmp-{attempt}-{name}"
                    store.create_dir(folder, recursive=True)
                    open_file = (
                        store.open_output_stream(temporary, compression=None),
                        temporary,
                        name,
                        {"records": 0, "bytes": 0, "sha256": hashlib.sha256()},
                    )
                open_file[0].write(data)
                state = open_file[3]
                state["records"] += 1
                state["bytes"] += len(data)
                state["sha256"].update(data)
        if open_file:
            close()
        if made:
            fields = [("shard", pa.int32()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]
            yield pa.RecordBatch.from_pylist(made, pa.schema([*fields, ("sha256", pa.string())]))

    manifest = dealt.mapInArrow(write, MANIFEST)
    # Writing the manifest runs the tasks; its commit is what makes the archive readable.
    manifest.write.json(f"{path.rstrip('/')}/_manifest")
    store, folder = _place(path)
    for entry in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if entry.base_name.startswith("_tmp-"):
            store.delete_file(entry.path)
    return read_manifest(pages.sparkSession, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/_manifest")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of a committed archive, digests checked against file contents and manifest.

    A revisit has no payload of its own (null); its size and digest come from its headers.
    """
    files = read_manifest(spark, path)
    files = files.repartition(max(1, files.count()), "name")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _place(path)
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ])
        for batch in batches:
            for file in batch.to_pylist():
                rows, held, count = [], 0, 0
                with store.open_input_stream(f"{folder}/{file['name']}", compression=None) as stream:
                    for fields, block in read_records(stream):
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(block).hexdigest() != digest:
                            raise ValueError(f"digest of record {fields['WARC-Record-ID']} does not hold")
                        page, refers = fields["X-Page-Id"], fields.get("X-Refers-To-Page")
                        url = fields.get("WARC-Target-URI")
                        rows.append({
                            "page_id": None if page == "null" else int(page),
                            "url": None if url is None else json.loads(f'"{url}"'),
                            "payload": block if kind == "response" else None,
                            "payload_bytes": int(fields["X-Payload-Length"]),
                            "payload_digest": digest,
                            "record_type": kind,
                            "refers_to": None if refers is None else int(refers),
                        })
                        count, held = count + 1, held + len(block)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if count != file["records"]:
                    raise ValueError(f"{file['name']} has {count} records, its manifest {file['records']}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(read, RECORD)
