"""Removal of repeated 200-byte strings by distributed suffix sorting (operator 5).

Suffixes are sorted by the difference cover algorithm (``suffix_sort``) in tasks of bounded size, and
neighbours in the order are compared. What meets in a task is chosen so that equal strings always meet
and strings that cannot repeat are never sorted:

* every window of 200 bytes has an anchor, the place in it whose hash is least; equal windows have the
  same anchor at the same distance, so only windows whose anchor text recurs can repeat;
* neighbouring windows with one anchor are a run; the bytes that a run covers are its form. Runs with
  equal forms repeat as a whole, however many copies there are, so copies are settled by counting and
  one run of each form stands for all;
* the forms of an anchor that has several are sent to one task, and the suffixes of all its anchors are
  sorted there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import mix, whole_groups
from tidemark.llm.common import SLICE_ROWS, add_columns, lookup, stored
from tidemark.llm.suffix_sort import repeated_windows

WIDTH = 200
# Bytes that an anchor's hash covers; a window of 200 has 129 places for it. Shorter common lines give
# no recurring anchors.
ANCHOR_BYTES = 72
# Window starts of a text that are looked at together, and bytes of forms sorted together.
SEGMENT = 1 << 20
SORT_BYTES = 1 << 19
# Anchors with more forms than this are settled window by window, spread over the cluster.
MOST_FORMS = 4096
# Keys (24 bytes each) of a lookup that is broadcast; a longer one is a shuffled join.
BROADCAST_KEYS = 200_000
# Fixed value: the base of the polynomial hash, any odd number.
BASE = 0xD6E8FEB86659FD93


class Powers:
    """Powers of an odd base and of its inverse modulo 2 ** 64, and a 64-bit value per byte."""

    def __init__(self) -> None:
        self.values = mix(np.arange(256, dtype=np.uint64))
        self.up, self.down = self._grow(1)

    @staticmethod
    def _grow(size: int) -> list[np.ndarray]:
        made = []
        for factor in (BASE, pow(BASE, -1, 1 << 64)):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate([out, out * np.uint64(pow(factor, len(out), 1 << 64))])
            made.append(out)
        return made

    def span_hashes(self, data: np.ndarray, size: int) -> np.ndarray:
        """Polynomial hashes of the ``size`` bytes from every place on; sums simply overflow."""
        if len(self.up) < len(data):
            self.up, self.down = self._grow(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=sums[1:])
        n = len(data) - size + 1
        return (sums[size:] - sums[:n]) * self.down[:n]


def find_runs(data: np.ndarray, valid: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, last, anchor place, anchor hash) of the runs of windows of a buffer.

    ``valid`` marks the starts of windows that lie in one text. The anchor of a window is its leftmost
    place with the least hash.
    """
    places = WIDTH - ANCHOR_BYTES + 1
    codes = powers.span_hashes(data, ANCHOR_BYTES)
    ranked = (codes ^ (codes >> np.uint64(29))) * np.uint64(BASE)
    ranked = (ranked & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(codes), dtype=np.uint64)
    # Least value of each stretch of ``places`` values, from minima ahead and behind within blocks.
    n = len(data) - WIDTH + 1
    padded = np.full(-(-len(ranked) // places) * places, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(ranked)] = ranked
    blocks = padded.reshape(-1, places)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:n], ahead[places - 1 : places - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | ~valid[: n - 1]] & valid[:n]
    start = np.flatnonzero(new)
    ends = np.r_[False, (anchor[1:] != anchor[:-1]) | ~valid[1:n]]
    last = np.flatnonzero(np.r_[ends[1:], True] & valid[:n])
    at = anchor[start]
    return start, last, at, mix(codes[at])


def segments(values: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """Buffers of whole texts or segments of long ones: bytes, valid window starts, (text, offset, begin)."""
    parts: list[bytes] = []
    marks: list[tuple[int, int, int]] = []
    size = 0

    def packed() -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        valid = np.zeros(size, bool)
        for part, (_, _, begin) in zip(parts, marks, strict=True):
            valid[begin : begin + len(part) - WIDTH + 1] = True
        return np.frombuffer(b"".join(parts), np.uint8), valid, list(marks)

    for i, value in enumerate(values):
        for offset in range(0, len(value) - WIDTH + 1, SEGMENT):
            part = value[offset : offset + SEGMENT + WIDTH - 1]
            if size and size + len(part) > SEGMENT:
                yield packed()
                parts, marks, size = [], [], 0
            marks.append((i, offset, size))
            parts.append(part)
            size += len(part)
    if size:
        yield packed()


def _source(text_keys: list[bytes], owner: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """A 64-bit name of a place in a text; rows with the same text give the same names."""
    seeds = np.array([int.from_bytes(key[:8], "big") for key in text_keys], np.uint64)
    return mix(seeds[owner] ^ mix(offset.astype(np.uint64))).view(np.int64)


def _runs(texts: DataFrame, schema: str, with_forms: bool) -> DataFrame:
    """Runs of all texts of (text_key, text); a task looks at each text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen = Powers(), set()
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                keys, values = [], []
                part = batch.slice(begin, SLICE_ROWS)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if key not in seen:
                        seen.add(key)
                        keys.append(key)
                        values.append((text or "").encode("utf-8", "surrogatepass"))
                for data, valid, marks in segments(values):
                    start, last, at, anchor = find_runs(data, valid, powers)
                    begins = np.array([mark[2] for mark in marks])
                    segment = np.searchsorted(begins, start, side="right") - 1
                    owner = np.array([mark[0] for mark in marks])[segment]
                    shift = np.array([mark[1] - mark[2] for mark in marks])[segment]
                    columns = [pa.array(anchor.view(np.int64)), pa.array(_source(keys, owner, at + shift))]
                    if with_forms:
                        raw = data.tobytes()
                        forms = [
                            hashlib.blake2b(raw[a : b + WIDTH], digest_size=16).digest()
                            for a, b in zip(start.tolist(), last.tolist(), strict=True)
                        ]
                        columns += [
                            pa.array(forms, pa.binary()), pa.array([keys[i] for i in owner.tolist()], pa.binary()),
                            pa.array(start + shift), pa.array(last + shift),
                        ]
                    names = ["anchor", "source", "form", "text_key", "start", "last"][: len(columns)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return texts.mapInArrow(run, schema)


def with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (text_key, rep_id and more) with the text of the row that (rep_id, text_key) names."""
    keys = wanted.select(F.col("text_key").alias("wanted_key"), "rep_id")
    if wanted.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    same = F.col("rep_id").eqNullSafe(F.col("doc_id")) & (F.col("wanted_key") == F.col("text_key"))
    texts = docs.select("doc_id", "text_key", "text").join(keys, same, "left_semi").drop("doc_id")
    return texts.join(wanted.drop("rep_id"), "text_key")


def open_forms(docs: DataFrame, texts: DataFrame, runs: DataFrame) -> DataFrame:
    """(anchor, text_key, start, settled, form): the bytes of one run of each form, read from its text."""
    run = F.struct("start", "last", "anchor", "settled")
    by_text = runs.groupBy("text_key").agg(F.collect_set(run).alias("runs"))
    wanted = stored(by_text.join(texts.select("text_key", "rep_id"), "text_key"), "wanted")
    schema = "anchor bigint, text_key binary, start bigint, settled boolean, form binary"
    rows = with_text(docs, wanted).select("text_key", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for i in range(batch.num_rows):
                key, text, found = (batch.column(c)[i].as_py() for c in range(3))
                if key in seen:
                    continue
                seen.add(key)
                value = text.encode("utf-8", "surrogatepass")
                for at in range(0, len(found), 4096):
                    some = found[at : at + 4096]
                    columns = [
                        pa.array([run["anchor"] for run in some], pa.int64()), pa.array([key] * len(some), pa.binary()),
                        pa.array([run["start"] for run in some], pa.int64()),
                        pa.array([run["settled"] for run in some], pa.bool_()),
                        pa.array([value[run["start"] : run["last"] + WIDTH] for run in some], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["anchor", "text_key", "start", "settled", "form"])

    return rows.mapInArrow(cut, schema)


def sorted_spans(forms: DataFrame) -> DataFrame:
    """(text_key, start, last): runs of window starts, of forms not settled, that repeat in another form.

    Forms of one anchor come to one task. Tasks sort the suffixes of up to about ``SORT_BYTES`` bytes at
    a time.
    """

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "anchor"):
            anchor = batch.column("anchor").to_numpy()
            cuts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1], True])
            sizes = np.cumsum(np.r_[0, pc.binary_length(batch.column("form")).to_numpy()])
            begin = 0
            for i in range(1, len(cuts)):
                # Whole anchors are taken together until the next one would be too much.
                if i + 1 < len(cuts) and sizes[cuts[i + 1]] - sizes[cuts[begin]] <= SORT_BYTES:
                    continue
                yield from spans(batch.slice(cuts[begin], cuts[i] - cuts[begin]))
                begin = i

    def spans(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, starts = part.column("text_key").to_pylist(), part.column("start").to_pylist()
        once = {place: i for i, place in enumerate(zip(keys, starts, strict=True))}
        chosen = sorted(once.values())
        forms = [part.column("form")[i].as_py() for i in chosen]
        lengths = np.array([len(form) for form in forms])
        offsets = np.cumsum(np.r_[0, lengths[:-1]])
        counts = lengths - WIDTH + 1
        owner = np.repeat(np.arange(len(forms)), counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        data = np.frombuffer(b"".join(forms), np.uint8)
        again = repeated_windows(data, offsets[owner] + within, WIDTH)
        settled = part.column("settled").to_pylist()
        again &= ~np.array([settled[i] for i in chosen])[owner]
        place = np.flatnonzero(again)
        if not len(place):
            return
        breaks = (np.diff(place) != 1) | (owner[place][1:] != owner[place][:-1])
        first, last = place[np.r_[True, breaks]], place[np.r_[breaks, True]]
        base = np.array([starts[i] for i in chosen])
        columns = [
            pa.array([keys[chosen[i]] for i in owner[first].tolist()], pa.binary()),
            pa.array(base[owner[first]] + within[first]), pa.array(base[owner[last]] + within[last]),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["text_key", "start", "last"])

    rows = forms.repartition("anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(sort, "text_key binary, start bigint, last bigint")


def counted_spans(forms: DataFrame) -> DataFrame:
    """As ``sorted_spans``, for anchors with very many forms: each window by its hash, counted and joined."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, start, settled, form = (batch.column(name)[i].as_py() for name in ("text_key", "start", "settled", "form"))
                n = len(form) - WIDTH + 1
                names = [hashlib.blake2b(form[at : at + WIDTH], digest_size=16).digest() for at in range(n)]
                columns = [
                    pa.array(names, pa.binary()), pa.array([key] * n, pa.binary()),
                    pa.array(np.arange(start, start + n)), pa.array([settled] * n, pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["window", "text_key", "start", "settled"])

    rows = forms.mapInArrow(windows, "window binary, text_key binary, start bigint, settled boolean")
    rows = rows.withColumn("source", F.xxhash64("text_key", "start"))
    least = rows.groupBy("window").agg(F.min("source").alias("least"), F.max("source").alias("most"))
    again = least.where("least <> most").select("window")
    found = rows.where("not settled").join(again, "window", "left_semi")
    return found.select("text_key", "start", F.col("start").alias("last"))


def repeated_spans(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_key, start, last): all window starts, as runs, whose 200 bytes start at another place too.

    Places are those of the distinct texts, one row of (text_key, rep_id, copies) each.
    """
    long = docs.where(F.octet_length("text") >= WIDTH).select("text_key", "text")
    places = _runs(long, "anchor bigint, source bigint", with_forms=False)
    least = places.groupBy("anchor").agg(F.min("source").alias("least"), F.max("source").alias("most"))
    # Written first, so that adaptive execution sees two plain sides and splits an anchor that is hot.
    recurring = stored(least.where("least <> most").select("anchor"), "anchors")
    schema = "anchor bigint, source bigint, form binary, text_key binary, start bigint, last bigint"
    live = stored(_runs(long, schema, with_forms=True).join(recurring, "anchor", "left_semi"), "runs")
    forms = live.groupBy("anchor", "form").agg(F.min("source").alias("one"), F.max("source").alias("most"))
    per_anchor = forms.groupBy("anchor").agg(F.count("*").alias("forms"))
    known = forms.join(per_anchor, "anchor").select(
        "anchor", "form", "one", (F.col("one") != F.col("most")).alias("settled"), "forms"
    )
    known = known.where("settled or forms > 1")
    marked = stored(live.join(known, ["anchor", "form"]).drop("form"), "marked")
    whole = marked.where("settled").select("text_key", "start", "last")
    single = marked.where("forms > 1 and source = one").select("text_key", "start", "last", "anchor", "settled")
    many = marked.where(F.col("forms") > MOST_FORMS).select("anchor").distinct()
    pieces = stored(open_forms(docs, texts, single), "forms")
    spans = sorted_spans(pieces.join(many, "anchor", "left_anti"))
    return whole.unionByName(spans).unionByName(counted_spans(pieces.join(many, "anchor", "left_semi")))


def merge_runs(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Byte ranges covered by windows whose starts run from first to last, joined where they touch."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + WIDTH)
        else:
            out.append([first, last + WIDTH])
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    Every byte covered by a 200-byte string that starts anywhere else too is removed, judged on the
    input. Null and empty texts have no bytes; texts below 200 bytes lose none. Repeated rows are
    documents of their own, so a text of 200 bytes or more that occurs twice is removed whole. A null
    doc_id is kept. Other columns are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("own_sha"))
    rows = rows.withColumn("text_key", F.substring(F.unhex("own_sha"), 1, 16))
    n_bytes = F.octet_length("text").cast("bigint")
    texts = rows.groupBy("text_key").agg(
        F.min("doc_id").alias("rep_id"), F.count("*").alias("copies"), F.max(n_bytes).alias("n_bytes")
    )
    texts = stored(texts, "texts")
    spans = stored(repeated_spans(rows, texts), "spans")
    lone = texts.where("copies = 1").select("text_key", "rep_id")
    by_text = spans.groupBy("text_key").agg(F.collect_set(F.struct("start", "last")).alias("spans")).join(lone, "text_key")
    cut_texts = with_text(rows, stored(by_text, "found")).select("text_key", F.struct("text", "spans").alias("both"))

    def cut(values: list[dict]) -> dict[str, list]:
        out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept_sha": []}
        for value in values:
            data = value["text"].encode("utf-8", "surrogatepass")
            digest, at, removed = hashlib.sha256(), 0, 0
            runs = merge_runs([(span["start"], span["last"]) for span in value["spans"]])
            for first, end in runs:
                digest.update(data[at:first])
                removed += end - first
                at = end
            digest.update(data[at:])
            for name, found in zip(out, (removed, len(runs), digest.hexdigest()), strict=True):
                out[name].append(found)
        return out

    found = add_columns(cut_texts, "both", cut, "n_removed bigint, n_spans bigint, kept_sha string")
    found = found.withColumn("copies", F.lit(1).cast("bigint"))
    copied = texts.where((F.col("copies") > 1) & (F.col("n_bytes") >= WIDTH)).select(
        "text_key", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"),
        F.sha2(F.lit(""), 256).alias("kept_sha"), "copies",
    )
    light = rows.select("doc_id", "text_key", n_bytes.alias("n_bytes"), "own_sha")
    out = lookup(light, found.unionByName(copied), ["text_key"], "copies")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha", "own_sha").alias("kept_sha256"),
    )
