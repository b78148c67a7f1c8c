"""N-gram Jaccard join by T-occurrence search (operator 2).

Texts are sets of word shingles. Two sets link if their overlap reaches a threshold, so a set that links
to another shares at least T shingles with it. DivideSkip splits a set's inverted lists by length: the
short ones are merged and give the candidates, the long ones are only probed by binary search for them.

Equal sets are one class. A first round joins classes that share a least hash, block by block, in
memory. The second round loses no link: the lists of each set's rarest shingles, as many as guarantee
that two linking sets meet, are merged across the cluster, pairs already connected are left out, and
the rest is confirmed on the sets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from tidemark.llm.arrays import WordHashes, mix, shingles, whole_groups
from tidemark.llm.common import SLICE_ROWS, lookup, stored
from tidemark.llm.components import components

# Counters of the shingle sketch (fixed size), and how many go into one row.
CELL_BITS, CELLS_PER_ROW = 20, 4096
# Sets, and shingles, of one in-memory block of the first round.
BLOCK_SETS, BLOCK_SHINGLES = 512, 2_000_000
# Groups of the first round have more classes than this under the first and the second least hash; smaller
# ones are left to the second round, whose pairs are then as few.
LEAST_GROUP = {"low_0": 2, "low_1": 16}
# Members of one list that are compared in one task of the second round.
LIST_BLOCK = 4096
# Keys (32 bytes each) of a lookup that is broadcast; a longer one is a shuffled join.
BROADCAST_KEYS = 200_000
# The weight of list length in DivideSkip's choice of the number of long lists.
SKIP_WEIGHT = 0.0085


def set_of(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    return shingles(hashes.of((text or "").encode("utf-8", "surrogatepass").lower().split()), words)


def class_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def class_no(key: bytes) -> int:
    return int.from_bytes(key[:8], "big", signed=True)


def overlap_holds(shared: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, from the intersection and the sum of sizes."""
    return 100 * shared >= percent * (sizes - shared)


def divide_skip(sets: list[np.ndarray], percent: int, all_links: bool = False) -> list[tuple[int, int]]:
    """Links between sorted sets: enough to connect all that link, or with ``all_links`` every one.

    Sets are taken by size. The lists of a set hold the smaller sets that can still reach the overlap;
    the longest lists are left out of the merge and probed for the candidates only.
    """
    m = len(sets)
    order = sorted(range(m), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    tokens = np.concatenate([sets[i] for i in order]) if m else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(m), sizes)
    _, token_no = np.unique(tokens, return_inverse=True)
    # One sorted array holds all lists: list number, then owner in the order of size.
    entries = token_no * m + owner
    index = np.sort(entries)
    owner_at = index % m if m else index
    starts = np.r_[0, np.cumsum(sizes)]
    least = np.searchsorted(sizes, np.ceil(percent * sizes / 100).astype(int))
    parent = list(range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for x in range(m):
        low, size = int(least[x]), int(sizes[x])
        if size == 0 or low >= x:
            continue
        lists = token_no[starts[x] : starts[x + 1]]
        first, end = np.searchsorted(index, lists * m + low), np.searchsorted(index, lists * m + x)
        length = end - first
        by_length = np.argsort(length, kind="stable")
        needed = -(-percent * size // 100)
        n_long = min(needed - 1, int(needed / (SKIP_WEIGHT * np.log2(max(2, length[by_length[-1]])) + 1)))
        short, long = by_length[: size - n_long], by_length[size - n_long :]
        spans = length[short]
        total = int(spans.sum())
        if total == 0:
            continue
        ends = np.cumsum(spans)
        merged = owner_at[np.arange(total) + np.repeat(first[short] - (ends - spans), spans)]
        counts = np.bincount(merged - low, minlength=x - low)
        found = np.flatnonzero(counts >= needed - n_long)
        if not all_links and len(found):
            mine = root(x)
            found = found[[root(int(i) + low) != mine for i in found]]
        if not len(found):
            continue
        shared = counts[found]
        if n_long:
            step = max(1, 500_000 // len(found))
            for at in range(0, len(long), step):
                wanted = (lists[long[at : at + step], None] * m + (found + low)).ravel()
                place = np.minimum(np.searchsorted(index, wanted), len(index) - 1)
                shared = shared + (index[place] == wanted).reshape(-1, len(found)).sum(0)
        for y in found[overlap_holds(shared, size + sizes[found + low], percent)] + low:
            if all_links or root(x) != root(int(y)):
                parent[root(x)] = root(int(y))
                links.append((order[x], order[int(y)]))
    return links


def set_facts(texts: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """One row per text with its class, and the sketch that counts shingles over all texts.

    Rows: the columns of ``texts`` without ``text``, n_shingles, class_key, low_0 and low_1 (least hashes
    under two orders). A task counts each class once.
    """
    kept = [name for name in texts.columns if name != "text"]
    types = [(name, to_arrow_type(texts.schema[name].dataType)) for name in kept]
    made = [
        ("n_shingles", pa.int64()), ("class_key", pa.binary()), ("low_0", pa.int64()), ("low_1", pa.int64()),
        ("cell_row", pa.int32()), ("cells", pa.binary()),
    ]
    schema = pa.schema([*types, *made])
    more = "n_shingles bigint, class_key binary, low_0 bigint, low_1 bigint, cell_row int, cells binary"
    # Rows of the sketch leave the columns of the texts empty.
    own = [StructField(field.name, field.dataType) for field in texts.select(*kept).schema]
    ddl = StructType([*own, *StructType.fromDDL(more)])
    at = texts.columns.index("text")
    kept_at = [texts.columns.index(name) for name in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, counts = WordHashes(), set(), np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                facts, fresh = [], []
                for text in part.column(at).to_pylist():
                    values = set_of(text, words, hashes)
                    if not len(values):
                        facts.append((0, None, None, None))
                        continue
                    key = class_key(values)
                    if key not in seen:
                        seen.add(key)
                        fresh.append(values)
                    low_0, low_1 = values[0], mix(values ^ np.uint64(0x5851F42D4C957F2D)).min()
                    facts.append((len(values), key, int(low_0.astype(np.int64)), int(low_1.astype(np.int64))))
                if fresh:
                    cells = (np.concatenate(fresh) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
                    counts += np.bincount(cells, minlength=len(counts)).astype(np.uint32)
                columns = [pa.array(values, field[1]) for values, field in zip(zip(*facts, strict=True), made, strict=False)]
                empty = [pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.binary())]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept_at], *columns, *empty], schema=schema)
        blocks = counts.reshape(-1, CELLS_PER_ROW)
        used = np.flatnonzero(blocks.any(1))
        if len(used):
            packed = [zlib.compress(blocks[i].astype("<u4").tobytes(), 1) for i in used]
            nulls = [pa.nulls(len(used), field.type) for field in schema][:-2]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(used, pa.int32()), pa.array(packed, pa.binary())], schema=schema)

    rows = stored(texts.mapInArrow(run, ddl), "sets")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(zlib.decompress(packed), "<u4").astype(np.uint64)
                sums[row] = sums[row] + values if row in sums else values
        if sums:
            totals = [np.minimum(value, 0xFFFFFFFF).astype("<u4").tobytes() for value in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(totals)], ["cell_row", "cells"])

    n = (1 << CELL_BITS) // CELLS_PER_ROW
    parts = rows.where("cell_row is not null").select("cell_row", "cells").repartition("cell_row")
    sketch = np.zeros((n, CELLS_PER_ROW), np.uint32)
    # A fixed number of counters reaches the driver, whatever the number of texts.
    for row in parts.mapInArrow(add_up, "cell_row int, cells binary").collect():
        sketch[row["cell_row"]] = np.frombuffer(row["cells"], "<u4")
    return rows.where("cell_row is null").drop("cell_row", "cells"), sketch.ravel()


def texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The columns of ``wanted`` but (rep_id, rep_text), with the text that these two name."""
    if wanted.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    same = F.col("rep_id").eqNullSafe(F.col("doc_id")) & (F.col("rep_text") == F.col("text_hash"))
    rows = texts.join(wanted, same).drop("rep_id", "rep_text", "doc_id", "text_hash")
    key_at = rows.columns.index("class_key")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows that repeat an id and text give the text once per task.
        seen = set()
        for batch in batches:
            keys = batch.column(key_at).to_pylist()
            yield batch.filter(pa.array([not (key in seen or seen.add(key)) for key in keys], pa.bool_()))

    return rows.mapInArrow(once, rows.schema)


def links_in_blocks(texts: DataFrame, wanted: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between classes of one block: enough to connect all that link there.

    ``wanted`` has one row per class with (rep_id, rep_text) and its ``blocks``. The texts are what is
    shuffled, as they take less room than their sets of 64-bit hashes.
    """
    rows = texts_of(texts, wanted).withColumn("block", F.explode("blocks")).drop("blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in whole_groups(batches, "block"):
            block = batch.column("block").to_numpy()
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            links: list[tuple[bytes, bytes]] = []
            for start, end in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(start, end - start)
                found = dict(zip(part.column("class_key").to_pylist(), part.column("text").to_pylist(), strict=True))
                keys = sorted(found)
                sets = [set_of(found[key], words, hashes) for key in keys]
                links += [(keys[i], keys[j]) for i, j in divide_skip(sets, percent)]
            if links:
                sides = [pa.array(side, pa.binary()) for side in zip(*links, strict=True)]
                yield pa.RecordBatch.from_arrays(sides, ["a", "b"])

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a binary, b binary")


def block_counts(groups: DataFrame) -> DataFrame:
    """Adds ``n``, the number of blocks that ``sets`` sets with ``size`` shingles make."""
    n = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("size") / BLOCK_SHINGLES))
    return groups.withColumn("n", F.greatest(n, F.lit(1)))


def links_by_least_hash(texts: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """First round: links between classes that share a least hash, found in blocks."""
    wanted = None
    for name in ("low_0", "low_1"):
        groups = classes.groupBy(name).agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("size"))
        groups = block_counts(groups.where(F.col("sets") > LEAST_GROUP[name]))
        part = F.pmod(F.xxhash64("class_key", F.lit(name)), F.col("n"))
        rows = classes.join(groups, name).select(
            "class_key", "rep_id", "rep_text", F.xxhash64(F.lit(name), name, part).alias("block")
        )
        wanted = rows if wanted is None else wanted.unionByName(rows)
    blocks = wanted.groupBy("class_key", "rep_id", "rep_text").agg(F.collect_set("block").alias("blocks"))
    return links_in_blocks(texts, stored(blocks, "blocks"), words, percent)


def rare_lists(texts: DataFrame, sketch: np.ndarray, words: int, percent: int) -> DataFrame:
    """(token, class_no, n, place, bits_0, bits_1, most): entries of the short lists.

    Of a set of n shingles, the n - T + 1 rarest by the sketch; T is the overlap that any link needs.
    Which counts the sketch has does not matter for the result: any one order of all shingles guarantees
    that two linking sets share one of these. The bits are parities of the set by hash, for a bound.
    ``most`` is the sketch's count, which a list's length never exceeds. ``class_no`` is the start of
    the class key; should two classes share it, they are told apart when pairs are confirmed.
    """
    sent = texts.sparkSession.sparkContext.broadcast(sketch.astype("<u4").tobytes())
    names = ["token", "class_no", "n", "place", "bits_0", "bits_1", "most"]
    schema = "token bigint, class_no bigint, n int, place int, bits_0 bigint, bits_1 bigint, most bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hashes, seen = np.frombuffer(sent.value, "<u4"), WordHashes(), set()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                tokens, keys, sizes, places, bits, most = [], [], [], [], [], []
                for text in batch.column(0).slice(start, SLICE_ROWS).to_pylist():
                    values = set_of(text, words, hashes)
                    n = len(values)
                    key = class_key(values)
                    if n == 0 or key in seen:
                        continue
                    seen.add(key)
                    width = n + (-percent * n // 100) + 1
                    rank = counts[(values >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                    chosen = np.lexsort((values, rank))[:width]
                    parity = np.bincount((values & np.uint64(127)).astype(np.int64), minlength=128) & 1
                    tokens.append(values[chosen])
                    keys.append(np.full(width, class_no(key)))
                    sizes.append(np.full(width, n))
                    places.append(np.arange(width))
                    most.append(rank[chosen].astype(np.int64))
                    bits.append(np.repeat(np.packbits(parity.astype(np.uint8)).view("<i8")[None], width, axis=0))
                if not keys:
                    continue
                both = np.concatenate(bits)
                columns = [
                    pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(keys)),
                    pa.array(np.concatenate(sizes), pa.int32()), pa.array(np.concatenate(places), pa.int32()),
                    pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])),
                    pa.array(np.concatenate(most)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return texts.select("text").mapInArrow(run, schema)


def candidate_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of class numbers that meet in a short list and may reach the overlap.

    ``entries`` carries the component of each class; pairs within one are connected already. Lists that
    may have more than ``LIST_BLOCK`` members are counted and dealt out as pairs of blocks. Kept pairs
    pass bounds that every link passes: sizes, places in both lists, and the number of parities that
    differ.
    """
    may_be_long = F.col("most") > LIST_BLOCK
    lists = entries.where(may_be_long).groupBy("token").agg(F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("blocks"))
    long = entries.where(may_be_long).join(lists, "token")
    rows = entries.where(~may_be_long).withColumn("blocks", F.lit(1)).unionByName(long)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("class_no"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))
    # In a pair of two blocks only members of different ones are compared.
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    packed = F.shiftleft(F.col("n").cast("bigint"), 32) + F.shiftleft(F.col("place").cast("bigint"), 2) + side
    rows = rows.select(meet.alias("meet"), "class_no", "component", "bits_0", "bits_1", packed.alias("packed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "meet"):
            meet, number, component, packed = (
                batch.column(name).to_numpy() for name in ("meet", "class_no", "component", "packed")
            )
            n, place, side = packed >> 32, (packed & 0xFFFFFFFF) >> 2, packed & 3
            bits = [batch.column(name).to_numpy().view(np.uint64) for name in ("bits_0", "bits_1")]
            at, gap, found, held = np.arange(len(meet)), 0, [], 0
            while len(at):
                gap += 1
                at = at[at + gap < len(meet)]
                at = at[meet[at + gap] == meet[at]]
                to = at + gap
                low, high = np.minimum(n[at], n[to]), np.maximum(n[at], n[to])
                ok = (component[at] != component[to]) & (100 * low >= percent * high)
                ok &= (side[at] == 0) | (side[at] != side[to])
                i, j = at[ok], to[ok]
                # The overlap if this is the first shared shingle in the order of both.
                most = np.minimum(n[i] - place[i], n[j] - place[j])
                differ = sum(np.bitwise_count(word[i] ^ word[j]).astype(np.int64) for word in bits)
                size = n[i] + n[j]
                most = np.minimum(most, (size - differ) // 2)
                ok = overlap_holds(most, size, percent)
                found.append(np.sort(np.stack([number[i[ok]], number[j[ok]]]), axis=0))
                held += int(ok.sum())
                if held > 100_000:
                    yield pairs(found)
                    found, held = [], 0
            if held:
                yield pairs(found)

    def pairs(found: list[np.ndarray]) -> pa.RecordBatch:
        once = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(once[0]), pa.array(once[1])], ["a", "b"])

    rows = rows.repartition("meet").sortWithinPartitions("meet")
    return rows.mapInArrow(run, "a bigint, b bigint").where("a <> b").distinct()


def confirmed(texts: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that connect all classes that pairs connect by a link.

    Pairs that hang together are one block, in which each text is needed once. Where that would be more
    than a block may hold, each pair is confirmed by itself: the smaller set's shingles are probed in
    the larger one.
    """
    numbered = classes.withColumn("class_no", F.expr("cast(conv(hex(substring(class_key, 1, 8)), 16, -10) as bigint)"))
    numbered = numbered.select("class_no", "class_key", "rep_id", "rep_text", "n_shingles")
    groups = components(pairs).select(F.col("node").alias("class_no"), "root")
    members = stored(numbered.join(groups, "class_no"), "members")
    sizes = members.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("size"))
    sizes = stored(block_counts(sizes).select("root", "n"), "sizes")
    small = members.join(sizes.where("n = 1"), "root")
    small = small.select("class_key", "rep_id", "rep_text", F.array(F.xxhash64("root")).alias("blocks"))
    links = links_in_blocks(texts, small, words, percent)
    large = members.join(sizes.where("n > 1"), "root")
    sides = texts_of(texts, large.select("class_no", "class_key", "rep_id", "rep_text"))
    both = pairs
    for side in ("a", "b"):
        both = both.join(sides.select(F.col("class_no").alias(side), F.struct("class_key", "text").alias(f"of_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = []
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                for one, two in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    sets = sorted((set_of(side["text"], words, hashes) for side in (one, two)), key=len)
                    place = np.minimum(np.searchsorted(sets[1], sets[0]), len(sets[1]) - 1)
                    shared = int((sets[1][place] == sets[0]).sum())
                    if overlap_holds(shared, len(sets[0]) + len(sets[1]), percent):
                        found.append((one["class_key"], two["class_key"]))
            if found:
                columns = [pa.array(side, pa.binary()) for side in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    return links.unionByName(both.select("of_a", "of_b").mapInArrow(run, "a binary, b binary"))


def near_groups(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and component for every document.

    Words are runs of signs other than the six ASCII white-space characters, A-Z lower-cased. Null and
    empty texts, and those of white space, have an empty set: no shingles, no component but themselves.
    ``component_id`` is the least doc_id reachable by links; ``component`` is a key of the group, null
    for empty sets. Repeated rows each get a row; a null doc_id never is the least unless all are null.
    Columns other than doc_id and text are not read. An empty table gives an empty result.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows, sketch = set_facts(texts, words)
    first = F.min(F.struct("doc_id", "text_hash"))
    classes = rows.where("n_shingles > 0").groupBy("class_key").agg(
        F.max("n_shingles").alias("n_shingles"), F.max("low_0").alias("low_0"), F.max("low_1").alias("low_1"),
        first.alias("rep"), F.min("doc_id").alias("least_id"), F.count("*").alias("uses"),
    )
    classes = classes.withColumns({"rep_id": F.col("rep.doc_id"), "rep_text": F.col("rep.text_hash")}).drop("rep")
    classes = stored(classes, "classes")
    near = stored(links_by_least_hash(texts, classes, words, percent), "near")
    so_far = components(near)
    entries = rare_lists(texts, sketch, words, percent)
    number = F.expr("cast(conv(hex(substring(node, 1, 8)), 16, -10) as bigint)")
    known = so_far.select(number.alias("class_no"), F.xxhash64("root").alias("of_root"))
    known = F.broadcast(known) if known.count() <= BROADCAST_KEYS else known
    component = F.coalesce("of_root", F.xxhash64("class_no"))
    entries = entries.join(known, "class_no", "left").withColumn("component", component).drop("of_root")
    pairs = stored(candidate_pairs(stored(entries, "lists"), percent), "pairs")
    links = near.unionByName(confirmed(texts, classes, pairs, words, percent))
    roots = components(links).select(F.col("node").alias("class_key"), "root")
    grouped = classes.join(roots, "class_key", "left").withColumn("component", F.coalesce("root", "class_key"))
    least = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"))
    found = grouped.join(least, "component").select("class_key", "component", "component_id", "uses")
    out = lookup(rows.drop("low_0", "low_1"), found, ["class_key"], "uses")
    own = F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", own.alias("component_id"), "component")


def one_of_each_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """All documents without links, and of every group of linked ones that with the least doc_id.

    Of rows that repeat that doc_id in one group, one stays. All columns are returned as they are.
    Documents without words are in no group and all stay.
    """
    found = near_groups(docs, words, percent)
    chosen = found.where("component is null or doc_id <=> component_id")
    one = F.when(F.col("component").isNull(), F.col("text_hash"))
    # Rows of one group that repeat the least id: the smallest text hash decides.
    kept = chosen.groupBy("component", one.alias("own_text"), F.col("doc_id").alias("kept_id")).agg(
        F.min("text_hash").alias("kept_text")
    )
    kept = kept.select("kept_id", "kept_text", F.col("component").isNotNull().alias("grouped")).distinct()
    names = {name: f"col_{i}" for i, name in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{name}`").alias(alias) for name, alias in names.items()])
    inner = inner.withColumn("text_hash", F.xxhash64(names["text"]))
    same = F.col(names["doc_id"]).eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_text"))
    rows = inner.join(kept, same)
    alone = rows.where(~F.col("grouped"))
    once = rows.where("grouped").dropDuplicates([names["doc_id"], "text_hash"])
    return alone.unionByName(once).select(*[F.col(alias).alias(name) for name, alias in names.items()])
