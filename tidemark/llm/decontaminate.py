"""Benchmark decontamination by spaced seeds (operator 7).

A seed is a mask over neighbouring tokens; tokens under its gaps are ignored, so a seed still matches
where a word was substituted. Seeds of the benchmark are joined with those of the documents by hash, and
around every hit the tokens are compared one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.arrays import WordHashes, mix
from tidemark.llm.common import SLICE_ROWS, computed

# 1 is compared, 0 is ignored. Any run of 4 to 16 tokens, and any longer one, with four
# fifths of its tokens in place holds one of these.
MASKS = ("1111", "11011", "11101", "10111")
# Shorter items must be in the document as they are.
SHORT_MASKS = ("1", "11", "111")
# A document is contaminated by an item if in some stretch of as many tokens as the item has, at most
# this many, four fifths of the tokens are the item's; or if it starts or ends inside the item and four
# fifths of the item's tokens are there.
STRETCH = 25
PERCENT = 80
# Tokens of an item from which on it can drop a document; a word or two stand in many clean ones.
LEAST_DROPPING = 4
# Tokens of the benchmark that are held by a task at a time; more items take further passes.
BLOCK_TOKENS = 2_000_000
# Scripts written without spaces (Thai to Lao, Burmese, Khmer, kana, Han): every letter is a token.
UNSPACED = (
    "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
    "\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
)
TOKEN = re.compile(rf"[^\W_{UNSPACED}]+|[{UNSPACED}](?<=\w)")
MADE = "item_id bigint, doc_start bigint, item_start bigint, n_tokens bigint, n_same bigint"


def tokens_of(text: str | None) -> list[str]:
    """Runs of letters and digits, case folded; single letters in scripts without spaces."""
    return TOKEN.findall((text or "").casefold())


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the compared tokens for every start of the mask."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = mix(np.full(n, int(mask, 2), np.uint64))
    for i, sign in enumerate(mask):
        if sign == "1":
            out = mix(out ^ hashes[i : i + n])
    return out


class Items:
    """Tokens and seeds of a block of benchmark items."""

    def __init__(self, rows: list[tuple[int, str | None]]) -> None:
        known = WordHashes()
        self.masks: set[str] = set()
        self.ids: list[int] = []
        self.tokens: list[np.ndarray] = []
        found, owner, place = [], [], []
        for item_id, text in rows:
            hashes = known.of(tokens_of(text))
            if item_id is None or not len(hashes):
                continue
            for mask in MASKS if len(hashes) >= len(MASKS[0]) else (SHORT_MASKS[len(hashes) - 1],):
                self.masks.add(mask)
                made = seeds(hashes, mask)
                found.append(made)
                owner.append(np.full(len(made), len(self.ids)))
                place.append(np.arange(len(made)))
            self.ids.append(item_id)
            self.tokens.append(hashes)
        values = np.concatenate(found) if found else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.seeds = values[order]
        self.owner = np.concatenate(owner)[order] if found else np.zeros(0, int)
        self.place = np.concatenate(place)[order] if found else np.zeros(0, int)
        # One bit per 20-bit prefix of a seed hash: most seeds of a document end here.
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.seeds >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> set[tuple[int, int]]:
        """(item, shift) of every seed that a document shares with an item; document place less item place."""
        out: set[tuple[int, int]] = set()
        for mask in self.masks:
            made = seeds(hashes, mask)
            at = np.flatnonzero(self.maybe[(made >> np.uint64(44)).astype(np.int64)])
            first = np.searchsorted(self.seeds, made[at])
            end = np.searchsorted(self.seeds, made[at], side="right")
            for start, low, high in zip(at.tolist(), first.tolist(), end.tolist(), strict=True):
                for i in range(low, high):
                    out.add((int(self.owner[i]), start - int(self.place[i])))
        return out

    def overlap(self, hashes: np.ndarray, item: int, shift: int) -> tuple[int, int, int, int] | None:
        """The best stretch along a shift: document start, item start, tokens, tokens that are the same.

        Where the document's edges leave less than a stretch, tokens of the item beyond them count as
        different: four fifths of the whole item must be there, and what is there is given.
        """
        own = self.tokens[item]
        size = min(len(own), STRETCH)
        low, high = max(0, -shift), min(len(own), len(hashes) - shift)
        same = own[low:high] == hashes[low + shift : high + shift]
        if high - low < size:
            count = int(same.sum())
            return (low + shift, low, high - low, count) if 100 * count >= PERCENT * len(own) else None
        sums = np.cumsum(np.r_[0, same])
        counts = sums[size:] - sums[:-size]
        best = int(np.argmax(counts))
        if 100 * counts[best] < PERCENT * size:
            return None
        return low + best + shift, low + best, size, int(counts[best])


def matches(text: str | None, items: Items, known: WordHashes) -> list[tuple[int, int, int, int, int]]:
    """(item_id, doc_start, item_start, n_tokens, n_same): the best stretch of every item in a text."""
    if not text or not len(items.seeds):
        return []
    hashes = known.of(tokens_of(text))
    best: dict[int, tuple[int, int, int, int, int]] = {}
    for item, shift in sorted(items.hits(hashes)):
        found = items.overlap(hashes, item, shift)
        if found and (item not in best or found[3] > best[item][4]):
            best[item] = (items.ids[item], *found)
    return sorted(best.values())


def blocks(benchmark: DataFrame, least: int = 1) -> Iterator[Items]:
    """The items of ``least`` tokens or more in blocks of bounded size; one block for any usual benchmark.

    The number of blocks follows from the total length. Which block an item is in is a hash of it.
    """
    rows = benchmark.select(F.col("item_id").alias("item_id"), F.col("text").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // (2 * BLOCK_TOKENS)))
    for i in range(n):
        some = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        held = {(row[0], row[1]) for row in some.collect() if row[0] is not None}
        yield Items(sorted(item for item in held if len(tokens_of(item[1])) >= least))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item whose text it holds, with the best stretch of tokens.

    Null and empty texts match nothing; items of fewer than four tokens match where they are unchanged;
    items with a null id are left out. Repeated rows each give their matches. Of equally good stretches
    the first is given. Only the two named columns are read, so others cannot clash. Empty tables give an
    empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL(MADE)])
    names = [field.name for field in StructType.fromDDL(MADE)]

    def look(items: Items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = WordHashes()
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(start, SLICE_ROWS)
                    found = [
                        (i, *match)
                        for i, text in enumerate(part.column(1).to_pylist())
                        for match in matches(text, items, known)
                    ]
                    if found:
                        place, *columns = zip(*found, strict=True)
                        arrays = [part.column(0).take(pa.array(place, pa.int64()))]
                        arrays += [pa.array(column, pa.int64()) for column in columns]
                        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *names])

        return run

    out = None
    for items in blocks(benchmark):
        part = rows.mapInArrow(look(items), schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least: int = LEAST_DROPPING
) -> DataFrame:
    """The documents that hold the text of no item of ``least`` tokens or more, with all their columns.

    Shorter items are reported by ``find_leaks`` but drop nothing.
    """
    for items in blocks(benchmark, least):
        # Remembered for all rows of a task.
        known = WordHashes()

        def clean(texts: list[str | None], items: Items = items, known: WordHashes = known) -> list[bool]:
            return [not matches(text, items, known) for text in texts]

        docs = docs.where(computed(text_col, clean, "boolean"))
    return docs
