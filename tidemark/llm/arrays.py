"""Hashes of words and bytes in numpy arrays, and Arrow rows as whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

# Words whose hash a task remembers at most, and the length of a word up to which it does.
KNOWN_WORDS = 100_000
KNOWN_LENGTH = 64
# The constants of a 64-bit finaliser (splitmix64).
STEPS = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))
GOLDEN = 0x9E3779B97F4A7C15


def mix(values: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of unsigned 64-bit values."""
    out = values + np.uint64(GOLDEN)
    for shift, factor in STEPS:
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return out


class WordHashes(dict):
    """64-bit hash of a word, looked up as an item and remembered. Text is hashed as its UTF-8 bytes."""

    def __missing__(self, word: bytes | str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= KNOWN_LENGTH:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes] | list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; fewer words are one run of their own length."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(n, size)
    out = mix(np.full(n - width + 1, width, np.uint64))
    for i in range(width):
        out = mix(out ^ hashes[i : n - width + 1 + i])
    return np.unique(out)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches put together and cut so that rows of one ``key`` (a long, rows sorted by it) stay together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(key).to_numpy()
        if held and keys[0] != last:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        others = np.flatnonzero(keys != keys[-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(cut))
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
