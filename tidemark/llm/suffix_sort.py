"""Suffix order of a text by the difference cover algorithm, to a bounded depth."""

from __future__ import annotations

import numpy as np

# Bits that a symbol or rank may take so that three of them fit one 64-bit key.
PACKED = 21


def _order(keys: list[np.ndarray]) -> np.ndarray:
    """Positions sorted by the keys, the first one leading."""
    if max((int(key.max()) for key in keys if len(key)), default=0) < 1 << PACKED and len(keys) <= 3:
        packed = np.zeros(len(keys[0]), np.int64)
        for key in keys:
            packed = (packed << PACKED) | key
        return np.argsort(packed)
    return np.lexsort(keys[::-1])


def _names(keys: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Dense ranks from 1, equal where all keys are equal."""
    changed = np.zeros(len(order), np.int64)
    for key in keys:
        line = key[order]
        changed[1:] |= line[1:] != line[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(changed) + 1
    return names


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in order of at least their first ``3 ** depth`` symbols.

    ``symbols`` are integers of 1 and more; a 0 is smaller than all and equal to the end. Suffixes at positions 1 and 2 modulo 3 are the sample: their
    triples are sorted and named, and the string of names is ordered in the same way where names repeat.
    The other suffixes are sorted by their first symbol and the rank of the next, and merged with the
    sample. Suffixes that agree in the first ``3 ** depth`` symbols come in any order, next to each other.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    if n == 1:
        return np.zeros(1, np.int64)
    s = np.zeros(n + 3, np.int64)
    s[:n] = symbols
    first, second, rest = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([first, second])
    triple = [s[sample], s[sample + 1], s[sample + 2]]
    by_triple = _order(triple)
    names = _names(triple, by_triple)
    if depth > 1 and names.max(initial=0) < len(sample):
        # A name of 0 keeps the two parts of the string apart.
        inner = suffix_order(np.concatenate([names[: len(first)], [0], names[len(first) :]]), depth - 1)
        inner = inner[inner != len(first)]
        by_rank = np.where(inner > len(first), inner - 1, inner)
        names = np.empty(len(sample), np.int64)
        names[by_rank] = np.arange(1, len(sample) + 1)
    else:
        by_rank = by_triple
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    sorted_sample = sample[by_rank]
    sorted_rest = rest[_order([s[rest], rank[rest + 1]])]
    # How many of the sample come before each of the rest: compared one symbol on with the suffixes that
    # start at 1 modulo 3, two symbols on with those at 2.
    place = np.zeros(len(sorted_rest), np.int64)
    wide = int(rank.max(initial=0)) + 1
    one = np.sort(s[first] * wide + rank[first + 1])
    place += np.searchsorted(one, s[sorted_rest] * wide + rank[sorted_rest + 1])
    pair = int(s.max()) + 1
    if pair * pair * wide < 1 << 62:
        two = np.sort((s[second] * pair + s[second + 1]) * wide + rank[second + 2])
        place += np.searchsorted(two, (s[sorted_rest] * pair + s[sorted_rest + 1]) * wide + rank[sorted_rest + 2])
    else:
        place += _count_before(
            [s[second], s[second + 1], rank[second + 2]], [s[sorted_rest], s[sorted_rest + 1], rank[sorted_rest + 2]]
        )
    return np.insert(sorted_sample, np.maximum.accumulate(place), sorted_rest)


def _count_before(keys: list[np.ndarray], asked: list[np.ndarray]) -> np.ndarray:
    """For each row of ``asked`` the number of rows of ``keys`` that sort before it."""
    n = len(keys[0])
    both = [np.concatenate([mine, theirs]) for mine, theirs in zip(asked, keys, strict=True)]
    order = np.lexsort(both[::-1])
    is_key = order >= len(asked[0])
    before = np.cumsum(is_key)
    found = np.empty(len(asked[0]), np.int64)
    names = _names(both, order)[order]
    # Equal rows do not come before: take the count at the start of each run of equal rows.
    starts = np.r_[True, names[1:] != names[:-1]]
    base = np.maximum.accumulate(np.where(starts, before - is_key, 0))
    mine = ~is_key
    found[order[mine]] = base[mine]
    return np.minimum(found, n)


def repeated_windows(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of the windows ``data[start:start + width]`` occur at two or more of ``starts``.

    ``data`` holds bytes; pieces of text in it must be kept apart by the caller, who names only windows
    that lie in one piece. Windows are ordered as suffixes, then neighbours are compared byte by byte.
    """
    depth = 1
    while 3**depth < width:
        depth += 1
    # Only 3 ** depth symbols are ordered, of which the first are bytes: shift them, 0 is past the end.
    order = suffix_order(data.astype(np.int64) + 1, depth)
    wanted = np.full(len(data), -1, np.int64)
    wanted[starts] = np.arange(len(starts))
    line = order[wanted[order] >= 0]
    found = np.zeros(len(starts), bool)
    if len(line) < 2:
        return found
    left, right = line[:-1], line[1:]
    pairs = np.arange(len(left))
    if width >= 8:
        # Eight bytes at a time; pairs that differ are left out of the next step.
        units, offsets = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)), range(0, width - 7, 8)
    else:
        units, offsets = data, range(width)
    for offset in [*offsets, width - 8 if width >= 8 else 0]:
        pairs = pairs[units[left[pairs] + offset] == units[right[pairs] + offset]]
    found[wanted[left[pairs]]] = True
    found[wanted[right[pairs]]] = True
    return found
