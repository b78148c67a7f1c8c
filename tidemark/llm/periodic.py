"""Periodic runs of words, found by a dictionary of basic factors.

For every power of two the factors of that many words are named, each level from the one below by pairs.
A factor's successor is its next occurrence in the text. Inside a run of smallest period ``q`` the factors
of ``q`` to ``2q`` words have their successors exactly ``q`` further on, so three occurrences at equal
distance, none farther than twice the factor, propose a period; the stretch is extended word by word to
its ends, and equal ones are taken once.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import add_columns

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# A run repeats its period so often, and has so many words, at least.
LEAST_PERIODS = 4
LEAST_WORDS = 6
# Words of several texts that are looked at together; a longer text is looked at alone.
GROUP_WORDS = 1 << 16

Run = tuple[int, int, int]


def _successors(names: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places with a name each (places rising), those that have a next place of their name, and how far."""
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    here = places[order[:-1]][same]
    return here, places[order[1:]][same] - here


def _longer(names: np.ndarray, places: np.ndarray, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the factors of ``2 * size`` words at the places where both halves occur twice or more."""
    counts = np.bincount(names)
    kept = counts[names] > 1
    names, places = names[kept], places[kept]
    at = np.searchsorted(places, places + size)
    at[at == len(places)] = 0
    whole = places[at] == places + size if len(places) else np.zeros(0, bool)
    pairs = names[whole] * np.int64(len(counts)) + names[at[whole]]
    return np.unique(pairs, return_inverse=True)[1], places[whole]


def _agree(words: np.ndarray, start: int, step: int, period: int) -> int:
    """How far from ``start``, in steps of 1 or -1, words equal those ``period`` further on."""
    n, done, size = len(words), 0, 32
    while True:
        if step > 0:
            low, high = start + done, min(start + done + size, n - period)
        else:
            low, high = max(start - done - size + 1, 0), start - done + 1
        if high <= low:
            return done
        other = np.flatnonzero(words[low:high] != words[low + period : high + period])
        if len(other):
            return done + (int(other[0]) if step > 0 else high - low - 1 - int(other[-1]))
        done += high - low
        size *= 2


def _proposals(words: np.ndarray) -> set[Run]:
    """(start, end, period) of every run in one sequence of word numbers."""
    n = len(words)
    names, places = np.unique(words, return_inverse=True)[1], np.arange(n)
    found: set[Run] = set()
    size = 1
    while len(places) and LEAST_PERIODS * (size // 2 + 1) <= n:
        here, far = _successors(names, places)
        near = (far <= 2 * size) & (2 * far > size)
        next_far = np.zeros(n, np.int64)
        next_far[here] = far
        here, far = here[near], far[near]
        # An arithmetic progression: the successor's successor is as far again.
        rows = next_far[here + far] == far
        here, far = here[rows], far[rows]
        order = np.lexsort((here, far))
        here, far = here[order], far[order]
        # Places in a row that propose the same period belong to one stretch.
        starts = np.flatnonzero((np.diff(here, prepend=-2) != 1) | (np.diff(far, prepend=0) != 0))
        last: Run = (0, 0, 0)
        for i in starts:
            start, period = int(here[i]), int(far[i])
            if period == last[2] and last[0] <= start < last[1] - period:
                continue
            low = start - _agree(words, start - 1, -1, period)
            end = start + _agree(words, start, 1, period) + period
            last = (low, end, period)
            if end - low >= max(LEAST_WORDS, LEAST_PERIODS * period):
                found.add(last)
        names, places = _longer(names, places, size, n)
        size *= 2
    return found


def find_runs(texts: list[list[str]]) -> list[list[Run]]:
    """For each list of words its runs as (start, length, period), by start and period.

    A run is a stretch whose smallest period ``q`` fits ``LEAST_PERIODS`` times or more, of ``LEAST_WORDS``
    words at least, that no neighbouring word extends.
    """
    out: list[list[Run]] = [[] for _ in texts]
    group: list[int] = []
    held = 0
    for i, words in enumerate(texts):
        if group and held + len(words) > GROUP_WORDS:
            _group_runs(texts, group, out)
            group, held = [], 0
        group.append(i)
        held += len(words) + 1
    if group:
        _group_runs(texts, group, out)
    return out


def _group_runs(texts: list[list[str]], group: list[int], out: list[list[Run]]) -> None:
    """The runs of several texts in one sequence: a word has another number in every text, ends are unlike all."""
    numbers: list[int] = []
    begins = []
    fresh = 0
    for i in group:
        known: dict[str, int] = {}
        begins.append(len(numbers))
        numbers += [known.setdefault(word, fresh + len(known)) for word in texts[i]]
        fresh += len(known)
        numbers.append(fresh)
        fresh += 1
    runs = _smallest(_proposals(np.array(numbers, np.int64)))
    owners = np.searchsorted(begins, [run[0] for run in runs], side="right") - 1
    for (start, end, period), owner in zip(runs, owners, strict=True):
        begin = begins[owner]
        out[group[owner]].append((start - begin, end - start, period))


def _smallest(found: set[Run]) -> list[Run]:
    """Runs by start and period; of one stretch the smallest period only, as multiples of it fit as well."""
    best: dict[tuple[int, int], int] = {}
    for start, end, period in found:
        best[start, end] = min(period, best.get((start, end), period))
    return sorted((start, end, period) for (start, end), period in best.items())


def collapsed(words: list[str], runs: list[Run]) -> list[str]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    drop = np.cumsum(edges[:-1]) > 0
    return [word for word, gone in zip(words, drop, strict=True) if not gone]


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, the words' number, every run of a text, and the text without what its runs repeat.

    ``runs`` is a list of (start, length, period) in words, by start and period; ``collapsed`` is the kept
    words joined by one blank. A null or empty text has no words, no runs and an empty ``collapsed``. Texts
    are looked at whole; other columns, nulls in ``keep`` and repeated rows pass unchanged.
    """

    def compute(texts: list) -> dict[str, list]:
        words = [WORD.findall(one or "") for one in texts]
        runs = find_runs(words)
        named = [[{"start": s, "length": n, "period": q} for s, n, q in one] for one in runs]
        kept = [" ".join(collapsed(one, found)) for one, found in zip(words, runs, strict=True)]
        return {"n_words": [len(one) for one in words], "runs": named, "collapsed": kept}

    made = "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    copied = docs.select(*keep, F.col(text).alias("run_text"))
    return add_columns(copied, "run_text", compute, made, keep)


def with_planted_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, of which every tenth by the checksum of its id repeats words from some place on.

    With ``h`` the crc32 of the id, ``g = h / 10`` and ``n`` words: where ``h % 10`` is 0, each word from
    ``a = g % n`` on becomes word ``a + (i - a) % p`` with ``p = 1 + (n - a) / (3 + g % 8)``. A null id or a
    text without words stays as it is.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / F.lit(10))
    words = F.regexp_extract_all(F.col(text), F.lit(WORD.pattern), F.lit(0))
    n = F.size("planted_words")

    def repeated(word: Column, i: Column) -> Column:
        a, p = F.col("planted_a"), F.col("planted_p")
        return F.when(i >= a, F.get("planted_words", (a + F.pmod(i - a, p)).cast("int"))).otherwise(word)

    made = docs.withColumn("planted_words", F.when(h % 10 == 0, words))
    made = made.withColumn("planted_a", F.when(n > 0, g % n).otherwise(0))
    made = made.withColumn("planted_p", 1 + F.floor((n - F.col("planted_a")) / (3 + g % 8)))
    changed = F.array_join(F.transform("planted_words", repeated), " ")
    made = made.withColumn(text, F.when(n > 0, changed).otherwise(F.col(text)))
    return made.drop("planted_words", "planted_a", "planted_p")


def run_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of runs, the longest one, and digests of all runs and of the collapsed text.

    The longest run has the least start, then the least period, among equally long ones; without a run its
    columns are null and the list's digest is that of no bytes.
    """
    found = periodic_runs(docs, [doc_id], text)

    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(line, lambda one: F.concat(one, F.lit("\n"))), "")
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("shortness"), r["start"], r["period"]))
    found = found.withColumn("best", F.array_min(ranked))
    length = -F.col("best.shortness")
    return found.select(
        doc_id,
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        length.alias("length"),
        "best.period",
        F.expr("-best.shortness * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
