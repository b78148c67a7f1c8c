import collections
import hashlib
import random

import numpy as np

from helpers import ODD, odd_rows, prose
from tidemark.llm import repeats
from tidemark.llm.suffix_sort import repeated_windows, suffix_order


def brute(texts, width=200):
    data = [(text or "").encode() for text in texts]
    seen = collections.Counter(value[i : i + width] for value in data for i in range(len(value) - width + 1))
    out = []
    for value in data:
        covered = np.zeros(len(value), bool)
        for i in range(len(value) - width + 1):
            if seen[value[i : i + width]] > 1:
                covered[i : i + width] = True
        spans = int((covered & ~np.r_[False, covered[:-1]]).sum()) if len(value) else 0
        kept = bytes(np.frombuffer(value, np.uint8)[~covered])
        out.append((len(value), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def sample_texts():
    rng = random.Random(3)
    passage, other = prose("p", 60), prose("q", 45)
    texts = [prose(i, rng.randrange(5, 120)) for i in range(10)]
    for i in range(25):
        words = prose(i % 4, 100).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"é{rng.randrange(9)}"
        texts.append(" ".join(words))
    texts += [f"{prose(50 + i, 20)} {passage} {prose(80 + i, 20)}" for i in range(8)]
    texts += [f"{other} between {other} {i}" for i in range(2)]
    return texts + ["ab" * 400, "z" * 199, "y" * 200, "y" * 201, passage.encode()[:200].decode(), prose(50, 20)]


def check(spark, texts):
    rows = odd_rows(texts)
    found = repeats.remove_repeats(spark.createDataFrame(rows, ODD)).collect()
    wanted = [(row[0], *values) for row, values in zip(rows, brute([row[1] for row in rows]), strict=True)]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))


def test_removed_bytes_are_those_of_brute_force(spark):
    check(spark, sample_texts())


def test_small_segments_and_counted_anchors(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 300)
    monkeypatch.setattr(repeats, "MOST_FORMS", 2)
    monkeypatch.setattr(repeats, "SORT_BYTES", 1000)
    monkeypatch.setattr(repeats, "BROADCAST_KEYS", 0)
    check(spark, sample_texts()[:30])


def test_suffix_order_is_right_to_its_depth():
    rng = np.random.default_rng(0)
    for _ in range(1500):
        symbols = rng.integers(1, 1 + rng.integers(1, 5), rng.integers(0, 60))
        depth = int(rng.integers(1, 5))
        order = suffix_order(symbols, depth)
        assert sorted(order) == list(range(len(symbols)))
        prefixes = [tuple(symbols[i : i + 3**depth]) for i in order]
        assert prefixes == sorted(prefixes)


def test_suffix_order_with_large_symbols():
    rng = np.random.default_rng(1)
    symbols = rng.integers(1, 1 << 40, 300)
    symbols[100:200] = symbols[:100]
    order = suffix_order(symbols, 5)
    assert [tuple(symbols[i : i + 243]) for i in order] == sorted(tuple(symbols[i : i + 243]) for i in range(300))


def test_repeated_windows_of_any_width():
    rng = np.random.default_rng(4)
    for _ in range(500):
        data = rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 300)).astype(np.uint8)
        width = int(rng.choice([3, 8, 9, 20, 30]))
        starts = np.flatnonzero(rng.random(max(0, len(data) - width + 1)) < 0.8)
        counts = collections.Counter(bytes(data[i : i + width]) for i in starts)
        assert list(repeated_windows(data, starts, width)) == [counts[bytes(data[i : i + width])] > 1 for i in starts]


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], ODD)).count() == 0
