import collections
import itertools
import re

import numpy as np

from helpers import ODD, odd_rows, prose
from tidemark.llm import line_quality as lq


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside),
        n < 50 or 100 * len(inside) > 50 * n,
    )


def junk(seed):
    return " ".join(word + "#%&*"[i % 4] * 3 for i, word in enumerate(prose(seed, 80).split()))


def test_base_columns(spark):
    texts = [prose(1, 60), prose(2, 49), "a b c a b c\na b c\na b c\n\n \na b", "x\x1cy z\x0bw", "ab " * 80, junk(3)]
    rows = odd_rows(texts)
    found = lq.line_quality(spark.createDataFrame(rows, ODD), lq.default_field(), ["doc_id", "text"]).collect()
    assert len(found) == len(rows)
    for row in found:
        assert tuple(row[2:8]) == base(row["text"])
        assert not (row["base_failed"] and row["kept"])
    assert lq.line_quality(spark.createDataFrame([], ODD), lq.default_field(), ["doc_id"]).count() == 0


def test_viterbi_is_the_best_of_all_sequences():
    rng = np.random.default_rng(2)
    for _ in range(200):
        scores, moves = rng.normal(size=(rng.integers(1, 7), 2)), rng.normal(size=(2, 2))

        def score(labels, scores=scores, moves=moves):
            return sum(scores[i][k] for i, k in enumerate(labels)) + sum(moves[a][b] for a, b in zip(labels, labels[1:], strict=False))

        best = max(itertools.product((0, 1), repeat=len(scores)), key=score)
        assert lq.viterbi(scores, moves) == list(best)


def test_training_tells_junk_from_prose(spark):
    docs = [(i, prose(i, 90)) for i in range(40)] + [(100 + i, junk(i)) for i in range(20)]
    labels = [(i, 1, 0) for i in range(20)] + [(100 + i, 0, 0) for i in range(10)] + [(None, 1, 0), (3, None, 0)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    field = lq.fit(docs, labels)
    kept = {row[0] for row in lq.keep_good(docs, field).collect()}
    assert kept == set(range(40))
    assert np.array_equal(lq.fit(docs, labels.limit(0)).weights, lq.default_field().weights)


def test_keeping_returns_all_columns(spark):
    docs = spark.createDataFrame(odd_rows([prose(1, 60), junk(1)]), ODD)
    kept = lq.keep_good(docs, lq.default_field())
    assert kept.columns == docs.columns
    assert {row["doc_id"] for row in kept.collect()} >= {0}
