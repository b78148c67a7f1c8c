import os

import numpy as np
import pytest

from tidemark.llm import neighbours, parts
from tidemark.llm.common import table

SCHEMA = "vec_id bigint, embedding array<float>, key_a int, part string, ids int"
SF_DIR = "/root/testdata/sf0.1"


def frame(spark, vectors, schema=SCHEMA):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 7, "p", 9) for i, v in vectors]
    return spark.createDataFrame(rows, schema)


def brute(vectors, k, every=20):
    """Exact answers over distinct rows of whole vectors."""
    rows = sorted({(i, tuple(np.float32(c) for c in v)) for i, v in vectors})
    ids = np.array([i for i, _ in rows])
    matrix = np.array([v for _, v in rows], np.float64)
    out = []
    for i, row in zip(ids, matrix, strict=True):
        if i % every == 0:
            others = ids != i
            scores = (matrix[others] * row).sum(1)
            order = np.lexsort((ids[others], -scores))[:k]
            out += [(i, r + 1, ids[others][o], scores[o]) for r, o in enumerate(order)]
    return sorted(out)


def search(spark, rows, k=20, every=20):
    found = neighbours.nearest_neighbours(rows, rows.where(f"vec_id % {every} = 0"), k)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()))


def clustered(n=1500, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((12, dims)) * 2
    return [(i, (centers[i % 12] + rng.standard_normal(dims) * 0.4).astype(np.float32)) for i in range(n)]


def same(found, wanted):
    assert [row[:3] for row in found] == [row[:3] for row in wanted]
    assert np.allclose([row[3] for row in found], [row[3] for row in wanted], rtol=0, atol=1e-12)


def recall(found, wanted):
    return len({row[::2][:2] for row in found} & {row[::2][:2] for row in wanted}) / len(wanted)


def test_few_rows_are_searched_exactly_and_edges(spark):
    vectors = clustered(260)
    hot = vectors[20][1]
    # Very many copies of one vector, more than are ever answered, some of them queries.
    copies = [(1000 + i, hot) for i in range(130)]
    odd = [(2000, None), (2020, []), (2040, [None] * 16), (2060, [np.nan] * 16), (2080, [0.0] * 16), (2100, [1.0] * 15)]
    odd += [(None, hot), (2120, [-np.inf] + [0.0] * 15)]
    repeated = [(40, vectors[40][1]), (40, vectors[40][1])]
    rows = frame(spark, vectors + copies + odd + repeated)
    same(search(spark, rows), brute(vectors + copies, 20))
    few = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 0.0]), (20, [-1.0, 0.0])]
    same(search(spark, frame(spark, few)), brute(few, 20))
    assert search(spark, frame(spark, [])) == [] and search(spark, frame(spark, [(0, None)])) == []
    assert search(spark, frame(spark, [(20, [1.0])])) == []


def test_parts_and_blocks_miss_little(spark, monkeypatch):
    vectors = clustered()
    rows = frame(spark, vectors + [(5000 + i, vectors[0][1]) for i in range(900)])
    wanted = brute(vectors + [(5000 + i, vectors[0][1]) for i in range(900)], 20)
    monkeypatch.setattr(neighbours, "PART_ROWS", 100)
    whole = search(spark, rows)
    assert recall(whole, wanted) >= 0.9
    # However parts are dealt in blocks, the same rows are found.
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 9)
    assert search(spark, rows.repartition(6)) == whole


def test_cut_is_balanced_and_follows_the_graph():
    vectors = np.array([v for _, v in clustered(960)], np.float64)
    for count in (1, 2, 5, 12):
        part = parts.balanced_parts(vectors, count)
        sizes = np.bincount(part, minlength=count)
        assert len(sizes) == count and sizes.max() - sizes.min() <= 5
    a, b = parts.graph(vectors)
    part = parts.balanced_parts(vectors, 4)
    assert (part[a] != part[b]).mean() < 0.15
    router, probes = parts.learn(vectors, 8, 10, 0.95)
    assert probes < 8 and np.allclose(router.probabilities(vectors[:5]).sum(1), 1)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables are not here")
def test_recall_on_the_given_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 200)
    rows = table(spark, SF_DIR, "embeddings")
    vectors = [(row["vec_id"], row["embedding"]) for row in rows.collect()]
    assert recall(search(spark, rows), brute(vectors, 20)) >= 0.9
