import os

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import bpe, decontaminate, line_quality, secrets
from tidemark.llm.common import table
from tidemark.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables are not here")


@pytest.fixture(scope="module")
def stages(spark):
    """Input and result of every stage."""
    docs, out = table(spark, SF_DIR, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF_DIR)
        schema = made.schema
        rows = made.collect()
        out.append((docs, rows))
        docs = spark.createDataFrame(rows, schema)
    return out


def test_quality_stage(spark, stages):
    docs, rows = stages[0]
    field = line_quality.fit(docs, table(spark, SF_DIR, "labels"))
    texts = docs.collect()
    kept = line_quality.judge([row["text"] for row in texts], field)["kept"]
    assert sorted(rows) == sorted(row for row, keep in zip(texts, kept, strict=True) if keep)
    assert 0 < len(rows) < len(texts)


def test_near_duplicate_stage(stages):
    from test_jaccard import brute

    docs, rows = stages[1]
    texts = docs.collect()
    _, groups = brute([row["text"] for row in texts], 5, 80)
    wanted = {}
    for row, group in sorted(zip(texts, groups, strict=True), key=lambda pair: pair[0]["doc_id"]):
        wanted.setdefault(group, row)
    assert sorted(rows) == sorted(wanted.values())


def test_decontamination_stage(spark, stages):
    docs, rows = stages[2]
    items = decontaminate.Items([tuple(row) for row in table(spark, SF_DIR, "benchmark").select("item_id", "text").collect()])
    known = decontaminate.WordHashes()
    assert sorted(rows) == sorted(row for row in docs.collect() if not decontaminate.matches(row["text"], items, known))
    whole = {row["text"] for row in table(spark, SF_DIR, "benchmark").collect()}
    assert not [row for row in rows if any(item in row["text"] for item in whole)]


def test_secret_stage(stages):
    docs, rows = stages[3]
    assert sorted(row["text"] for row in rows) == sorted(secrets.masked(row["text"]) for row in docs.collect())
    assert all(row["n_chars"] == len(row["text"]) for row in rows)


def test_token_stage(stages):
    docs, rows = stages[4]
    texts = {row["doc_id"]: row["text"] for row in docs.collect()}
    decode = bpe.Vocabulary.load().decoder()
    assert len(rows) == len(texts)
    for row in rows:
        assert decode(np.frombuffer(row["ids"], "<u4")).decode() == texts[row["doc_id"]]


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(row["doc_id"] for row in corpus_pipeline.run(spark, SF_DIR).collect()) == sorted(r["doc_id"] for r in stages[-1][1])


def test_queries_cover_their_tables(spark):
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    n = {name: table(spark, SF_DIR, name).count() for name in ("documents", "pages", "embeddings")}
    asked = table(spark, SF_DIR, "embeddings").where("vec_id % 20 = 0").count()
    wanted = {"op8_warc": n["pages"], "op9_html_text": n["pages"]}
    wanted |= {"op11_whitening": 4 * n["embeddings"], "op13_neighbours": 20 * asked}
    for name, query in QUERIES.items():
        if name != "op7_decontaminate":
            assert query(spark, SF_DIR).count() == wanted.get(name, n["documents"])
