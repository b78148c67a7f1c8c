import base64
import hashlib
import random

import numpy as np
import pytest

from helpers import ODD, odd_rows, prose
from tidemark.llm import bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
SIGNS = ["a", "'s", "'", "s", " ", "  ", "\n", "\t", "é", "1", "22", "!", "..", "\x1c", "\x85", "中", "𝔘", "we'll", " x", "　"]


@pytest.fixture(scope="module")
def coder():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_chunks_give_the_ids_of_the_whole_text(spark, coder):
    rng = random.Random(1)
    texts = ["".join(rng.choices(SIGNS, k=rng.choice([1, 50, 400]))) for _ in range(200)]
    texts += ["a" * 500, " " * 333, " \x85x" * 90, "don't" * 60]
    docs = spark.createDataFrame(odd_rows(texts), ODD)
    rows = bpe.encode(docs, bpe.Vocabulary.load(), chunk_chars=64, overlap_chars=12)
    assert [name for name in rows.columns if name != "ids"] == [name for name in docs.columns if name != "ids"]
    rows = rows.select("text", "ids").collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert row["ids"] == np.array(coder.encode_ordinary(row["text"] or ""), "<u4").tobytes()


def test_digests_and_decoding(spark, coder):
    texts = [prose(i, 40) for i in range(5)] + [None, "", "naïve <|endoftext|> 🙂"]
    rows = bpe.encode_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), bpe.Vocabulary.load())
    for row in rows.collect():
        text = texts[row["doc_id"]] or ""
        ids = np.array(coder.encode_ordinary(text), "<u4")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.encode_digests(spark.createDataFrame([], "doc_id bigint, text string"), bpe.Vocabulary.load()).count() == 0
