"""From raw documents to token ids: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, jaccard, line_quality, secrets
from tidemark.llm.common import bounded, table
from tidemark.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents whose lines are mostly content stay."""
    field = line_quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return line_quality.keep_good(docs, field)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates: of documents that share 0.8 of their five-word shingles one stays."""
    return jaccard.one_of_each_group(docs, words=5, percent=80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents that hold the text of a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: secrets are masked in the text; ``n_chars`` is that of the new text."""
    masked = secrets.mask_secrets(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: doc_id, lang, source, the number of ids and the ids as little-endian 32-bit integers."""
    encoded = bpe.encode(docs, bpe.Vocabulary.load())
    n_tokens = (F.octet_length("ids") / 4).cast("bigint")
    return encoded.select("doc_id", "lang", "source", n_tokens.alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", bounded(good_lines)),
    ("n-gram Jaccard join", bounded(distinct_documents)),
    ("benchmark decontamination", bounded(no_benchmark)),
    ("secret scans", bounded(no_secrets)),
    ("byte-level BPE", bounded(token_ids)),
]
# The labels of the first stage are a trained model's, and the ids of the last are no SQL expression.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"pipeline-{i}")
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
