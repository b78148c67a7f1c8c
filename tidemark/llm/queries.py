"""Registered queries of the text operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    bpe,
    decontaminate,
    html_text,
    jaccard,
    language,
    line_quality,
    neighbours,
    periodic,
    pii,
    repeats,
    secrets,
    warc,
    whitening,
)
from tidemark.llm.common import bounded, table
from tidemark.session import scratch_path


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), bpe.Vocabulary.load())


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard.near_groups(table(spark, sf_dir, "documents"), words=3, percent=90)
    return groups.select("doc_id", "n_shingles", "component_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), ["doc_id"])


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = line_quality.fit(docs, table(spark, sf_dir, "labels"))
    return line_quality.line_quality(docs, field, ["doc_id"])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).drop("payload", "url")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), ["vec_id"])


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.with_planted_runs(table(spark, sf_dir, "documents")))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest_neighbours(rows, rows.where("vec_id % 20 = 0"))


PLAIN: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_pii": op3_pii,
    "op4_line_quality": op4_line_quality,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language": op6_language,
    "op7_decontaminate": op7_decontaminate,
    "op8_warc": op8_warc,
    "op9_html_text": op9_html_text,
    "op10_secrets": op10_secrets,
    "op11_whitening": op11_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_neighbours": op13_neighbours,
}
QUERIES = {name: bounded(query) for name, query in PLAIN.items()}

ORACLES: dict[str, str] = {
    "op8_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first_page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first_page <> page_id THEN first_page END AS refers_to
        FROM f
    """,
}
