"""Behaviour logs: new-visitor repair, start/page split, displays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repair_new_flag(logs: DataFrame, tie: list[str]) -> DataFrame:
    """Keep ``is_new = '1'`` only on the first record of a ``mid`` that claims it.

    Later claims become ``'0'``; records that claim nothing pass unchanged. First means lowest
    ``ts``, then lowest ``tie``; ``(mid, ts, *tie)`` must identify a claim.

    Batch form (the streaming one is ``tidemark.streaming.processors.repair_new_flag_stream``).
    The first claim of a mid is a ``min``, reduced before the shuffle, and claims then meet it on
    their whole identity rather than on ``mid``, so the claims of one busy mid do not share a task.
    """
    claims = logs.where(F.col("common.is_new") == "1")
    rest = logs.where(~F.col("common.is_new").eqNullSafe("1"))
    identity = ["ts", *tie]
    firsts = (
        claims.select(F.col("common.mid").alias("claim_mid"), *identity)
        .groupBy("claim_mid")
        .agg(F.min(F.struct(*identity)).alias("first"))
        .select("claim_mid", "first.*", F.lit(True).alias("is_first"))
    )
    keys = ["claim_mid", *identity]
    repaired = (
        claims.withColumn("claim_mid", F.col("common.mid"))
        .join(firsts, keys, "left")
        .withColumn(
            "common",
            F.col("common").withField("is_new", F.when(F.col("is_first"), F.lit("1")).otherwise("0")),
        )
        .select(*logs.columns)
    )
    return repaired.unionByName(rest)


def tag_logs(logs: DataFrame) -> DataFrame:
    """Add ``kind``, ``start`` or ``page``: both kinds in one pass, for a sink split by ``kind``."""
    return logs.withColumn("kind", F.when(F.col("start").isNotNull(), "start").otherwise("page"))


def start_logs(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("start").isNotNull()).select("common", "start", "ts")


def page_logs(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("start").isNull()).drop("start")


def display_logs(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per displayed item, with the time and page it was shown on."""
    return pages.select(
        F.explode("displays").alias("display"), "ts", F.col("page.page_id").alias("page_id"), *(keep or [])
    ).select("display.*", "ts", "page_id", *(keep or []))


def is_entry_page() -> Column:
    """The first page of a visit has no page before it."""
    return F.col("page.last_page_id").isNull()
