"""Unique visits and bounces, batch forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import millis_to_text, millis_to_time
from tidemark.operators.latest import earliest_rows
from tidemark.operators.logs import is_entry_page

HOUR_MS = 3_600_000


def visit_key(granularity: str):
    """What one visitor may be counted once for: a calendar day, or a second."""
    if granularity == "day":
        return F.to_date(millis_to_time("ts"))
    if granularity == "second":
        return millis_to_text("ts")
    raise ValueError(f"granularity must be day or second, not {granularity!r}")


def unique_visits(pages: DataFrame, tie: list[str], granularity: str = "day") -> DataFrame:
    """The first entry page of every visitor and day, by ``(ts, *tie)``."""
    entries = pages.where(is_entry_page()).withColumns(
        {"visit_mid": F.col("common.mid"), "visit_key": visit_key(granularity)}
    )
    first = earliest_rows(entries, ["visit_mid", "visit_key"], ["ts", *tie])
    return first.select(*pages.columns)


def _judged(pages: DataFrame, tie: list[str], gap_ms: int, chunk: Column, before: Column, follows: Column) -> DataFrame:
    """Pages with ``is_bounce`` and, for entry pages, their ``entry_no`` in the chunk.

    ``lead`` runs per mid and chunk of time, so a mid with very many pages is spread over its chunks.
    Pages that ``follows`` marks, those within the gap after a chunk's start, are also shown to the chunk
    before it, as rows that are only looked at. All is one pass over the pages, one shuffle and one sort.
    """
    own = F.struct(chunk.alias("chunk"), F.lit(True).alias("is_own"))
    ahead = F.struct(before.alias("chunk"), F.lit(False).alias("is_own"))
    part = F.explode(F.when(follows, F.array(own, ahead)).otherwise(F.array(own)))
    shown = pages.withColumns({"chunk_mid": F.col("common.mid"), "is_entry": is_entry_page(), "part": part})
    shown = shown.withColumns({"chunk": F.col("part.chunk"), "is_own": F.col("part.is_own")}).drop("part")
    order = Window.partitionBy("chunk_mid", "chunk").orderBy("ts", *tie)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    judged = shown.withColumns(
        {
            "following": F.lead(F.struct("ts", "is_entry")).over(order),
            "entry_no": F.count(F.when(F.col("is_own") & F.col("is_entry"), 1)).over(so_far),
        }
    ).where("is_own")
    stays = F.col("following").isNotNull() & ~F.col("following.is_entry")
    stays = stays & (F.col("following.ts") - F.col("ts") < gap_ms)
    is_bounce = (F.col("is_entry") & ~stays).alias("is_bounce")
    return judged.select(*pages.columns, is_bounce, F.when(F.col("is_entry"), F.col("entry_no")).alias("entry_no"))


def bounces(pages: DataFrame, tie: list[str], gap_ms: int = 10_000, chunk_ms: int = HOUR_MS) -> DataFrame:
    """Entry pages not followed by another page of the visit within ``gap_ms``.

    In order of ``(ts, *tie)`` within a ``mid``, an entry page is a bounce unless the next page is
    a non-entry page less than ``gap_ms`` later. Only pages closer than the gap matter, so time is cut
    into chunks no shorter than the gap.
    """
    chunk_ms = max(chunk_ms, gap_ms)
    chunk = F.floor(F.col("ts") / F.lit(chunk_ms))
    judged = _judged(pages, tie, gap_ms, chunk, chunk - 1, F.col("ts") - chunk * chunk_ms < gap_ms)
    return judged.where("is_bounce").select(*pages.columns)


def with_visit_marks(pages: DataFrame, tie: list[str], gap_ms: int = 10_000) -> DataFrame:
    """Pages with ``is_bounce`` and ``is_visit``, whether it is the visitor's first entry page of the day.

    Days are the chunks, so both are found in one pass; the gap must not be longer than a day.
    """
    if gap_ms > 24 * HOUR_MS:
        raise ValueError("the gap must not be longer than a day")
    day = visit_key("day")
    since = F.col("ts") - F.unix_millis(F.date_trunc("day", millis_to_time("ts")))
    judged = _judged(pages, tie, gap_ms, day, F.date_sub(day, 1), since < gap_ms)
    return judged.withColumn("is_visit", F.coalesce(F.col("entry_no") == 1, F.lit(False))).drop("entry_no")
