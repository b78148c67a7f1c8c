"""JSON text, CSV text and column naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.constants import BUSINESS_CODES


def parse_json(lines: DataFrame, schema: str, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """One JSON object per line as typed columns; ``keep`` carries other columns along."""
    kept = [F.col(name) for name in keep or []]
    return lines.select(F.from_json(column, schema).alias("record"), *kept).select("record.*", *(keep or []))


def is_json_object(column: Column | str) -> Column:
    """True where the text is one well-formed JSON object."""
    return F.json_object_keys(column).isNotNull()


def split_dirty(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Lines that hold a JSON object, and the others."""
    return lines.where(is_json_object(column)), lines.where(~is_json_object(column))


def parse_or_keep(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Typed columns of every line and ``dirty``: the text of a line that is no JSON object, else null.

    One pass for a sink that is split by ``dirty``, the same split as ``split_dirty``. A line is parsed
    once; only one that did not parse to the schema is looked at again. A null line is dirty and has
    the empty text.
    """
    record = F.from_json(column, f"{schema}, unparsed string", {"columnNameOfCorruptRecord": "unparsed"})
    parsed = lines.select(record.alias("record"), F.col(column).alias("line"))
    whole = F.col("record.unparsed").isNull() & F.coalesce(F.ltrim("line").startswith("{"), F.lit(False))
    dirty = F.when(whole, None).when(is_json_object("line"), None).otherwise(F.coalesce("line", F.lit("")))
    return parsed.select("record.*", dirty.alias("dirty")).drop("unparsed")


def to_json_lines(rows: DataFrame) -> DataFrame:
    """Every row as one JSON text in ``value``; null fields are left out."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def parse_sensor_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``id,ts,vc`` CSV lines as typed columns."""
    parts = F.split(F.col(column), ",")
    return lines.select(
        parts[0].alias("id"),
        parts[1].try_cast("bigint").alias("ts"),
        parts[2].try_cast("double").alias("vc"),
    )


def camel_case_columns(rows: DataFrame) -> DataFrame:
    """Rename ``UNDER_SCORE`` columns to ``underScore``."""

    def camel(name: str) -> str:
        first, *rest = name.lower().split("_")
        return first + "".join(word.capitalize() for word in rest)

    return rows.toDF(*[camel(name) for name in rows.columns])


def business_codes(spark: SparkSession) -> DataFrame:
    """The code table as rows to join against."""
    rows = [(code, group, meaning) for code, (group, meaning) in BUSINESS_CODES.items()]
    return spark.createDataFrame(rows, "code string, code_group string, meaning string")


