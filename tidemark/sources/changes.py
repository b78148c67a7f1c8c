"""Captured database changes and the rule table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark import schemas
from tidemark.functions.records import parse_json
from tidemark.operators.changes import current_rules


def parse_changes(lines: DataFrame) -> DataFrame:
    """Change envelopes from JSON messages."""
    return parse_json(lines, schemas.CHANGE)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The routing rules as they are now; call it per micro-batch to see new ones."""
    return current_rules(spark.read.schema(schemas.RULE).json(path))
