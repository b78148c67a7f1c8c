"""Database change records: envelope, rules, routing, dimension rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.constants import SINK_HBASE, SINK_KAFKA
from tidemark.operators.latest import latest_rows
from tidemark.operators.skew import lookup_join

_EMPTY = "cast(map() as map<string,string>)"


def normalise_changes(raw: DataFrame) -> DataFrame:
    """Captured records as the common envelope.

    ``raw`` has ``topic`` (``server.database.table``), ``op``, ``before``, ``after`` and ``seq``,
    which orders the changes. Initial reads and creations both become inserts.
    """
    parts = F.split("topic", r"\.")
    kind = F.lower("op")
    return raw.select(
        parts[1].alias("database"),
        parts[2].alias("tableName"),
        F.coalesce("before", F.expr(_EMPTY)).alias("before"),
        F.coalesce("after", F.expr(_EMPTY)).alias("after"),
        F.when(kind.isin("create", "read"), "insert").otherwise(kind).alias("type"),
        "seq",
    )


def drop_deletes(changes: DataFrame) -> DataFrame:
    return changes.where(~F.col("type").eqNullSafe("delete"))


def current_rules(rules: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One rule per source table and operation: the last by ``order``, if an order is given."""
    if order:
        rules = latest_rows(rules, ["sourceTable", "operateType"], order).drop(*order)
    return rules.withColumns(
        {"sinkPk": F.coalesce("sinkPk", F.lit("id")), "sinkExtend": F.coalesce("sinkExtend", F.lit(""))}
    )


def route_changes(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """Changes that have a rule, with ``after`` cut to the rule's columns and the sink's name."""
    wanted = rules.select(
        F.col("sourceTable").alias("tableName"),
        F.col("operateType").alias("type"),
        "sinkType",
        "sinkTable",
        F.split("sinkColumns", ",").alias("sinkColumns"),
        F.col("sinkPk").alias("Pk"),
    )
    routed = lookup_join(changes, wanted, ["tableName", "type"])
    kept = F.map_filter("after", lambda name, _: F.array_contains(F.col("sinkColumns"), name))
    return routed.withColumn("after", kept).drop("sinkColumns")


def to_topics(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("sinkType") == SINK_KAFKA)


def to_dimensions(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("sinkType") == SINK_HBASE)


def unrouted(routed: DataFrame) -> DataFrame:
    """Changes whose rule names a sink nobody writes to."""
    known = F.col("sinkType").isin(SINK_KAFKA, SINK_HBASE)
    return routed.where(~F.coalesce(known, F.lit(False)))


def with_output(routed: DataFrame) -> DataFrame:
    """Add ``output``, ``topic``, ``dimension`` or ``unrouted``: all three in one pass, for a sink split by it."""
    output = F.when(F.col("sinkType") == SINK_KAFKA, "topic").when(F.col("sinkType") == SINK_HBASE, "dimension")
    return routed.withColumn("output", output.otherwise("unrouted"))


def topic_messages(routed: DataFrame) -> DataFrame:
    """``topic`` and JSON ``value`` of each fact change."""
    return to_topics(routed).select(F.col("sinkTable").alias("topic"), F.to_json("after").alias("value"))


def dimension_changes(routed: DataFrame) -> DataFrame:
    """Dimension changes by sink table and value of the primary key."""
    return to_dimensions(routed).select(
        "sinkTable", F.element_at("after", F.col("Pk")).alias("pk"), "after", "seq"
    )


def latest_dimensions(changes: DataFrame) -> DataFrame:
    """The newest row of every dimension key. Deletes never arrive, so keys stay."""
    return latest_rows(changes, ["sinkTable", "pk"], ["seq"])


def dimension_table(latest: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """One dimension as a table of text columns."""
    rows = latest.where(F.col("sinkTable") == table)
    return rows.select(*[F.element_at("after", F.lit(name)).alias(name) for name in columns])
