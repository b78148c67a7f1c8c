"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one key that one task takes; a key with more is spread over as many tasks as that makes.
HOT_ROWS = 1_000_000
# A lookup with at most this many rows is broadcast.
BROADCAST_ROWS = 100_000
# Shuffled bytes of a task within ``small_tasks``; in memory, rows and aggregates are many times larger.
TASK_BYTES = 8 << 20
# Spark's estimate where it knows nothing.
UNKNOWN_BYTES = (1 << 63) - 1
TASK_SETTING = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
PARTITIONS_SETTING = "spark.sql.shuffle.partitions"
# The most partitions that ``small_tasks`` asks for: each costs every task before the shuffle one block.
MOST_PARTITIONS = 10_000


def estimated_bytes(rows: DataFrame) -> int:
    """Spark's own size estimate, from file sizes; very large where it knows nothing."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def read_bytes(rows: DataFrame) -> int:
    """Spark's size estimate of the tables that are read, without those it knows nothing about.

    That of a join may be the product of its sides.
    """
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(size for size in sizes if size < UNKNOWN_BYTES)


@contextmanager
def small_tasks(spark: SparkSession, task_bytes: int = TASK_BYTES, shuffled: int = 0) -> Iterator[None]:
    """Jobs run within it get tasks of at most about ``task_bytes`` shuffled bytes, if the shuffle has enough partitions.

    ``shuffled`` is about what a shuffle will hold; shuffles get as many partitions as that asks for, if these are
    more than the session has. Adaptive execution puts together what turns out smaller.
    """
    held = {TASK_SETTING: spark.conf.get(TASK_SETTING), PARTITIONS_SETTING: spark.conf.get(PARTITIONS_SETTING)}
    if _bytes(held[TASK_SETTING]) > task_bytes:
        spark.conf.set(TASK_SETTING, f"{task_bytes}b")
    asked = min(-(-shuffled // task_bytes), MOST_PARTITIONS)
    if int(held[PARTITIONS_SETTING]) < asked:
        spark.conf.set(PARTITIONS_SETTING, str(asked))
    try:
        yield
    finally:
        for setting, value in held.items():
            spark.conf.set(setting, value)


def _bytes(text: str) -> int:
    text = text.lower().removesuffix("b")
    unit = "kmgt".find(text[-1]) + 1
    return int(text[:-1] if unit else text) << 10 * unit


def fits_broadcast(rows: DataFrame) -> bool:
    """Whether a lookup is small: by Spark's estimate, or else by counting its rows up to the bound.

    The estimate does not know that an aggregate shrinks its input or that a join need not multiply its
    sides, so a table of a few rows may look large. Counting stops just above the bound.
    """
    limit = rows.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if limit > 0 and estimated_bytes(rows) <= limit:
        return True
    return not rows.isStreaming and rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def hot_keys(rows: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, and the ``salts`` that spread them to about that many each.

    At most ``count(rows) / hot_rows`` keys can pass, so the result is small by construction.
    """
    counted = rows.where(F.coalesce(*keys).isNotNull()).groupBy(*keys).agg(F.count("*").alias("key_rows"))
    salts = F.ceil(F.col("key_rows") / hot_rows).cast("int")
    return counted.where(F.col("key_rows") > hot_rows).select(*keys, salts.alias("salts"))


def _content_hash(rows: DataFrame) -> Column:
    """A hash of the row, from all columns Spark can hash (it hashes no maps or variants)."""
    kinds = {field.name: field.dataType.simpleString() for field in rows.schema}
    return F.xxhash64(*[F.col(name) for name, kind in kinds.items() if "map<" not in kind and "variant" not in kind])


def spread_join(
    many: DataFrame,
    one: DataFrame,
    keys: list[str],
    how: str = "inner",
    hot_rows: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """``many.join(one, keys, how)`` with the rows of hot keys spread over several tasks.

    Rows of ``many`` under a hot key get a salt from their own content, as many salts as the key's count
    asks for, and the matching rows of ``one`` are repeated once per salt. All other keys have the single
    salt 0. Every pair meets exactly once, so the result is that of the plain join. ``how`` is ``inner``
    or ``left``. Batch only: counting keys needs the whole input.

    Keys are counted on ``counted``, by default ``many``. Where ``many`` is costly to compute,
    name the table its keys come from: which keys are spread does not change the result.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    hot = F.broadcast(hot_keys(many if counted is None else counted, keys, hot_rows or HOT_ROWS))
    salts = F.col("salts")
    if how == "left":
        # A null key finds nothing; without a salt all of them would meet in one task.
        null = F.lit(False)
        for key in keys:
            null = null | F.col(key).isNull()
        salts = F.when(null, F.lit(1 << 20)).otherwise(salts)
    own_salt = F.pmod(_content_hash(many), F.coalesce(salts, F.lit(1))).cast("int")
    salted_many = many.join(hot, keys, "left").withColumn("salt", own_salt).drop("salts")
    every_salt = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    salted_one = one.join(hot, keys, "left").withColumn("salt", F.explode(every_salt)).drop("salts")
    return salted_many.join(salted_one, [*keys, "salt"], how).drop("salt")


def lookup_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", counted: DataFrame | None = None
) -> DataFrame:
    """Join to a lookup table with unique keys.

    A small lookup (``fits_broadcast``) is broadcast. Beyond it, ``counted`` (see ``spread_join``)
    spreads hot keys from the start; without it the join is left to adaptive execution, which splits
    the skewed partitions it measures and needs no pass over the rows.
    """
    if fits_broadcast(lookup):
        return rows.join(F.broadcast(lookup), keys, how)
    if rows.isStreaming or counted is None:
        return rows.join(lookup, keys, how)
    return spread_join(rows, lookup, keys, how, counted=counted)
