"""Helpers of the text operators: Arrow batches, bounded lookups, stored intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tidemark.session import scratch_path

# Rows handed to a Python function at a time, so that its lists stay small beside the Arrow batch.
SLICE_ROWS = 256
# Bytes of an Arrow batch on its way to Python, so that long texts do not add up there.
BATCH_BYTES = 2 << 20
# A key with more than this share of all rows is joined by broadcast: at most 1000 keys can have it.
HOT_SHARE = 0.001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session are closed at ``BATCH_BYTES``, not only by their number of rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def bounded(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, which takes a session first, with ``bound_batches``."""

    def run(spark: SparkSession, *args) -> DataFrame:
        bound_batches(spark)
        return query(spark, *args)

    return run


def computed(column: str, compute: Callable[[list], list], made: str) -> Column:
    """What ``compute`` makes of a column's values, ``SLICE_ROWS`` at a time. Only that column goes to Python."""
    kind = to_arrow_type(StructType.fromDDL(f"made {made}")["made"].dataType)

    def run(values: pa.Array) -> pa.Array:
        parts = [values.slice(start, SLICE_ROWS) for start in range(0, len(values), SLICE_ROWS)]
        found = [pa.array(compute(part.to_pylist()), kind) for part in parts]
        return pa.concat_arrays(found) if found else pa.array([], kind)

    # Named types, as the function travels without this module's annotations.
    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, made)(F.col(f"`{column}`"))


def stored(rows: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read back: computed once, and safe if an executor is lost."""
    path = scratch_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def add_columns(
    rows: DataFrame, column: str, compute: Callable[[list], dict[str, list]], made: str, keep: list[str] | None = None
) -> DataFrame:
    """``keep`` (all columns but ``column`` if left out) and the columns that ``compute`` makes of a list of values.

    ``made`` is the DDL of the new columns. ``compute`` sees ``SLICE_ROWS`` values at a time.
    """
    kept = [name for name in rows.columns if name != column] if keep is None else keep
    new = StructType.fromDDL(made)
    schema = StructType([rows.schema[name] for name in kept] + list(new.fields))
    types = {field.name: to_arrow_type(field.dataType) for field in new.fields}
    asked = list(dict.fromkeys([*kept, column]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                values = compute(part.column(asked.index(column)).to_pylist())
                arrays = [part.column(asked.index(name)) for name in kept]
                arrays += [pa.array(values[name], kind) for name, kind in types.items()]
                yield pa.RecordBatch.from_arrays(arrays, [*kept, *types])

    return rows.select(*asked).mapInArrow(run, schema)


def expand(rows: DataFrame, compute: Callable[[dict[str, list]], dict[str, list]], made: str) -> DataFrame:
    """Rows that ``compute`` makes, any number, from the columns of ``SLICE_ROWS`` rows at a time."""
    schema = StructType.fromDDL(made)
    types = {field.name: to_arrow_type(field.dataType) for field in schema.fields}
    names = list(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                values = compute({name: part.column(i).to_pylist() for i, name in enumerate(names)})
                arrays = [pa.array(values[name], kind) for name, kind in types.items()]
                yield pa.RecordBatch.from_arrays(arrays, list(types))

    return rows.mapInArrow(run, schema)


def lookup(rows: DataFrame, found: DataFrame, keys: list[str], uses: str) -> DataFrame:
    """``rows`` left-joined to ``found`` (one row per key) with no task that gathers a hot key.

    ``uses`` is the column of ``found`` with the number of rows that look the key up; it is dropped.
    Keys above ``HOT_SHARE`` of all lookups, fewer than ``1 / HOT_SHARE`` by arithmetic, are
    broadcast. The rows they answer, and rows whose key is null, go through the join of the other
    keys under keys of their own, spread by content.
    """
    # Read three times below, so it is computed once.
    found = stored(found, "lookup")
    total = found.agg(F.sum(uses)).first()[0] or 0
    least = max(1000, int(total * HOT_SHARE))
    values = [name for name in found.columns if name not in (*keys, uses)]
    hot = found.where(F.col(uses) > least).drop(uses)
    hot = hot.select(*keys, F.struct(*values).alias("hot_found"))
    cold = found.where(F.col(uses) <= least).drop(uses)
    cold = cold.select(*keys, F.lit(0).cast("bigint").alias("spread_key"), F.struct(*values).alias("cold_found"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    plain = F.col("hot_found").isNull()
    for key in keys:
        plain = plain & F.col(key).isNotNull()
    hashable = [field.name for field in rows.schema if field.dataType.typeName() not in ("map", "variant")]
    other = F.xxhash64(*hashable).bitwiseOR(F.lit(1))
    marked = marked.withColumn("spread_key", F.when(plain, F.lit(0).cast("bigint")).otherwise(other))
    joined = marked.join(cold, [*keys, "spread_key"], "left")
    answer = F.coalesce("hot_found", "cold_found")
    return joined.select(*[F.col(name) for name in rows.columns], *[answer[name].alias(name) for name in values])
