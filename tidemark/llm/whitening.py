"""Whitening of embeddings: exact moments of quantised vectors, leading components, projections.

The passes over the rows are Spark's: distinct vectors, their sums, their products, the projections. The
sums are of whole numbers and therefore the same for any layout of the rows. Only the square matrix of a
vector's size reaches the driver, where ``contour`` finds its components.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import contour
from tidemark.llm.common import add_columns, stored

cloudpickle.register_pickle_by_value(sys.modules[contour.__name__])

# Steps to the unit of the quantised vectors.
STEPS = 256
# Vectors multiplied at a time, and sums kept exact in doubles.
BLOCK_ROWS = 4096
EXACT = 2**53
# Quantised entries must be whole numbers that a long holds.
LONG_LIMIT = 2.0**62


@dataclass
class Whitening:
    """Moments of the fit list and its components: columns of ``vectors``, falling ``values``."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float


def quantised(rows: DataFrame, vector: str, made: str = "x") -> DataFrame:
    """Rows whose vector is whole, with its entries as whole ``STEPS``-ths (array of long).

    Rows are dropped if the vector is null, is empty, holds null or non-finite entries or one whose
    quantised value a long cannot hold, or has another length than the most frequent one (of equally
    frequent ones the shortest).
    """
    entries = F.col(vector).cast(T.ArrayType(T.DoubleType()))
    whole = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LONG_LIMIT / STEPS))
    rows = rows.where((F.size(vector) > 0) & whole)
    sizes = rows.groupBy(F.size(vector).alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    rows = rows.where(F.size(vector) == (sizes["dims"] if sizes else 0))
    return rows.withColumn(made, F.transform(entries, lambda c: F.floor(c * STEPS).cast("bigint")))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            lists = batch.column(0).slice(start, BLOCK_ROWS)
            yield lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _exact_products(y: np.ndarray) -> np.ndarray:
    """Sums of products of whole numbers as Python integers, by doubles where these hold them exactly."""
    most = int(max(abs(int(y.min(initial=0))), abs(int(y.max(initial=0)))))
    if most * most * max(len(y), 1) < EXACT:
        return (y.T.astype(float) @ y.astype(float)).astype(np.int64).astype(object)
    return y.T.astype(object) @ y.astype(object)


def _moments(fit: DataFrame, center: list[int]) -> list[list[int]]:
    """Sum over the fit list of ``(x - center)(x - center)'``: partial sums per task, then per matrix row."""
    dims = len(center)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for x in _blocks(batches):
            total = total + _exact_products(x - np.array(center))
        # Whole numbers of any size travel as two halves that are summed apart.
        high = [[int(v) >> 40 for v in row] for row in total]
        low = [[int(v) & (2**40 - 1) for v in row] for row in total]
        columns = [pa.array(range(dims), pa.int32())]
        columns += [pa.array(part, pa.list_(pa.int64())) for part in (high, low)]
        yield pa.RecordBatch.from_arrays(columns, ["line", "high", "low"])

    parts = fit.select("x").mapInArrow(run, "line int, high array<bigint>, low array<bigint>")
    cells = parts.select("line", F.posexplode(F.arrays_zip("high", "low")).alias("place", "cell"))
    wide = "decimal(38,0)"
    sums = cells.groupBy("line", "place").agg(
        F.sum(F.col("cell.high").cast(wide)).alias("high"), F.sum(F.col("cell.low").cast(wide)).alias("low")
    )
    out = [[0] * dims for _ in range(dims)]
    for row in sums.collect():
        out[row["line"]][row["place"]] = (int(row["high"]) << 40) + int(row["low"])
    return out


def _identity_error(fit: DataFrame, n: int, mean: np.ndarray, turn: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for x in _blocks(batches):
            white = (x - mean) @ turn
            total += white.T @ np.column_stack([white, np.ones(len(white))])
        columns = [pa.array(range(k), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["line", "sums"])

    parts = fit.select("x").mapInArrow(run, "line int, sums array<double>")
    cells = parts.select("line", F.posexplode("sums").alias("place", "value"))
    total = np.zeros((k, k + 1))
    for row in cells.groupBy("line", "place").agg(F.sum("value").alias("value")).collect():
        total[row["line"], row["place"]] = row["value"]
    total /= n
    covariance = total[:, :k] - np.outer(total[:, k], total[:, k])
    return float(np.abs(covariance - np.eye(k)).max())


def fit(x_rows: DataFrame, components: int = 4) -> Whitening | None:
    """Moments and leading components of the distinct ``x`` of the rows; None without rows.

    Components whose variance is zero, but for rounding, are left out, as they cannot be scaled.
    """
    distinct = stored(x_rows.select("x").distinct(), "fit-list")
    cells = distinct.select(F.posexplode("x").alias("place", "value"))
    totals = cells.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n"))
    found = sorted(totals.collect())
    if not found:
        return None
    n, sums = found[0]["n"], [int(row["total"]) for row in found]
    # Centred at the nearest whole number, so products are exact; what is left of the mean is taken off exactly.
    center = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, center, strict=True)]
    raw = _moments(distinct, center)
    exact = [[n * v - rest[i] * rest[j] for j, v in enumerate(line)] for i, line in enumerate(raw)]
    # Python divides whole numbers of any size with one rounding.
    matrix = np.array([[v / (n * n) for v in line] for line in exact])
    trace = sum(line[i] for i, line in enumerate(exact)) / (n * n)
    values, vectors = contour.eigenpairs(matrix, min(components, len(sums)))
    real = values > trace * len(sums) * np.finfo(float).eps
    values, vectors = values[real], vectors[:, real]
    error = 0.0
    if len(values):
        mean = np.array([s / n for s in sums])
        error = _identity_error(distinct, n, mean, vectors / np.sqrt(values))
    return Whitening(n, sums, trace, values, vectors, error)


def _project(found: Whitening):
    n, sums = found.n, found.sums
    center = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, center, strict=True)]
    square = sum(r * r for r in rest)
    shift = np.array([r / n for r in rest])
    turn = found.vectors / np.sqrt(found.values)

    def compute(vectors: list) -> dict[str, list]:
        y = np.array(vectors, np.int64).reshape(len(vectors), len(sums)) - np.array(center)
        most = int(np.abs(y).max(initial=0))
        whole = y if most * max(most, max(map(abs, rest))) * len(sums) < 2**62 else y.astype(object)
        squares, products = (whole * whole).sum(axis=1), (whole * np.array(rest, whole.dtype)).sum(axis=1)
        # The same order of additions for every row, whatever rows are beside it.
        white = ((y - shift)[:, :, None] * turn).sum(axis=1)
        deviation = [n * n * int(a) - 2 * n * int(b) + square for a, b in zip(squares, products, strict=True)]
        return {"deviation_text": [str(v) for v in deviation], "white": white.tolist()}

    return compute


def whiten(rows: DataFrame, keep: list[str], vector: str = "embedding", components: int = 4) -> DataFrame:
    """One row per row and component: ``keep`` and component, n, deviation, whitened, explained, identity_error.

    See ``quantised`` for rows that are dropped. Repeated rows stay and count once in the fit list.
    ``deviation`` is exact; where a long cannot hold it, which takes about a million vectors, it is null. No
    component is returned that has no variance, so a single distinct vector, like an empty table, gives no rows.
    """
    thin = rows.select(*keep, F.col(vector).alias("whitened_vector"))
    x_rows = quantised(thin, "whitened_vector").drop("whitened_vector")
    found = fit(x_rows, components)
    if found is None or not len(found.values):
        found = Whitening(1, [0], 1.0, np.zeros(0), np.zeros((1, 0)), 0.0)
        x_rows = x_rows.where("false")
    made = add_columns(x_rows, "x", _project(found), "deviation_text string, white array<double>", keep)
    explained = F.array(*[F.lit(float(value / found.trace)) for value in found.values]).cast("array<double>")
    listed = made.select(*keep, "deviation_text", F.posexplode("white").alias("i", "whitened"))
    return listed.select(
        *keep,
        (F.col("i") + 1).cast("int").alias("component"),
        F.lit(found.n).cast("bigint").alias("n"),
        F.col("deviation_text").try_cast("bigint").alias("deviation"),
        "whitened",
        F.get(explained, "i").alias("explained"),
        F.lit(found.identity_error).alias("identity_error"),
    )
