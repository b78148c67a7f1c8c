"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts, a small classifier learns which part a
vector belongs to, and every row goes to its most probable part. A query looks at its several most
probable parts and reranks what is there by the exact measure.

Equal vectors are one class, searched once: a class carries the ``k + 1`` smallest ids, of which no answer
can need more. Parts that follow each other, which lie near each other in the graph, make up a shard of
bounded size, which a query visits once; a larger part is dealt over shards of its own. So are the queries
of a shard, and nothing is left out of either.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import parts as learned
from tidemark.llm.common import add_columns, lookup, stored

cloudpickle.register_pickle_by_value(sys.modules[learned.__name__])

# Vectors the index is fitted on at most; every row is indexed.
SAMPLE_ROWS = 8192
# Rows of a part aimed at, and parts at most: a part has to be seen in the sample.
PART_ROWS = 1024
MOST_PARTS = 256
# Share of true neighbours that must lie in the parts looked at.
TARGET = 0.95
# Candidates of a shard, and queries that meet them in one group of rows.
BLOCK_ROWS = 16_384
QUERY_ROWS = 8_192
# Queries scored at a time.
SCORE_ROWS = 256

KEY = ["key_a", "key_b"]
FOUND = "key_a bigint, key_b bigint, ids array<bigint>, scores array<double>"


def valid_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vec, key_a, key_b) of the rows that take part.

    Null ids and vectors, zero vectors, and vectors with null or non-finite components take no part; nor do
    vectors of another length than the most frequent one (of equally frequent ones the shortest). Rows
    equal in id and vector count once.
    """
    element = rows.schema[vector].dataType.elementType
    wide = element if isinstance(element, T.FloatType) else T.DoubleType()
    thin = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast(T.ArrayType(wide)).alias("vec"))
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    thin = thin.where(F.col("vec_id").isNotNull() & finite & F.exists("vec", lambda c: c != 0))
    sizes = thin.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    thin = thin.where(F.size("vec") == (sizes["dims"] if sizes else 0))
    # Minus zero and zero are the same component.
    same = F.transform("vec", lambda c: c + F.lit(0.0).cast(wide))
    keyed = thin.withColumn("vec", same)
    return keyed.withColumns({"key_a": F.xxhash64("vec"), "key_b": F.xxhash64(F.lit(1), "vec")})


def _classes(rows: DataFrame, most: int) -> DataFrame:
    """(key, vec, ids): each distinct vector with its ``most`` smallest ids, reduced before the shuffle."""
    order = Window.partitionBy(*KEY).orderBy("vec_id")
    least = rows.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= most).drop("place")
    return least.groupBy(*KEY).agg(F.first("vec").alias("vec"), F.array_sort(F.collect_set("vec_id")).alias("ids"))


def _matrix(vectors: list) -> np.ndarray:
    return np.array(vectors, np.float64) if vectors else np.zeros((0, 0))


def _fit(classes: DataFrame, total: int, k: int) -> tuple[learned.Router | None, int]:
    """The router, learned from at most ``SAMPLE_ROWS`` vectors with the least hashes, and parts to look at."""
    count = max(1, min(math.ceil(total / PART_ROWS), MOST_PARTS))
    if count == 1:
        return None, 1
    sample = classes.select("vec").orderBy(F.xxhash64(F.lit(7), *KEY), *KEY).limit(SAMPLE_ROWS).toArrow()
    vectors = _matrix(sample.column("vec").to_pylist())
    return learned.learn(vectors, count, max(1, math.ceil(k * len(vectors) / total)), TARGET)


def _with_parts(rows: DataFrame, router: learned.Router | None, probes: int, keep: list[str]) -> DataFrame:
    """``keep`` and ``parts``, the ``probes`` most probable parts of each vector."""
    if router is None:
        return rows.select(*keep, F.array(F.lit(0)).alias("parts"))

    def compute(vectors: list) -> dict[str, list]:
        odds = router.probabilities(_matrix(vectors))
        return {"parts": np.argsort(-odds, axis=1, kind="stable")[:, :probes].tolist()}

    copied = rows.select(*keep, F.col("vec").alias("routed"))
    return add_columns(copied, "routed", compute, "parts array<int>", keep)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Where scores reach the ``k``-th largest of their row, but for rounding, and are not minus infinity."""
    real = scores > -np.inf
    if scores.shape[1] <= k:
        return real
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    slack = 1e-9 * np.where(real, np.abs(scores), 1e-300).max(axis=1)
    return real & (scores >= (edge - slack)[:, None])


def _rerank(k: int, count: int):
    """What queries find among the candidates of a shard, in the parts they look at, by exact inner products."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: dict[str, list] = {name: [] for name in ("key_a", "key_b", "ids", "scores")}
        if asked.num_rows and held.num_rows:
            queries, vectors = (_matrix(side.column("vec").to_pylist()) for side in (asked, held))
            ids, part_of = held.column("ids").to_pylist(), held.column("part").to_numpy()
            keys = [asked.column(name).to_pylist() for name in KEY]
            probed = asked.column("parts").to_pylist()
            for start in range(0, len(queries), SCORE_ROWS):
                some = queries[start : start + SCORE_ROWS]
                looks = np.zeros((len(some), count), bool)
                for i, parts in enumerate(probed[start : start + SCORE_ROWS]):
                    looks[i, parts] = True
                near = _best(np.where(looks[:, part_of], some @ vectors.T, -np.inf), k)
                for i, row in enumerate(near):
                    places = np.flatnonzero(row)
                    # The same order of additions for every pair, wherever it is computed.
                    exact = (vectors[places] * some[i]).sum(axis=1).tolist()
                    pairs = [(-s, vec_id) for s, place in zip(exact, places, strict=True) for vec_id in ids[place]]
                    pairs = sorted(pairs)[:k]
                    out["key_a"].append(keys[0][start + i])
                    out["key_b"].append(keys[1][start + i])
                    out["ids"].append([vec_id for _, vec_id in pairs])
                    out["scores"].append([-s for s, _ in pairs])
        lists = {"ids": pa.list_(pa.int64()), "scores": pa.list_(pa.float64())}
        return pa.table({name: pa.array(values, lists.get(name, pa.int64())) for name, values in out.items()})

    return run


def _shards(sizes: dict[int, int], count: int) -> list[tuple[int, int, int]]:
    """(part, first shard, number of shards): small parts in a row share one, a large part has several."""
    out, shard, held = [], 0, 0
    for part in range(count):
        size = sizes.get(part, 0)
        if held and held + size > BLOCK_ROWS:
            shard, held = shard + 1, 0
        several = max(1, math.ceil(size / BLOCK_ROWS))
        out.append((part, shard, several))
        held += size
        if several > 1:
            shard, held = shard + several, 0
    return out


def nearest_neighbours(
    rows: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the ``k`` nearest of ``rows`` found.

    Nearness is the inner product in double precision, ties go to the smaller id, and candidates with
    the query's own id are left out. With fewer candidates than ``k`` all of them are returned. See
    ``valid_vectors`` for rows that take no part; an empty table gives no rows, other columns are ignored.
    """
    known = stored(_classes(valid_vectors(rows, vec_id, vector), k + 1), "classes")
    asked = stored(valid_vectors(queries, vec_id, vector).distinct(), "queries")
    counts = asked.groupBy(*KEY).agg(F.first("vec").alias("vec"), F.count("*").alias("uses"))
    total = known.count()
    router, probes = _fit(known, total, k)
    placed = _with_parts(known, router, 1, [*KEY, "vec", "ids"]).withColumn("part", F.col("parts")[0]).drop("parts")
    placed = stored(placed, "placed")
    # At most MOST_PARTS rows.
    count = len(router.weights[3]) if router else 1
    sizes = {row["part"]: row["count"] for row in placed.groupBy("part").count().collect()}
    dealt = _shards(sizes, count)
    first, several = (F.array(*[F.lit(one[i]) for one in dealt]) for i in (1, 2))
    own = F.pmod(F.xxhash64(F.lit(3), *KEY), F.get(several, "part")).cast("int")
    held = placed.withColumn("shard", F.get(first, "part") + own)

    def of_part(part: Column) -> Column:
        return F.sequence(F.get(first, part), F.get(first, part) + F.get(several, part) - 1)

    probed = _with_parts(counts, router, probes, [*KEY, "vec"])
    probed = probed.withColumn("shard", F.explode(F.array_distinct(F.flatten(F.transform("parts", of_part)))))
    probed = stored(probed, "probed")
    asks = probed.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(QUERY_ROWS)).cast("int").alias("asks"))
    left = probed.join(asks, "shard").withColumn("ask", F.pmod(F.xxhash64(F.lit(5), *KEY), F.col("asks")).cast("int"))
    right = held.join(asks, "shard").withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
    cell = ["shard", "ask"]
    left = left.select(*KEY, "vec", "parts", *cell).groupBy(*cell)
    right = right.select("vec", "ids", "part", *cell).groupBy(*cell)
    found = left.cogroup(right).applyInArrow(_rerank(k + 1, count), FOUND)
    pairs = found.select(*KEY, F.explode(F.arrays_zip("ids", "scores")).alias("pair"))
    order = Window.partitionBy(*KEY).orderBy(F.desc("pair.scores"), "pair.ids")
    best = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    pair = F.struct("place", F.col("pair.ids").alias("vec_id"), F.col("pair.scores").alias("score"))
    answers = best.groupBy(*KEY).agg(F.array_sort(F.collect_list(pair)).alias("answer"))
    answers = answers.join(counts.select(*KEY, "uses"), KEY)
    told = lookup(asked.select("vec_id", *KEY), answers, KEY, "uses")
    others = F.slice(F.filter("answer", lambda one: one["vec_id"] != F.col("vec_id")), 1, k)
    listed = told.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("i", "one"))
    return listed.select(
        "query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), F.col("one.score").alias("score")
    )
