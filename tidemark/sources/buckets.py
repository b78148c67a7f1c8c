"""Keyed tables in hash buckets: upserts, versions and change detection.

A table is a folder with ``rows/version=<v>/bucket=<b>``, each bucket a set of files sorted by key, and a
manifest per version: for every bucket the version that holds it now, its rows and a digest, and a tree of
digests above the buckets. A version writes only the buckets it touches and becomes visible with its
manifest, so readers see whole versions, need no merging of their own, and can go back to older ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from tidemark.operators.latest import latest_rows

# Children of a node in the tree of digests, and buckets at most: what a manifest holds is bounded by these.
FANOUT = 16
MOST_BUCKETS = 65_536
# A manifest row is a bucket (level 0) or a node above it; ``held_by`` is the version with the bucket's rows. One
# more row, of level -1, is there even where the table is empty.
MANIFEST = "level int, node bigint, held_by bigint, n bigint, digest decimal(38,0)"


class BucketTable:
    """A table at ``path`` with one row per ``key`` (column names), in ``buckets`` buckets.

    The number of buckets belongs to the table: use the same for all versions. Keys must not be null in
    stored rows; rows with a null in their key are left out.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str], buckets: int) -> None:
        if not 1 <= buckets <= MOST_BUCKETS:
            raise ValueError(f"buckets must be from 1 to {MOST_BUCKETS}")
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def create(self) -> None:
        """An empty table, version 0."""
        self._write_manifest(self.spark.createDataFrame([], MANIFEST), 0)

    # Versions and manifests

    def _write_manifest(self, rows: DataFrame, version: int) -> None:
        mark = self.spark.createDataFrame([(-1, 0, version, 0, None)], MANIFEST)
        rows.unionByName(mark).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def _manifests(self) -> DataFrame:
        schema = StructType([*self.spark.createDataFrame([], MANIFEST).schema.fields])
        return self.spark.read.schema(schema.add("version", LongType())).parquet(f"{self.path}/manifest")

    def versions(self) -> list[int]:
        """All versions, rising; one that would have changed nothing was not made."""
        found = self._manifests().select("version").distinct().collect()
        return sorted(row["version"] for row in found)

    def manifest(self, version: int) -> DataFrame:
        """The newest manifest up to ``version``."""
        before = [v for v in self.versions() if v <= version]
        rows = self._manifests().where(F.col("version") == (before[-1] if before else 0))
        return rows.drop("version")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(name) for name in self.key]), F.lit(self.buckets)).cast("int")

    def _digest(self) -> list[Column]:
        """Number of rows and a sum of their hashes, which does not depend on their order."""
        row = F.xxhash64(F.to_json(F.struct(*self.schema.names)))
        return [F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("digest")]

    def _tree(self, leaves: DataFrame) -> DataFrame:
        """All levels of the manifest above ``leaves`` (node, held_by, n, digest)."""
        level = leaves.select(F.lit(0).alias("level"), "node", "held_by", "n", "digest")
        out, depth, width = level, 0, self.buckets
        while width > 1:
            depth, width = depth + 1, -(-width // FANOUT)
            mark = F.xxhash64("node", "n", "digest").cast("decimal(38,0)")
            level = level.groupBy(F.floor(F.col("node") / FANOUT).cast("bigint").alias("node")).agg(
                F.max("held_by").alias("held_by"), F.sum("n").alias("n"), F.sum(mark).alias("digest")
            )
            level = level.select(F.lit(depth).alias("level"), "node", "held_by", "n", "digest")
            out = out.unionByName(level)
        return out

    def changed_buckets(self, leaves: DataFrame, version: int) -> list[int]:
        """Buckets whose digest in ``leaves`` (node, n, digest) is not that of ``version``: from the root down.

        Only the children of nodes that differ are compared. At most ``MOST_BUCKETS`` numbers come back.
        """
        old = self.manifest(version)
        new = self._tree(leaves.withColumn("held_by", F.lit(0).cast("bigint")))
        level, width = 0, self.buckets
        while width > 1:
            level, width = level + 1, -(-width // FANOUT)
        open_: list[int] | None = None
        for depth in range(level, -1, -1):
            sides = []
            for side in (old, new):
                nodes = side.where(F.col("level") == depth)
                if open_ is not None:
                    nodes = nodes.where(F.floor(F.col("node") / FANOUT).isin(open_) if open_ else F.lit(False))
                sides.append(nodes.select("node", F.struct("n", "digest").alias("mark")))
            both = sides[0].join(sides[1].withColumnRenamed("mark", "new_mark"), "node", "full")
            open_ = [row["node"] for row in both.where("NOT mark <=> new_mark").select("node").collect()]
        return sorted(open_ or [])

    # Rows

    def _held(self, manifest: DataFrame, only: list[int] | None = None) -> DataFrame:
        """The stored rows of a manifest's buckets with ``bucket``; no other bucket's files are read."""
        wanted = manifest.where((F.col("level") == 0) & (F.col("n") > 0))
        if only is not None:
            wanted = wanted.where(F.col("node").isin(only)) if only else wanted.where(F.lit(False))
        places: dict[int, list[int]] = {}
        for row in wanted.select("held_by", "node").collect():
            places.setdefault(row["held_by"], []).append(row["node"])
        schema = StructType([*self.schema.fields]).add("bucket", IntegerType())
        if not places:
            return self.spark.createDataFrame([], schema)
        stored = self.spark.read.schema(StructType([*schema.fields]).add("version", LongType())).parquet(f"{self.path}/rows")
        inside = [(F.col("version") == v) & F.col("bucket").isin(nodes) for v, nodes in places.items()]
        return stored.where(reduce(lambda a, b: a | b, inside)).drop("version").select(*schema.names)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it is, or as it was in ``version``."""
        newest = (1 << 62) if version is None else version
        return self._held(self.manifest(newest)).drop("bucket")

    def _commit(self, rows: DataFrame, touched: list[int], version: int) -> None:
        """Write the new ``rows`` (with ``bucket``) of the touched buckets, then the manifest."""
        target = f"{self.path}/rows/version={version}"
        dealt = rows.repartition("bucket").sortWithinPartitions("bucket", *self.key)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(target)
        schema = StructType([*self.schema.fields]).add("bucket", IntegerType())
        fresh = self.spark.read.schema(schema).parquet(target).groupBy(F.col("bucket").cast("bigint").alias("node"))
        fresh = fresh.agg(*self._digest()).withColumn("held_by", F.lit(version).cast("bigint"))
        kept = self.manifest(version - 1).where("level = 0")
        kept = kept.where(~F.col("node").isin(touched)) if touched else kept
        leaves = kept.select("node", "held_by", "n", "digest").unionByName(fresh)
        self._write_manifest(self._tree(leaves), version)

    def upsert(self, rows: DataFrame, version: int, order: list[str]) -> None:
        """Insert or replace ``rows`` by key as ``version``; of one key the row with the greatest ``order`` stays.

        ``order`` are columns of the table, so a row older than the stored one changes nothing. Only buckets
        with new rows are read and written. Repeating a version, as a retried micro-batch does, gives the
        same table: it starts from the version before.
        """
        fresh = rows.select(*self.schema.names).where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.key]))
        fresh = latest_rows(fresh, self.key, order).withColumn("bucket", self._bucket())
        touched = sorted(row["bucket"] for row in fresh.select("bucket").distinct().collect())
        if not touched:
            return
        held = self._held(self.manifest(version - 1), touched)
        # The stored row wins against one that is equally old.
        both = fresh.withColumn("is_new", F.lit(0)).unionByName(held.withColumn("is_new", F.lit(1)))
        newest = latest_rows(both, [*self.key, "bucket"], [*order, "is_new"]).drop("is_new")
        self._commit(newest, touched, version)

    def capture(self, rows: DataFrame, version: int) -> DataFrame:
        """Make ``rows`` the table's ``version`` and return what changed against the version before.

        Changes are op (CREATE, UPDATE, DELETE), before and after (maps of text, null where there is none)
        and seq, the version. The whole of ``rows`` is read once for the digests; rows of buckets whose
        digest is the same are neither joined nor written, and their stored files are not read.
        Null and NaN compare as equal to themselves. Of rows that repeat a key one is taken: the last in
        order of all columns that can be ordered.
        """
        orders = [f.name for f in self.schema if f.dataType.typeName() not in ("map", "variant") and f.name not in self.key]
        fresh = rows.select(*self.schema.names).where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.key]))
        fresh = latest_rows(fresh, self.key, orders) if orders else fresh.dropDuplicates(self.key)
        fresh = fresh.withColumn("bucket", self._bucket())
        leaves = fresh.groupBy(F.col("bucket").cast("bigint").alias("node")).agg(*self._digest())
        touched = self.changed_buckets(leaves, version - 1)
        before = self._held(self.manifest(version - 1), touched)
        after = fresh.where(F.col("bucket").isin(touched) if touched else F.lit(False))

        def image(side: str) -> Column:
            texts = F.array(*[F.col(f"{side}.{name}").cast("string") for name in self.schema.names])
            names = F.array(*[F.lit(name) for name in self.schema.names])
            return F.when(F.col(side).isNotNull(), F.map_from_arrays(names, texts))

        def packed(rows: DataFrame, side: str) -> DataFrame:
            return rows.select(*self.key, F.struct(*self.schema.names).alias(side))

        both = packed(before, "old").join(packed(after, "new"), self.key, "full")
        differ = ~F.to_json("old").eqNullSafe(F.to_json("new"))
        op = F.when(F.col("old").isNull(), "CREATE").when(F.col("new").isNull(), "DELETE").otherwise("UPDATE")
        changed = both.where(differ).select(
            op.alias("op"), image("old").alias("before"), image("new").alias("after"), F.lit(version).cast("bigint").alias("seq")
        )
        target = f"{self.path}/changes/version={version}"
        changed.write.mode("overwrite").parquet(target)
        if touched:
            self._commit(after, touched, version)
        return self.spark.read.schema(changed.schema).parquet(target)


def upsert_writer(table: BucketTable, order: list[str], transform=None):
    """A ``foreachBatch`` function that upserts every micro-batch as a version of its own."""

    def write(rows: DataFrame, batch_id: int) -> None:
        table.upsert(transform(rows) if transform else rows, batch_id + 1, order)

    return write
