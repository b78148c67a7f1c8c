"""Inner join of two streams within a band of time, a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import BatchWriter

SIDES = ["left", "right"]
MARKS = "left bigint, right bigint, watermark bigint"


@dataclass
class Side:
    """One side of a join: the time of its rows, how far after it a partner's time can lie, how late rows may come.

    ``reach`` is the upper bound of the band for the left side, the lower one with its sign turned for the right.
    """

    time: Column
    reach: str
    delay: str = "0 seconds"


def both_sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two streams as one: every row is the struct of its side, that of the other is null."""
    lefts = left.select(F.struct("*").alias("left"), F.lit(None).cast(right.schema).alias("right"))
    rights = right.select(F.lit(None).cast(left.schema).alias("left"), F.struct("*").alias("right"))
    return lefts.unionByName(rights)


class PendingJoin:
    """Joins the rows of ``both_sides`` by ``join(left, right)``, whose pairs must lie within the sides' reach.

    A micro-batch joins its rows to each other and to those of earlier ones that may still find a partner, which
    wait in a table at ``path``. The watermark is that of Spark's join of two streams: the least of the sides'
    latest times less their delays, as of the micro-batch before. Rows that are not later are dropped, as there,
    where it may take one more micro-batch until they are; a row waits as long as one in its reach would not be
    dropped. Every micro-batch has its own version of the table and the marks, so one that is repeated gives the
    same rows.

    Spark's join puts every row into a state store and takes it out again. Here a micro-batch is shuffled as a
    whole, only rows at its end are stored, and adaptive execution splits a key with very many rows.
    """

    def __init__(self, path: str, left: Side, right: Side, join: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        self.path, self.join = path, join
        self.sides = dict(zip(SIDES, (left, right)))

    def writer(self, write: BatchWriter) -> BatchWriter:
        """A ``foreachBatch`` function that gives the pairs of every micro-batch to ``write``."""

        def write_pairs(rows: DataFrame, batch_id: int) -> None:
            held, marks = self._held(rows, batch_id - 1)
            in_time = F.col("time") > F.timestamp_millis(F.lit(marks["watermark"]))
            left, right = (self._timed(rows, name).where(in_time).select(f"{name}.*") for name in SIDES)
            if held is None:
                pairs = self.join(left, right)
            else:
                held_left, held_right = (self._timed(held, name).select(f"{name}.*") for name in SIDES)
                pairs = self.join(left.unionByName(held_left), right).unionByName(self.join(left, held_right))
            write(pairs, batch_id)
            self._hold(rows, held, marks, batch_id)

        return write_pairs

    def _timed(self, rows: DataFrame, name: str) -> DataFrame:
        """The rows of one side with their time; those without one find no partner and are left out."""
        own = rows.where(F.col(name).isNotNull()).select(f"{name}.*", F.struct(*SIDES).alias("row"))
        return own.select(self.sides[name].time.alias("time"), "row.*").where(F.col("time").isNotNull())

    def _held(self, rows: DataFrame, batch_id: int) -> tuple[DataFrame | None, dict[str, int]]:
        """What waits after a micro-batch and its marks: the latest times less their delays, and the watermark."""
        if batch_id < 0:
            return None, {"left": 0, "right": 0, "watermark": 0}
        read = rows.sparkSession.read
        marks = read.schema(MARKS).parquet(f"{self.path}/marks/batch_id={batch_id}").first().asDict()
        return read.schema(rows.schema).parquet(f"{self.path}/rows/batch_id={batch_id}"), marks

    def _hold(self, rows: DataFrame, held: DataFrame | None, marks: dict[str, int], batch_id: int) -> None:
        """Store the marks after this micro-batch and the rows that may still find a partner."""
        latest = []
        for name, side in self.sides.items():
            mark = F.unix_millis(F.max("time") - F.expr(f"INTERVAL '{side.delay}'"))
            latest.append(self._timed(rows, name).agg(mark.alias("mark")).select(F.lit(name).alias("side"), "mark"))
        found = {row["side"]: row["mark"] for row in latest[0].unionByName(latest[1]).collect()}
        after = {name: max(marks[name], found[name] or 0) for name in SIDES}
        after["watermark"] = max(marks["watermark"], min(after.values()))

        in_time = F.col("time") > F.timestamp_millis(F.lit(marks["watermark"]))
        passed = F.timestamp_millis(F.lit(after["watermark"]))
        waiting = []
        for name, side in self.sides.items():
            own = self._timed(rows, name).where(in_time)
            own = own if held is None else own.unionByName(self._timed(held, name))
            waiting.append(own.where(F.col("time") + F.expr(f"INTERVAL '{side.reach}'") > passed).select(*SIDES))
        waiting[0].unionByName(waiting[1]).write.mode("overwrite").parquet(f"{self.path}/rows/batch_id={batch_id}")
        values = [F.lit(after[name]).cast("bigint").alias(name) for name in [*SIDES, "watermark"]]
        stored = rows.sparkSession.range(0, 1, 1, 1).select(*values)
        stored.write.mode("overwrite").parquet(f"{self.path}/marks/batch_id={batch_id}")
