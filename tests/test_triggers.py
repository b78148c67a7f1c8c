import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.plans.replay import FAR
from tidemark.streaming import jobs, triggers

SCHEMA = "id string, vc decimal(18,2), rt timestamp, event_id bigint"
UTC = datetime.timezone.utc
# Times in the tests count from here.
BASE = 1_700_000_000_000


def reading(sensor, vc, ms, event_id=0):
    at = None if ms is None else datetime.datetime.fromtimestamp((BASE + ms) / 1000, UTC)
    return (sensor, None if vc is None else Decimal(vc), at, event_id)


def brute(batches, window, every, keep):
    """The rules one event after another: time moves to the newest row after each batch."""
    state, out, now, was = {}, [], None, None
    for rows in [*batches, []]:
        for key, s in list(state.items()):
            end = key[1] + window
            if now is None or now < end:
                continue
            passed = (min(now, end + keep - 1) - end) // every > (max(was, end) - end) // every if s["ended"] else True
            if passed and (not s["ended"] or was < end + keep):
                s["n"] += 1
                out.append((*key, s["n"], "timer" if s["ended"] else "end", s["ct"], s["sum"]))
            s["ended"] = True
            if now >= end + keep:
                del state[key]
        for sensor, vc, ms, _ in sorted(rows, key=lambda row: (row[2], row[3])):
            if now is not None and ms <= now - keep:
                continue
            s = state.setdefault((sensor, ms // window * window), {"n": 0, "ct": 0, "sum": Decimal(0), "ended": False})
            s["ct"], s["sum"] = s["ct"] + 1, s["sum"] + Decimal(vc)
            if now is not None and ms // window * window + window <= now:
                s["n"], s["ended"] = s["n"] + 1, True
                out.append((sensor, ms // window * window, s["n"], "late", s["ct"], s["sum"]))
        was = now if now is not None else -1
        now = max([now or 0, *[row[2] for row in rows]]) if rows else now
    return sorted(out)


def fire(spark, scratch, stream_of, batches, **options):
    frames = [spark.createDataFrame([reading(*row) for row in rows], SCHEMA) for rows in batches]
    path = scratch("fired")
    fired = triggers.repeated_totals(stream_of(*frames), "event_id", **options)
    jobs.run_to_table(fired, path, scratch("fired-checkpoint"))
    rows = spark.read.parquet(path).withColumn("start", F.unix_millis("stt") - BASE).collect()
    return sorted((r["id"], r["start"], r["firing"], r["kind"], r["ct"], r["vc"]) for r in rows)


def test_end_timer_and_late_rows(spark, scratch, stream_of):
    batches = [
        [("a", "1.50", 1_000, 1), ("a", "2.00", 4_000, 2), ("b", "7.00", 2_000, 3)],
        [("c", "0.00", 5_500, 4)],
        # The first window has ended at 5.5 s: these two are late and fire one by one, in order of time.
        [("a", "1.00", 3_000, 6), ("a", "0.25", 2_500, 5), ("c", "0.00", 8_000, 7)],
        [("c", "0.00", 8_100, 8)],
    ]
    found = fire(spark, scratch, stream_of, batches, window_ms=5_000, every_ms=2_000, keep_ms=20_000)
    first = [row for row in found if row[0] == "a"]
    assert first == [
        ("a", 0, 1, "end", 2, Decimal("3.50")),
        ("a", 0, 2, "late", 3, Decimal("3.75")),
        ("a", 0, 3, "late", 4, Decimal("4.75")),
        ("a", 0, 4, "timer", 4, Decimal("4.75")),
    ]
    assert [row[2:4] for row in found if row[0] == "b"] == [(1, "end"), (2, "timer")]


def test_rows_after_the_state_has_gone_and_odd_rows(spark, scratch, stream_of):
    batches = [
        [("a", "1.00", 1_000, 1)],
        [("x", "0.00", 40_000, 2)],
        [("a", "9.00", 1_500, 3), ("x", "0.00", 40_500, 4)],
    ]
    found = fire(spark, scratch, stream_of, batches, window_ms=5_000, every_ms=2_000, keep_ms=20_000)
    assert [row for row in found if row[0] == "a"] == [("a", 0, 1, "end", 1, Decimal("1.00"))]
    odd = [[(None, "1.00", 1_000, 1), ("a", "1.00", None, 2), ("a", None, 1_000, 3)], [("x", "0.00", 9_000, 4)]]
    found = fire(spark, scratch, stream_of, odd, window_ms=5_000, every_ms=2_000, keep_ms=20_000)
    assert found[0] == ("a", 0, 1, "end", 1, Decimal("0.00"))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_one_event_after_another(spark, scratch, stream_of, seed):
    rng = random.Random(seed)
    batches, event_id = [], 0
    for b in range(7):
        rows = []
        for _ in range(rng.randrange(1, 9)):
            event_id += 1
            rows.append((rng.choice("ab"), f"{rng.randrange(500) / 100:.2f}", max(0, b * 6_000 + rng.randrange(-25_000, 5_000)), event_id))
        batches.append(rows)
    batches.append([("z", "0.00", int(FAR.timestamp() * 1000) - BASE, 999)])
    wanted = [row for row in brute(batches, 5_000, 2_000, 20_000) if row[0] != "z"]
    found = fire(spark, scratch, stream_of, batches, window_ms=5_000, every_ms=2_000, keep_ms=20_000)
    assert [row for row in found if row[0] != "z"] == wanted
    assert {row[3] for row in wanted} == {"end", "timer", "late"}
