"""Windows that fire again and again."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.processors import GROUPS, key_group

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW_STATE = "id string, total bigint, ct bigint, firings int, ended boolean, due bigint"
FIRED_SCHEMA = "id string, stt bigint, firing int, kind string, ct bigint, total bigint"
AT_END, BY_TIMER, FOR_LATE_ROW = "end", "timer", "late"


class RepeatedFiring(StatefulProcessor):
    """Per key and window, a running total that is put out again and again; state is held per group of keys and window.

    It fires when event time passes the window's end, then once in every period in which event time moves
    on, and at once for every late row. ``keep_ms`` after the end the state goes. Event time is here the
    watermark plus ``keep_ms``, so that Spark lets late rows through; those the watermark has passed are
    left out here, as Spark compares with the watermark of the micro-batch before. What is due fires
    before the rows of a micro-batch are added, so it does not matter whether Spark runs a batch without
    rows in between.
    """

    def __init__(self, window_ms: int, every_ms: int, keep_ms: int) -> None:
        self.window_ms, self.every_ms, self.keep_ms = window_ms, every_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("windows", WINDOW_STATE)

    def _now(self, timerValues) -> int:
        """Event time; long ago as long as Spark knows none."""
        watermark = timerValues.getCurrentWatermarkInMs()
        return watermark + self.keep_ms if watermark > 0 else -(1 << 62)

    def _fire_due(self, start: int, held: tuple, now: int) -> tuple[tuple | None, list[tuple]]:
        """The state after event time ``now`` (None once it has expired) and what fires for it."""
        total, ct, firings, ended, due = held
        end = start + self.window_ms
        if now < end:
            return held, []
        fired = []
        if not ended or (due <= now and due < end + self.keep_ms):
            firings += 1
            fired.append((firings, BY_TIMER if ended else AT_END, ct, total))
        if now >= end + self.keep_ms:
            return None, fired
        return (total, ct, firings, True, end + self.every_ms * ((now - end) // self.every_ms + 1)), fired

    def _store(self, start: int, before: dict, states: dict) -> None:
        """Keep the states and one timer, for what is due next."""
        if before == states:
            return
        if before:
            self.handle.deleteTimer(self._timer(start, before))
        self.state.clear()
        if states:
            self.state.appendList([(name, *state) for name, state in states.items()])
            self.handle.registerTimer(self._timer(start, states))

    def _timer(self, start: int, states: dict) -> int:
        end = start + self.window_ms
        due = min(min(state[4], end + self.keep_ms) if state[3] else end for state in states.values())
        return due - self.keep_ms + 1

    def _frame(self, start: int, fired: list[tuple]) -> Iterator[pd.DataFrame]:
        if fired:
            rows = [(one[0], start, *one[1:]) for one in fired]
            yield pd.DataFrame(rows, columns=["id", "stt", "firing", "kind", "ct", "total"])

    def _due(self, start: int, before: dict, now: int) -> tuple[dict, list[tuple]]:
        """What is left of the states after event time ``now``, and what fires for it."""
        states, fired = {}, []
        for name, held in before.items():
            state, out = self._fire_due(start, held, now)
            fired += [(name, *one) for one in out]
            if state is not None:
                states[name] = state
        return states, fired

    def _held(self) -> dict:
        return {held[0]: tuple(held[1:]) for held in self.state.get()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, start = self._now(timerValues), int(key[1])
        before = self._held()
        states, fired = self._due(start, before, now)
        end = start + self.window_ms
        late = end <= now
        # Rows that are not late only add up, so they need no order and are not held.
        parts = (batch[batch["ts"] > now - self.keep_ms] for batch in rows)
        if late:
            parts = [pd.concat(list(parts)).sort_values(["ts", "tie"], kind="stable")]
        for part in parts:
            for name, amount in zip(part["id"].tolist(), part["amount"].tolist()):
                total, ct, firings, ended, due = states.get(name) or (0, 0, 0, False, 0)
                total, ct = total + int(amount), ct + 1
                if late:
                    firings, ended = firings + 1, True
                    fired.append((name, firings, FOR_LATE_ROW, ct, total))
                    due = end + self.every_ms * ((now - end) // self.every_ms + 1)
                states[name] = (total, ct, firings, ended, due)
        self._store(start, before, states)
        yield from self._frame(start, fired)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before, start = self._held(), int(key[1])
        states, fired = self._due(start, before, self._now(timerValues))
        self._store(start, before, states)
        yield from self._frame(start, fired)

    def close(self) -> None:
        pass


def repeated_totals(
    readings: DataFrame,
    tie: str,
    window_ms: int = 5_000,
    every_ms: int = 2_000,
    keep_ms: int = 20_000,
    delay_ms: int = 0,
    groups: int = GROUPS,
) -> DataFrame:
    """Every firing of the sum of ``vc`` per sensor and window: id, stt, edt, firing, kind, ct, vc.

    ``readings`` is a stream of id, vc (a decimal with two places) and ``rt``. ``firing`` counts a window's
    firings from 1. A window fires when event time, which lags ``delay_ms`` behind the newest row, passes
    its end (``end``), afterwards on a timer every ``every_ms`` of event time (``timer``; periods passed at
    once fire once), and for each row that comes after the end (``late``, in order of time and ``tie``) up
    to ``keep_ms`` after it. A window first seen by a late row has no ``end``. Null amounts add nothing;
    rows without an id or a time are left out. State is held per group of sensors (``groups``) and
    window, so a busy sensor is spread over its windows.
    """
    ms = F.unix_millis("rt")
    amount = F.coalesce((F.col("vc") * 100).cast("bigint"), F.lit(0).cast("bigint"))
    thin = (
        readings.where(F.col("id").isNotNull() & F.col("rt").isNotNull())
        .withWatermark("rt", f"{delay_ms + keep_ms} milliseconds")
        .select(
            "id",
            (F.floor(ms / F.lit(window_ms)) * window_ms).alias("start"),
            ms.alias("ts"),
            F.col(tie).cast("bigint").alias("tie"),
            amount.alias("amount"),
            "rt",
        )
    )
    fired = thin.withColumn("key_group", key_group("id", groups)).groupBy("key_group", "start").transformWithStateInPandas(
        statefulProcessor=RepeatedFiring(window_ms, every_ms, keep_ms),
        outputStructType=FIRED_SCHEMA,
        outputMode="Append",
        timeMode="eventTime",
    )
    return fired.select(
        "id",
        F.timestamp_millis("stt").alias("stt"),
        F.timestamp_millis(F.col("stt") + window_ms).alias("edt"),
        "firing",
        "kind",
        "ct",
        (F.col("total") / 100).cast("decimal(28,2)").alias("vc"),
    )
