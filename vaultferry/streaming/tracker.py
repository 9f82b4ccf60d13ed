"""Status of every key of a change stream whose changes may arrive in any order.

The state of a key is what is settled (last status, number of changes and of illegal moves) and
the changes that are not: they wait in order of time until the watermark has passed them, as an
earlier one may still come. They are settled when the key has new rows, or by a timer at the newest
waiting change. Both are one value, read and written once for all rows that a micro-batch has of a
key, as each access to the state is a call from Python to the executor. Each micro-batch returns the
state of its keys as if the waiting changes were settled too, so the newest row of a key is
right as soon as all its changes are there, and the state stays as small as the watermark allows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vaultferry.schemas import STATUS_TRANSITIONS
from vaultferry.streaming.jobs import upsert_stream

STATUS = "key string, status string, changes bigint, illegal bigint"
STATE = (
    "status string, changes bigint, illegal bigint, "
    "waiting array<struct<micros: bigint, event: bigint, status: string>>"
)
Changes = list[tuple[int, int, str]]


class StatusTracker(StatefulProcessor):
    """One key's settled status and the changes that wait for the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """What an earlier run or a store knows of a key, in the columns of ``STATUS``."""
        known = (initialState.status, initialState.changes, initialState.illegal)
        self.state.update((*known, []))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        known, before = self._read()
        waiting = {c[:2]: c for c in before}
        for row in rows:
            # What the watermark has passed may be settled already: too late to be put in order.
            if row.micros // 1000 >= passed:
                waiting[row.micros, row.event] = (row.micros, row.event, row.status)
        ordered = sorted(waiting.values())
        if ordered and (not before or ordered[-1][0] // 1000 > before[-1][0] // 1000):
            self.handle.registerTimer(ordered[-1][0] // 1000)
        left = self._settle(known, ordered, passed - 1)
        status, changes, illegal = self._after(*left)
        yield Row(key=key[0], status=status, changes=changes, illegal=illegal)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Settle the changes the watermark has passed; the rows returned before hold."""
        known, waiting = self._read()
        if waiting:
            self._settle(known, waiting, expiredTimerInfo.getExpiryTimeInMs())
        return iter(())

    def _read(self) -> tuple[tuple, Changes]:
        """What is settled, and the waiting changes in their order."""
        state = self.state.get()
        if state is None:
            return (None, 0, 0), []
        return tuple(state[:3]), [tuple(c) for c in state[3]]

    def _settle(self, known: tuple, ordered: Changes, limit: int) -> tuple[tuple, Changes]:
        """Store the state with the changes up to a time settled; returns it."""
        n = sum(micros // 1000 <= limit for micros, _, _ in ordered)
        known, left = self._after(known, ordered[:n]), ordered[n:]
        self.state.update((*known, left))
        return known, left

    @staticmethod
    def _after(known: tuple, changes: Changes) -> tuple:
        """Status, changes and illegal moves once some more changes are applied."""
        status, count, illegal = known
        for _, _, after in changes:
            if status is not None and after not in STATUS_TRANSITIONS.get(status, ()):
                illegal += 1
            status, count = after, count + 1
        return status, count, illegal


def tracked(history: DataFrame, late: str, start: DataFrame | None = None) -> DataFrame:
    """Newest status rows of a stream of (key, status, at_utc, event_id).

    Changes later than ``late`` are left out, as by every operator with a watermark. ``start``
    holds rows like the result's to go on from.
    """
    rows = history.withWatermark("at_utc", late).select(
        "key",
        "status",
        "at_utc",
        F.unix_micros("at_utc").alias("micros"),
        F.col("event_id").cast("bigint").alias("event"),
    )
    known = None if start is None else start.select("key", "status", "changes", "illegal").groupBy("key")
    return rows.groupBy("key").transformWithState(
        StatusTracker(), STATUS, "Update", "EventTime", initialState=known
    )


def track_out_of_order(
    spark: SparkSession,
    history: DataFrame,
    path: str,
    checkpoint: str,
    late: str,
    start: DataFrame | None = None,
) -> DataFrame:
    """Drain a stream and return the status of every key it changed."""
    return upsert_stream(tracked(history, late, start), ["key"], path, checkpoint)
