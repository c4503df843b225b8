"""A stream put in order within a bounded window, by keyed state and event-time timers.

Rows are held by key until the watermark has passed them, and then come out in order with a running number. One timer a key
stands at its earliest held row. Rows, the numbers given out and timers are state, so a restart from the checkpoint goes on where it was. What
comes later than the window allows is dropped by the watermark and counted in the query's progress.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MILLIS, NUMBER = "_millis", "number"


class Reorder(StatefulProcessor):
    """Rows of one key, held until they are due. ``tie`` orders rows of one time."""

    def __init__(self, schema: StructType, tie: list[str]):
        self.held_schema, self.tie = schema, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.held_schema)
        self.given = handle.getValueState("given", "n long")
        self.due = handle.getValueState("due", "at long")

    def _wait(self, at: int | None) -> None:
        """The key's one timer stands at ``at``."""
        before = self.due.get()[0] if self.due.exists() else None
        if before == at:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if at is None:
            self.due.clear()
        else:
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        earliest = self.due.get()[0] if self.due.exists() else None
        for row in rows:
            self.held.appendValue(tuple(row))
            earliest = row[MILLIS] if earliest is None else min(earliest, row[MILLIS])
        self._wait(earliest)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs()
        names = self.held_schema.names
        at, ties = names.index(MILLIS), [names.index(c) for c in self.tie]
        rows = [tuple(r) for r in self.held.get()]
        ready = sorted((r for r in rows if r[at] <= until), key=lambda r: (r[at], *[(r[k] is not None, r[k]) for k in ties]))
        rest = [r for r in rows if r[at] > until]
        if rest:
            self.held.put(rest)
        else:
            self.held.clear()
        self.due.clear()  # this timer is gone
        self._wait(min((r[at] for r in rest), default=None))
        n = self.given.get()[0] if self.given.exists() else 0
        self.given.update((n + len(ready),))
        numbered = Row(*names, NUMBER)
        for k, r in enumerate(ready):
            yield numbered(*r, n + k)

    def close(self) -> None:
        pass


def reordered(stream: DataFrame, key: list[str], time: str, window: str, tie: list[str] | None = None) -> DataFrame:
    """The stream's rows with ``number``, gapless from 0 within ``key`` in order of (time, tie); each comes out once no row up to its time can follow within ``window``.

    A key's rows of one window are held by one task. Rows without a time or a key don't come out. State lies in the store that timers need, which is set for the session.
    """
    spark = stream.sparkSession
    spark.conf.set(STORE, ROCKS)
    rows = stream.where(" and ".join(f"`{c}` is not null" for c in [*key, time])).withColumn(MILLIS, F.unix_millis(F.col(time).cast("timestamp_ltz")))
    rows = rows.withColumn("_time", F.col(time).cast("timestamp_ltz")).withWatermark("_time", window)
    held = StructType([f for f in rows.schema if f.name != "_time"])
    inner = rows.select("_time", *held.names)
    out = StructType([*held.fields, StructField(NUMBER, LongType())])
    processor = Reorder(StructType([*[StructField("_time", rows.schema["_time"].dataType)], *held.fields]), tie or [])
    full = StructType([StructField("_time", rows.schema["_time"].dataType), *out.fields])
    return inner.groupBy(*key).transformWithState(processor, full, "append", "eventTime").drop("_time", MILLIS)


def late_rows(query: StreamingQuery) -> int:
    """How many rows came too late, by what the query's recent progress says."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
