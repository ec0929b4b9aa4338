"""Messages held in the state store until they are due.

A message that isn't due yet waits under its item's key with a timer for its time, so nothing is written again
while it waits, and a restarted query still has both. Timers run on the clock of the micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textloom.schemas import MESSAGE

_NAMES = [f.name for f in MESSAGE.fields]


class Holder(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", MESSAGE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for r in rows:
            if r.not_before is None or r.not_before <= now:
                yield Row(**r.asDict())
            else:
                self.held.appendValue(tuple(r[c] for c in _NAMES))
                self.handle.registerTimer(r.not_before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        at = _NAMES.index("not_before")
        waiting = [tuple(m) for m in self.held.get()]
        left = [m for m in waiting if m[at] > now]
        if left:
            self.held.put(left)
        else:
            self.held.clear()
        for m in waiting:
            if m[at] <= now:
                yield Row(**dict(zip(_NAMES, m, strict=True)))


def hold(messages: DataFrame) -> DataFrame:
    """A stream of MESSAGE rows, each passed on when not_before is past, or at once if it is null."""
    return messages.select(*_NAMES).groupBy("itemId").transformWithState(statefulProcessor=Holder(), outputStructType=MESSAGE, outputMode="Append", timeMode="ProcessingTime")
