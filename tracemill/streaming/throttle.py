"""Changes of documents handed on at most every so often for each (T11), by keyed state and timers."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Throttle(StatefulProcessor):
    """A document's due times: a change comes out at once if the last one did long enough ago, else when its time is up.

    State: when the last change came out, and the newest one that waits. Several changes that wait come out as the newest, so
    the last one is never lost. A timer lets a waiting change out when no other comes.
    """

    def __init__(self, every_ms: int, columns: list[str]):
        self.every, self.columns = every_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "out long, waiting long")

    def _row(self, key: tuple, changed: int, out: int) -> tuple:
        return (key[0], changed, out)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, waiting = self.held.get() if self.held.exists() else (None, None)
        before = None if waiting is None else out + self.every
        for frame in rows:
            given = []
            for t in sorted(frame["t"].astype("int64").tolist()):
                if waiting is not None and t > out + self.every:
                    out += self.every
                    given.append(self._row(key, waiting, out))
                    waiting = None
                if out is None or t >= out + self.every:
                    given.append(self._row(key, t, t))
                    out, waiting = t, None
                elif t > max(waiting or 0, out):
                    waiting = t
            if given:
                yield pd.DataFrame(given, columns=self.columns)
        due = None if waiting is None else out + self.every
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)
        if out is not None:
            self.held.update((out, waiting))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, waiting = self.held.get()
        if waiting is not None and out + self.every == expiredTimerInfo.getExpiryTimeInMs():
            self.held.update((out + self.every, None))
            yield pd.DataFrame([self._row(key, waiting, out + self.every)], columns=self.columns)

    def close(self) -> None:
        pass


def throttled(changes: DataFrame, key: str, t: str, seconds: int = 30, late: str = "0 seconds") -> DataFrame:
    """(key, changed_ms, out_ms) of a stream of changes (key, t timestamp): what is to be indexed again, and when.

    A new document comes out at once, one that has changed at most every so many seconds, always with its newest change. The clock
    is event time: a change that waits comes out when the watermark passes its time. Changes must come in order of t within
    ``late``. A document's state is two numbers. To be written in append mode, started within ``keyed_state``.
    """
    kind = dict(changes.dtypes)[key]
    rows = changes.withWatermark(t, late).select(F.col(key), F.col(t).alias("_at"), F.unix_millis(t).alias("t"))
    names = [key, "changed_ms", "out_ms"]
    return rows.groupBy(key).transformWithStateInPandas(Throttle(seconds * 1000, names), f"{key} {kind}, changed_ms long, out_ms long", "Append", "EventTime")
