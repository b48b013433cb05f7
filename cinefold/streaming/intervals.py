"""Intervals between opening and closing actions of a log, from a table or from a stream in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State is kept in a store that has lists and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _phase(opens: dict[str, str]) -> Column:
    """The phase that an action opens; null for others."""
    return F.coalesce(*[F.when(F.col("action") == a, F.lit(p)) for a, p in opens.items()], F.lit(None).cast("string"))


def between(log: DataFrame, opens: dict[str, str], closes: list[str]) -> DataFrame:
    """(key, phase, opened, closed) of (key, id, ts, action): an interval for each opening action, up to the key's next opening or closing one.

    Events stand in the order of ts, then id; other actions and those without a time or key don't count. What is still open gives no row.
    """
    told = log.where(F.col("action").isin(*opens, *closes) & F.col("ts").isNotNull() & F.col("key").isNotNull())
    ahead = F.lead("ts").over(W.partitionBy("key").orderBy("ts", "id"))
    return told.select("key", _phase(opens).alias("phase"), F.col("ts").alias("opened"), ahead.alias("closed")).where("phase is not null and closed is not null")


class _Pairing(StatefulProcessor):
    """Keeps a key's events until the watermark has passed them, then pairs them in order; one timer a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, phase string")
        self.open = handle.getValueState("open", "at long, phase string")
        self.timer = handle.getValueState("timer", "ms long")

    def _wake(self, at: int | None) -> None:
        """Sets the key's timer to the first millisecond after its earliest event."""
        ms = None if at is None else at // 1000 + 1
        if self.timer.exists():
            old = self.timer.get()[0]
            if old == ms:
                return
            self.handle.deleteTimer(old)
            self.timer.clear()
        if ms is not None:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for batch in rows:
            events = [(int(a), int(i), None if pd.isna(p) else p) for a, i, p in zip(batch["at"], batch["id"], batch["phase"], strict=True)]
            self.waiting.appendList(events)
            first = min([e[0] for e in events] + ([] if first is None else [first]))
        if first is not None and (not self.timer.exists() or first // 1000 + 1 < self.timer.get()[0]):
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.timer.clear()  # the timer itself is gone
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(self.waiting.get(), key=lambda e: (e[0], e[1]))
        ready, later = [e for e in events if e[0] < passed], [tuple(e) for e in events if e[0] >= passed]
        now, out = tuple(self.open.get()) if self.open.exists() else None, []
        for at, _, phase in ready:
            if now is not None:
                out.append((key[0], now[1], now[0], at))
            now = None if phase is None else (at, phase)
        self.open.clear() if now is None else self.open.update(now)
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self._wake(later[0][0])
        if out:
            yield pd.DataFrame(out, columns=["key", "phase", "opened", "closed"], dtype=object).astype({"opened": "int64", "closed": "int64"})

    def close(self) -> None:
        pass


def streamed(log: DataFrame, opens: dict[str, str], closes: list[str], late: str = "1 hour") -> DataFrame:
    """``between`` for a stream: each interval once the watermark, ``late`` behind the latest event, has passed its end.

    Events may come in any order within that time; those that come later still are dropped. A key's state is its events that
    the watermark hasn't passed and the interval that is open. The session's state store must be ``STORE``.
    """
    told = log.where(F.col("action").isin(*opens, *closes) & F.col("ts").isNotNull() & F.col("key").isNotNull())
    events = told.withColumn("ts", F.col("ts").cast("timestamp_ltz")).withWatermark("ts", late)
    events = events.select("key", "ts", "id", F.unix_micros("ts").alias("at"), _phase(opens).alias("phase"))
    schema = f"key {dict(log.dtypes)['key']}, phase string, opened long, closed long"
    found = events.groupBy("key").transformWithStateInPandas(_Pairing(), schema, "Append", "eventTime")
    return found.select("key", "phase", F.timestamp_micros("opened").alias("opened"), F.timestamp_micros("closed").alias("closed"))
