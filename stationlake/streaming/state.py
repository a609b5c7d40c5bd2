"""Alerts of runs as keyed state: a batch touches the series it brings rows for, or whose time has come, and no other."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps many small values for each key; a session that runs these jobs needs it.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

_DAY = 86_400_000_000


class Runs(StatefulProcessor):
    """Rows of one series wait, by day, until the watermark has passed them; then they are judged in order.

    State: ``waiting`` (a day's rows that are not judged yet), ``run`` (rows in a
    row at or above the level, and the time of the first) and ``due``, where the
    one timer of the series stands: at its earliest waiting row. A batch opens
    only series with rows or a timer, and of those only what waits. Times are
    microseconds since the epoch, so no worker's zone matters.
    """

    def __init__(self, level: float, length: int, names: Sequence[str]):
        self.level, self.length = level, length
        self.row = Row(*names, "run_start", "alert_time")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day long", "rows array<struct<time: long, value: double>>")
        self.run = handle.getValueState("run", "n int, start long")
        self.due = handle.getValueState("due", "millis long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        fresh: dict[int, list] = {}
        for row in rows:
            fresh.setdefault(row["micros"] // _DAY, []).append((row["micros"], row["value"]))
        for day, listed in fresh.items():
            if self.waiting.containsKey((day,)):
                listed = [*map(tuple, self.waiting.getValue((day,))[0]), *listed]
            self.waiting.updateValue((day,), (listed,))
        if fresh:
            self._wake(_millis(min(t for listed in fresh.values() for t, _ in listed)))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        self.due.clear()
        ready, earliest = [], None
        for (day,), (listed,) in list(self.waiting.iterator()):
            rows = [*map(tuple, listed)]
            later = [r for r in rows if _millis(r[0]) > passed]
            ready += [r for r in rows if _millis(r[0]) <= passed]
            if not later:
                self.waiting.removeKey((day,))
            elif len(later) < len(rows):
                self.waiting.updateValue((day,), (later,))
            earliest = min([t for t, _ in later] + ([] if earliest is None else [earliest]), default=None)
        if earliest is not None:
            self._wake(_millis(earliest))
        n, start = self.run.get() or (0, None)
        found = []
        # Of rows of one time, those that interrupt a run come first.
        for time, value in sorted(ready, key=lambda r: (r[0], r[1] is not None and r[1] >= self.level)):
            if value is None or value < self.level:
                n, start = 0, None
                continue
            n, start = n + 1, time if start is None else start
            if n == self.length:
                found.append(self.row(*key, start, time))
        self.run.update((min(n, self.length + 1), start))
        return iter(found)

    def _wake(self, millis: int) -> None:
        """Let the timer stand at ``millis`` if it does not stand earlier."""
        if self.due.exists():
            if self.due.get()[0] <= millis:
                return
            self.handle.deleteTimer(self.due.get()[0])
        self.handle.registerTimer(millis)
        self.due.update((millis,))

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    """Milliseconds, rounded up, so that a timer never fires before its row is due."""
    return -(-micros // 1000)


def run_alerts(
    stream: DataFrame, level: float, length: int = 3, late: str = "1 day", keys: Sequence[str] = ("city", "pollen_type")
) -> DataFrame:
    """One row per run of ``length`` rows in a row at or above the level, per series: ``run_start`` and ``alert_time``.

    ``stream`` has the keys, ``time`` and ``value``. Rows are judged in order of
    time once the newest time seen is ``late`` ahead, so the result does not
    depend on how they fall into batches. The engine leaves out and counts rows
    that come later than that (``numRowsDroppedByWatermark``). The session runs
    in UTC with the settings in ``STORE``.
    """
    names = list(keys)
    rows = stream.select(
        *[F.col(k).cast("string").alias(k) for k in names], F.col("time").cast("timestamp").alias("time"), F.col("value").cast("double").alias("value")
    ).filter(F.col("time").isNotNull()).withColumn("micros", F.unix_micros("time"))
    found = T.StructType([T.StructField(k, T.StringType()) for k in names] + [T.StructField(c, T.LongType()) for c in ("run_start", "alert_time")])
    alerts = (
        rows.withWatermark("time", late)
        .groupBy(*names)
        .transformWithState(statefulProcessor=Runs(level, length, names), outputStructType=found, outputMode="Append", timeMode="EventTime")
    )
    return alerts.select(*names, *[F.timestamp_micros(c).cast("timestamp_ntz").alias(c) for c in ("run_start", "alert_time")])
