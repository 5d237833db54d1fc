"""Brute-force alerts with keyed state that changes by the second.

State of an IP is a map second -> failures and one value (newest second,
whether it has alerted); a micro-batch touches the seconds that it brings, and
the rest stay as they are in the state store. An IP that hasn't alerted holds
fewer failures than the threshold in any window, so its map has fewer seconds
than the threshold; one that has alerted needs no counts, and its map is
dropped. An event-time timer forgets an IP that was quiet for a whole window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.fixed_values import AUTH_FAILURE_STATUSES
from .live import ALERT_SCHEMA, PER_SECOND_SCHEMA, _per_second

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def combined(batches) -> dict[int, tuple]:
    """second -> (failures, first timestamp, has a path, path) of an IP's rows:
    the least (timestamp, path) with no path before any."""
    found: dict[int, tuple] = {}
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            has = isinstance(row.path, str)
            mine = (row.first, has, row.path if has else "")
            n, *least = found.get(int(row.ts_epoch), (0, *mine))
            found[int(row.ts_epoch)] = (n + int(row.n), *min(tuple(least), mine))
    return found


def first_alert(counts: dict[int, int], new: list[int], window: int, threshold: int) -> tuple[int, int] | None:
    """(second, failures) of the first of the sorted ``new`` seconds whose closed
    interval [second - window, second] holds ``threshold`` failures."""
    seconds = np.array(sorted(counts), dtype=np.int64)
    total = np.concatenate([[0], np.cumsum([counts[s] for s in seconds])])
    for second in new:
        n = int(total[np.searchsorted(seconds, second, side="right")] - total[np.searchsorted(seconds, second - window, side="left")])
        if n >= threshold:
            return second, n
    return None


class AlertProcessor(StatefulProcessor):
    def __init__(self, window: int, threshold: int, window_minutes: int):
        self.window, self.threshold, self.window_minutes = window, threshold, window_minutes

    def init(self, handle) -> None:
        self.handle = handle
        self.seconds = handle.getMapState("seconds", "sec long", "n long")
        self.known = handle.getValueState("known", "newest long, alerted boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - Spark's names
        new = combined(rows)
        if not new:
            return
        newest, alerted = self.known.get() if self.known.exists() else (min(new), False)
        newest = max(newest, max(new))
        if not alerted:
            counts = {sec: n for (sec,), (n,) in self.seconds.iterator()}
            for sec, (n, *_) in new.items():
                counts[sec] = counts.get(sec, 0) + n
            hit = first_alert(counts, sorted(new), self.window, self.threshold)
            if hit:
                alerted = True
                self.seconds.clear()
                second, n = hit
                _, first, has, path = new[second]
                yield pd.DataFrame({"ip": [key[0]], "window_end": [first], "failures_in_window": [n],
                                    "example_path": [path if has else None], "window_minutes": [self.window_minutes]})
            else:
                for sec, n in counts.items():
                    if sec < newest - self.window:  # no later window reaches it
                        if self.seconds.containsKey((sec,)):
                            self.seconds.removeKey((sec,))
                    elif sec in new:
                        self.seconds.updateValue((sec,), (n,))
        self.known.update((newest, alerted))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        quiet = (newest + self.window) * 1000 + 1  # late rows can make it lie before the watermark
        self.handle.registerTimer(max(quiet, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803 - Spark's names
        self.seconds.clear()
        self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_alerts(parsed: DataFrame, window_minutes: int = 5, threshold: int = 20, watermark: str = "10 minutes") -> DataFrame:
    """``stream_brute_force``'s alerts by keyed state; the session's state store
    must be RocksDB (``PROVIDER`` set to ``ROCKSDB``), which keeps state out of
    the JVM heap and writes only what changed.

    For in-order input the alerts equal the batch ``brute_force``; late rows
    within the watermark count when they arrive, as long as their second lies
    no more than a window before the IP's newest.
    """
    if parsed.sparkSession.conf.get(PROVIDER, "") != ROCKSDB:
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}")
    window = int(window_minutes) * 60
    fails = (parsed.where(F.col("status").isin(*AUTH_FAILURE_STATUSES) & F.col("ip").isNotNull() & F.col("timestamp").isNotNull())
             .select("ip", "timestamp", "path", F.unix_seconds("timestamp").alias("ts_epoch"))
             .mapInPandas(_per_second, PER_SECOND_SCHEMA)
             .withWatermark("timestamp", watermark))
    processor = AlertProcessor(window, int(threshold), int(window_minutes))
    return fails.groupBy("ip").transformWithStateInPandas(processor, outputStructType=ALERT_SCHEMA, outputMode="append",
                                                          timeMode="eventTime")
