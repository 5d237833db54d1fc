"""Structured Streaming versions of ingest, hourly traffic and brute-force alerts.

The reference has no streaming operator (live tailing is only on its
roadmap); these reuse the batch expressions unchanged on ``readStream``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.fixed_values import AUTH_FAILURE_STATUSES
from ..sources.access_view import BASE_COLUMNS
from ..sources.raw_log import ParseMetrics, parse_lines

ALERT_SCHEMA = ("ip string, window_end timestamp, failures_in_window long, "
                "example_path string, window_minutes int")
#: IPs share the state of so many buckets: a call for each IP costs milliseconds.
BUCKETS = 4096
#: Of a bucket: its IPs, the time (ms) each is forgotten after, whether it has been
#: alerted, how many seconds it has; the seconds of all IPs and their failures.
STATE_SCHEMA = ("ips array<string>, until array<long>, alerted array<boolean>, sizes array<long>, "
                "secs array<long>, counts array<long>")
ROWS_AT_ONCE = 100_000


def stream_access_log(spark: SparkSession, log_dir: str, pattern: str | None = None,
                      max_files_per_trigger: int | None = None, metrics: ParseMetrics | None = None) -> DataFrame:
    """Streaming typed access-log table over new files landing in ``log_dir``.

    ``ParseMetrics(name, streaming=True)`` reports each micro-batch's parse
    quality; see ``batch_quality``."""
    reader = spark.readStream.format("text")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return parse_lines(reader.load(log_dir), metrics=metrics).select(*BASE_COLUMNS)


def batch_quality(query, name: str = "parse_quality") -> list[dict]:
    """Of each micro-batch that the query still remembers: its number, the
    parse-quality figures of the metrics ``name``, and the rows that stateful
    operators dropped because they came behind the watermark."""
    found = []
    for progress in query.recentProgress:
        seen = progress.observedMetrics
        lines, rows = seen.get(f"{name}_lines"), seen.get(f"{name}_rows")
        late = sum(state.numRowsDroppedByWatermark for state in progress.stateOperators)
        figures = ParseMetrics.figures(lines.asDict(), rows.asDict()) if lines and rows else {}
        found.append({"batch": progress.batchId, **figures, "dropped_late": late})
    return found


def stream_hourly_traffic(parsed: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Requests per clock hour; a window is emitted (append mode) once the
    watermark passes its end. Input rows older than the previous micro-batch's
    watermark are dropped (Spark's late-event rule), so rows arriving in the
    same batch that moved the watermark past them can still count."""
    return (parsed.withWatermark("timestamp", watermark)
            .groupBy(F.window("timestamp", "1 hour").alias("w"))
            .agg(F.count(F.lit(1)).alias("request_count"))
            .select(F.col("w.start").alias("hour_bucket"), "request_count"))


PER_SECOND_SCHEMA = "ip string, timestamp timestamp, ts_epoch long, n long, first timestamp, path string"


def _per_second(batches):
    """Failures of an Arrow batch as one row per (ip, second): their number,
    the last timestamp (event time of the row), and the first timestamp with
    its smallest path (nulls first)."""
    for pdf in batches:
        pdf = pdf.assign(no_path=pdf["path"].isna()).sort_values(
            ["ip", "ts_epoch", "timestamp", "no_path", "path"], ascending=[True, True, True, False, True], kind="mergesort")
        second = ["ip", "ts_epoch"]
        sums = pdf.groupby(second).agg(n=("timestamp", "size"), first=("timestamp", "min"), timestamp=("timestamp", "max"))
        paths = pdf.drop_duplicates(second).set_index(second)["path"]  # of the first row by the order above
        yield sums.join(paths).reset_index()[["ip", "timestamp", "ts_epoch", "n", "first", "path"]]


def _combined(batches) -> pd.DataFrame:
    """One row per (ip, second) of a bucket's rows: the failures of all tasks, and
    the least (first timestamp, has a path, path)."""
    second, names = ["ip", "ts_epoch"], ["ip", "ts_epoch", "n", "first", "path"]
    parts, held, least = [], 0, 0

    def combine() -> pd.DataFrame:
        rows = pd.concat(parts, ignore_index=True)
        rows = rows.assign(has=rows["path"].notna(), text=rows["path"].fillna("")).sort_values(
            [*second, "first", "has", "text"], kind="mergesort")
        sums = rows.groupby(second, sort=True)["n"].sum()
        return rows.drop_duplicates(second)[names].assign(n=sums.to_numpy())

    for batch in batches:
        parts.append(batch[names])
        held += len(batch)
        if held > max(ROWS_AT_ONCE, 2 * least):
            parts = [combine()]
            held = least = len(parts[0])
    return combine() if held else pd.DataFrame(columns=names)


def _alert_state_fn(window_seconds: int, threshold: int, window_minutes: int):
    def fn(key, batches, state):
        old_ips, old_until, old_alerted, sizes, secs, counts = map(list, state.get) if state.exists else ([], [], [], [], [], [])
        new = _combined([] if state.hasTimedOut else batches)
        now = state.getCurrentWatermarkMs()
        old = pd.DataFrame({"ip": np.repeat(np.array(old_ips, dtype=object), np.array(sizes, dtype=np.int64)),
                            "ts_epoch": np.array(secs, dtype=np.int64), "n": np.array(counts, dtype=np.int64)})
        if new.empty and old.empty:
            return
        # a row per (ip, second), in that order; ``first`` is there for the new seconds
        rows = (pd.concat([x[["ip", "ts_epoch", "n"]] for x in (old, new) if len(x)])
                .groupby(["ip", "ts_epoch"], sort=True)["n"].sum().reset_index())
        if len(new):
            rows = rows.merge(new.drop(columns="n"), on=["ip", "ts_epoch"], how="left")
            fresh = rows["first"].notna().to_numpy()
        else:
            fresh = np.zeros(len(rows), dtype=bool)
        ips, code = np.unique(rows["ip"].to_numpy(dtype=object), return_inverse=True)
        secs, n = rows["ts_epoch"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.int64)
        until, alerted, seen = np.zeros(len(ips), dtype=np.int64), np.zeros(len(ips), dtype=bool), np.zeros(len(ips), dtype=bool)
        place = np.searchsorted(ips, np.array(old_ips, dtype=object))
        until[place], alerted[place] = old_until, old_alerted
        seen[code[fresh]] = True

        # the IPs one behind the other in time, more than a window apart
        at = code * (secs.max() - secs.min() + window_seconds + 1) + secs
        summed = np.concatenate([[0], np.cumsum(n)])
        total = summed[1:] - summed[np.searchsorted(at, at - window_seconds, side="left")]
        over = np.flatnonzero(fresh & ~alerted[code] & (total >= threshold))
        over = over[np.unique(code[over], return_index=True)[1]]  # of each IP its first
        alerted[code[over]] = True

        newest = secs[np.flatnonzero(np.diff(code, append=len(ips)))]
        # event-time timeouts must lie after the current watermark (late rows
        # can make ``newest`` older than it)
        until = np.where(seen, np.maximum((newest + window_seconds) * 1000 + 1, now + 1), until)
        stay = seen | (until >= now)  # as Spark's timeouts: an IP that new rows reach is not forgotten
        kept = stay[code] & (secs >= newest[code] - window_seconds)
        if stay.any():
            state.update((ips[stay].tolist(), until[stay].tolist(), alerted[stay].tolist(),
                          np.bincount(code[kept], minlength=len(ips))[stay].tolist(), secs[kept].tolist(), n[kept].tolist()))
            state.setTimeoutTimestamp(int(until[stay].min()))
        else:
            state.remove()
        if len(over):
            out = rows.iloc[over]
            yield pd.DataFrame({"ip": out["ip"], "window_end": out["first"], "failures_in_window": total[over],
                                "example_path": out["path"].where(out["path"].notna(), None), "window_minutes": window_minutes})
    return fn


def stream_brute_force(parsed: DataFrame, window_minutes: int = 5, threshold: int = 20,
                       watermark: str = "10 minutes") -> DataFrame:
    """Alerts when an IP reaches ``threshold`` 401/403 responses within the
    closed ``window_minutes`` interval; one alert per IP until it has been
    quiet for a whole window (event time).

    Failures are combined per (ip, second) where they are read, before the
    shuffle: a hot IP sends at most one row per second and Arrow batch, and no
    micro-batch of raw rows is ever gathered. State per IP is the failure count
    per second inside the window (at most ``60 * window_minutes`` entries); the
    IPs of a hash bucket share a state record, so calls don't grow with the IPs,
    and a bucket times out when the first of them does. For
    in-order input the alerts equal the batch ``brute_force``; late rows
    (within the watermark) are counted when they arrive. A second is late as a
    whole, by its last failure.
    """
    w = int(window_minutes) * 60
    fails = (parsed.where(F.col("status").isin(*AUTH_FAILURE_STATUSES) & F.col("ip").isNotNull()
                          & F.col("timestamp").isNotNull())
             .select("ip", "timestamp", "path", F.unix_seconds("timestamp").alias("ts_epoch"))
             .mapInPandas(_per_second, PER_SECOND_SCHEMA)
             .withWatermark("timestamp", watermark))
    return fails.withColumn("bucket", F.pmod(F.xxhash64("ip"), F.lit(BUCKETS))).groupBy("bucket").applyInPandasWithState(
        _alert_state_fn(w, int(threshold), int(window_minutes)),
        ALERT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def start_stream(df: DataFrame, name: str, sink_path: str | None = None, fmt: str = "parquet",
                 output_mode: str = "append", checkpoint_location: str | None = None,
                 trigger: dict | None = None):
    """Start a fault-tolerant streaming query.

    Progress and operator state go to ``checkpoint_location`` (default: a
    folder named after the query under the session's shared
    ``spark.checkpoint.dir``), so a restarted query or a lost executor
    resumes without losing or repeating output for file sinks.
    """
    from ..session import ensure_checkpoint_dir
    spark = df.sparkSession
    location = checkpoint_location or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    writer = (df.writeStream.queryName(name).outputMode(output_mode)
              .option("checkpointLocation", location))
    if trigger:
        writer = writer.trigger(**trigger)
    if fmt == "memory":
        return writer.format("memory").start()
    return writer.format(fmt).start(sink_path)
