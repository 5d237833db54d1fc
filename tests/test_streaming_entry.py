import datetime as dt
import os
import tempfile

import numpy as np

from conftest import BASE_TS, make_log

import __spark_entry__ as entry
from logtide.functions.features import add_features
from logtide.operators import detectors
from logtide.sources.access_view import render_lines
from logtide.streaming.live import stream_access_log, stream_brute_force, stream_hourly_traffic


def _write_lines(spark, df, d, name):
    lines = [r.value for r in render_lines(df).collect()]
    with open(os.path.join(d, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def _run_to_memory(stream_df, name, mode="append"):
    q = (stream_df.writeStream.format("memory").queryName(name).outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    return q


def test_stream_ingest_and_brute_force_match_batch(spark):
    src = tempfile.mkdtemp(prefix="logtide-stream-")
    rows = [{"ip": "9.9.9.9", "status": 401, "path": "/login",
             "timestamp": BASE_TS + dt.timedelta(seconds=5 * i)} for i in range(30)]
    rows += [{"ip": "1.1.1.1", "status": 401, "timestamp": BASE_TS + dt.timedelta(seconds=100 * i)} for i in range(5)]
    base = make_log(spark, rows)
    _write_lines(spark, base.limit(15), src, "a.log")
    _write_lines(spark, base.subtract(base.limit(15)), src, "b.log")
    parsed = stream_access_log(spark, src, max_files_per_trigger=1)
    _run_to_memory(parsed, "lt_ingest")
    assert spark.table("lt_ingest").count() == 35
    _run_to_memory(stream_brute_force(stream_access_log(spark, src, max_files_per_trigger=1), 5, 20),
                   "lt_alerts")
    got = [(r.ip, r.window_end, r.failures_in_window) for r in spark.table("lt_alerts").collect()]
    want = [(r.ip, r.window_end, r.failures_in_window)
            for r in detectors.brute_force(add_features(base), 5, 20).collect()]
    assert got == want == [("9.9.9.9", BASE_TS + dt.timedelta(seconds=95), 20)]


def test_stream_hourly_traffic_emits_closed_windows(spark):
    src = tempfile.mkdtemp(prefix="logtide-stream-")
    rows = [{"timestamp": BASE_TS + dt.timedelta(minutes=20 * i)} for i in range(12)]
    _write_lines(spark, make_log(spark, rows), src, "a.log")
    _run_to_memory(stream_hourly_traffic(stream_access_log(spark, src), watermark="1 hour"), "lt_hourly")
    got = sorted((r.hour_bucket, r.request_count) for r in spark.table("lt_hourly").collect())
    # windows whose end is behind the final watermark are emitted, 3 rows each
    assert got and all(c == 3 for _, c in got)
    assert got[0][0] == dt.datetime(2024, 1, 15, 8, 0)


def test_start_stream_with_session_checkpoint(spark):
    from logtide.streaming.live import start_stream
    src = tempfile.mkdtemp(prefix="logtide-stream-")
    _write_lines(spark, make_log(spark, [{}, {}, {}]), src, "a.log")
    name = "lt_started_" + os.path.basename(src).replace("-", "_")
    q = start_stream(stream_access_log(spark, src), name, fmt="memory", trigger={"availableNow": True})
    q.awaitTermination(300)
    assert spark.table(name).count() == 3
    from logtide.session import ensure_checkpoint_dir
    ckpt = ensure_checkpoint_dir(spark).replace("file:", "")
    assert os.path.isdir(os.path.join(ckpt, "streams", name))


def test_entry_and_registry(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 15 and "total_requests" in df.columns
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    own = {k for k in q if not k.startswith("op") and k != "pipeline"}
    assert own - set(o) == {"isolation_forest"}


def test_stream_hourly_traffic_drops_rows_behind_watermark(spark):
    # Spark filters late rows against the previous batch's watermark, so the
    # late file is the third micro-batch, after one batch that moved it on.
    import time
    src = tempfile.mkdtemp(prefix="logtide-stream-")
    first = [{"timestamp": BASE_TS + dt.timedelta(minutes=30 * i)} for i in range(8)]      # 08:00 .. 11:30
    later = [{"timestamp": BASE_TS + dt.timedelta(hours=4, minutes=30 * i)} for i in range(4)]  # 12:00 .. 13:30
    late = [{"timestamp": BASE_TS + dt.timedelta(minutes=15)}, {"timestamp": BASE_TS - dt.timedelta(hours=5)}]
    for rows, name in ((first, "a.log"), (later, "b.log"), (late, "c.log")):
        _write_lines(spark, make_log(spark, rows), src, name)
    now = time.time()                 # the file source reads the oldest file first
    for k, name in enumerate(("a.log", "b.log", "c.log")):
        os.utime(os.path.join(src, name), (now - 300 + 60 * k, now - 300 + 60 * k))
    name = "lt_late_" + os.path.basename(src).replace("-", "_")
    _run_to_memory(stream_hourly_traffic(stream_access_log(spark, src, max_files_per_trigger=1),
                                         watermark="1 hour"), name)
    got = {r.hour_bucket: r.request_count for r in spark.table(name).collect()}
    assert got[dt.datetime(2024, 1, 15, 8, 0)] == 2            # the late 08:15 row was dropped
    assert dt.datetime(2024, 1, 15, 3, 0) not in got            # so was the 03:00 row


def test_stream_brute_force_survives_rows_older_than_the_watermark(spark):
    import time
    src = tempfile.mkdtemp(prefix="logtide-stream-")
    a1 = [{"ip": "1.1.1.1", "status": 401, "timestamp": BASE_TS + dt.timedelta(seconds=10 * i)} for i in range(5)]
    a2 = [{"ip": "1.1.1.1", "status": 401, "timestamp": BASE_TS + dt.timedelta(hours=4, seconds=i)} for i in range(5)]
    b = [{"ip": "2.2.2.2", "status": 401, "timestamp": BASE_TS + dt.timedelta(hours=1, seconds=i)} for i in range(5)]
    for rows, name in ((a1, "a.log"), (a2, "b.log"), (b, "c.log")):
        _write_lines(spark, make_log(spark, rows), src, name)
    now = time.time()
    for k, name in enumerate(("a.log", "b.log", "c.log")):
        os.utime(os.path.join(src, name), (now - 300 + 60 * k, now - 300 + 60 * k))
    name = "lt_bf_late_" + os.path.basename(src).replace("-", "_")
    q = _run_to_memory(stream_brute_force(stream_access_log(spark, src, max_files_per_trigger=1), 5, 5), name)
    assert q.exception() is None
    got = {r.ip for r in spark.table(name).collect()}
    assert "1.1.1.1" in got


def test_streaming_failures_are_combined_per_second_before_state():
    import pandas as pd

    from logtide.streaming.live import _per_second
    n = 5000
    t = pd.Timestamp("2024-01-15 08:00:00") + pd.to_timedelta(np.arange(n) * 7, unit="ms")
    pdf = pd.DataFrame({"ip": np.where(np.arange(n) % 10, "6.6.6.6", "1.1.1.1"), "timestamp": t,
                        "path": np.where(np.arange(n) % 3, "/a", None),
                        "ts_epoch": t.astype("int64") // (10 ** 9 if t.unit == "ns" else 10 ** 6)})
    (out,) = _per_second([pdf])
    assert len(out) == pdf.groupby(["ip", "ts_epoch"]).ngroups <= 2 * 36 and out.n.sum() == n
    hot = out[out.ip == "6.6.6.6"].sort_values("ts_epoch").iloc[0]
    assert hot["first"] == t[1] and hot["path"] == "/a" and hot["timestamp"] <= t[142]
