"""One key holding a third of all rows: results must stay exact.

The data is generated by Spark (``spark.range``); the expected values come
from vectorised numpy/pandas references over the same rows.
"""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logtide.functions.features import add_features
from logtide.operators import detectors, ip_features

N = 60_000
T0 = 1_705_305_600  # 2024-01-15 08:00:00 UTC


@pytest.fixture(scope="module")
def hot_log(spark):
    i = F.col("id")
    hot = i % 3 == 0                                   # a third of all rows: one IP
    ts_sec = F.when(hot, F.lit(T0) + F.floor(((i / 3).cast("bigint") % 9000) / 4))  # ~4 requests per second
    ts_sec = ts_sec.otherwise(F.lit(T0) + (i * 7919) % 86400)
    df = spark.range(N).select(
        F.when(hot, F.lit("6.6.6.6")).otherwise(F.concat(F.lit("10.0.0."), (i % 300).cast("string"))).alias("ip"),
        F.lit(None).cast("string").alias("user"),
        F.timestamp_seconds(ts_sec).alias("timestamp"),
        F.lit("GET").alias("method"),
        F.concat(F.lit("/p"), (i % 13).cast("string")).alias("path"),
        F.lit("HTTP/1.1").alias("protocol"),
        F.when(hot & (i % 2 == 0), F.lit(401)).when(i % 11 == 0, F.lit(403))
         .otherwise(F.lit(200)).cast("smallint").alias("status"),
        (i % 5000).alias("bytes"),
        F.lit(None).cast("string").alias("referrer"),
        F.lit("Mozilla/5.0").alias("user_agent"))
    return add_features(df)


def sliding_first_alert(pdf, w, thr):
    out = {}
    fails = pdf[pdf.status.isin([401, 403])]
    for ip, g in fails.groupby("ip"):
        e = np.sort(g.e.to_numpy())
        cnt = np.searchsorted(e, e, side="right") - np.searchsorted(e, e - w, side="left")
        hit = np.flatnonzero(cnt >= thr)
        if len(hit):
            out[ip] = (int(e[hit[0]]), int(cnt[hit[0]]))
    return out


def test_brute_force_with_hot_ip(spark, hot_log):
    pdf = hot_log.select("ip", "status", F.unix_seconds("timestamp").alias("e")).toPandas()
    want = sliding_first_alert(pdf, 300, 200)
    got = {r.ip: (int(r.window_end.replace(tzinfo=dt.timezone.utc).timestamp()), r.failures_in_window)
           for r in detectors.brute_force(hot_log, window_minutes=5, threshold=200,
                                          bucket_seconds=900).collect()}
    assert "6.6.6.6" in want and got == want


def test_ip_features_with_hot_ip(spark, hot_log):
    got = ip_features.ip_feature_matrix(hot_log, bucket_seconds=600).toPandas().set_index("ip")
    pdf = hot_log.select("ip", "timestamp", "status").toPandas().sort_values(["ip", "timestamp"])
    gaps = pdf.groupby("ip")["timestamp"].diff().dt.total_seconds()
    want_p95 = gaps.groupby(pdf["ip"]).quantile(0.95).fillna(0)
    want_std = pdf.groupby("ip")["status"].std().fillna(0)
    assert got.loc["6.6.6.6", "total_requests"] == N // 3
    np.testing.assert_allclose(got["p95_request_gap"].sort_index(), want_p95.sort_index(), rtol=1e-12)
    np.testing.assert_allclose(got["status_std"].sort_index(), want_std.sort_index(), rtol=1e-9)
    assert isinstance(got, pd.DataFrame)


def test_ip_features_with_sub_second_hot_ip(spark):
    """Hundreds of thousands of different microsecond gaps of one IP."""
    from conftest import make_log
    rng = np.random.default_rng(2)
    micros = np.cumsum(rng.integers(0, 40_000, 20_000)) + T0 * 1_000_000
    hot = spark.createDataFrame(pd.DataFrame({"m": micros})).select(
        F.lit("6.6.6.6").alias("ip"), F.timestamp_micros("m").alias("timestamp"))
    base = make_log(spark, [{"ip": "7.7.7.7"}] * 3).drop("ip", "timestamp").limit(1)
    df = add_features(hot.join(base, how="cross").unionByName(make_log(spark, [{"ip": "7.7.7.7"}] * 3)))
    got = {r.ip: r.p95_request_gap for r in ip_features.ip_feature_matrix(df, bucket_seconds=60).collect()}
    assert got["6.6.6.6"] == pytest.approx(np.percentile(np.diff(micros) / 1e6, 95), abs=1e-12)
    assert got["7.7.7.7"] == 30.0
