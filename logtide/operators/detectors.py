"""Outlier detectors: hourly z-score per IP, brute-force logins, IQR fence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import ensure_features, half_even
from ..functions.fixed_values import AUTH_FAILURE_STATUSES
from ..functions.stats import exact_stddev_samp


def traffic_anomalies(df: DataFrame, z_threshold: float = 3.0, broadcast_stats: bool = False) -> DataFrame:
    """(date, hour, ip) windows whose request count is ``z_threshold`` sample
    standard deviations or more above the mean of that (date, hour).

    Plan: one hash aggregate to per-(date, hour, ip) counts (map-side partial
    aggregation, so a hot IP is pre-combined), a second tiny aggregate to the
    per-(date, hour) mean and sample std, and a join back. The stats side has
    one row per clock hour of the log; AQE measures it at run time and
    broadcasts it if it is small. ``broadcast_stats=True`` forces that, for
    logs whose time span is known to be bounded (8,784 rows a year). The
    counts exchange is reused by both branches.
    A missing std (one IP in the hour) becomes 1.0 and std is clipped at 1.0;
    z is rounded half-even to 3 decimals before the threshold test.
    """
    df = ensure_features(df)
    counts = (df.where(F.col("ip").isNotNull() & F.col("date").isNotNull())
              .groupBy("date", "hour", "ip")
              .agg(F.count(F.lit(1)).alias("request_count")))
    stats = (counts.groupBy("date", "hour")
             .agg(F.avg("request_count").alias("window_mean"),
                  exact_stddev_samp(F.col("request_count"), wide=True).alias("window_std"))
             .withColumn("window_std", F.greatest(F.coalesce(F.col("window_std"), F.lit(1.0)), F.lit(1.0))))
    z = half_even((F.col("request_count") - F.col("window_mean")) / F.col("window_std"), 3)
    return (counts.join(F.broadcast(stats) if broadcast_stats else stats, ["date", "hour"])
            .withColumn("z_score", z)
            .where(F.col("z_score") >= F.lit(float(z_threshold)))
            .select("date", "hour", "ip", "request_count", "window_mean", "window_std", "z_score")
            .orderBy(F.desc("z_score"), F.asc("date"), F.asc("hour"), F.asc("ip")))


def brute_force(df: DataFrame, window_minutes: int = 5, threshold: int = 20,
                bucket_seconds: int | None = None) -> DataFrame:
    """First moment each IP reaches ``threshold`` auth failures (401/403)
    within the closed interval [t - window, t] of integer epoch seconds.

    One row per alerting IP: ip, window_end, failures_in_window,
    example_path, window_minutes; most failures first.

    Scale: every row of one second has the same interval, so the failures
    are first hash-aggregated per (ip, second): a count and the first
    timestamp. That aggregate is combined map-side, so a hot IP costs at most
    one row per distinct second. The path (of the first row by timestamp, then
    path with nulls first) is looked up afterwards, for alert seconds only.
    The interval sum then runs as a RANGE window over those per-second rows,
    partitioned by (ip, time bucket) of ``bucket_seconds`` (default six hours
    or four windows, whichever is longer; at least the window). Seconds whose
    interval reaches into the next bucket are copied there as halo rows (at
    most window/bucket of them), so sums stay exact. A window partition
    therefore holds at most ``bucket_seconds`` rows whatever the traffic, and
    a hot IP's days of activity spread over many tasks. The first alerting
    second per IP is a hash aggregate too (``min_by`` over longs).
    """
    w = int(window_minutes) * 60
    width = int(bucket_seconds or max(6 * 3600, 4 * w))
    if width < w:
        raise ValueError("bucket_seconds must be at least the window length")
    fails = (df.where(F.col("status").isin(*AUTH_FAILURE_STATUSES)
                      & F.col("ip").isNotNull() & F.col("timestamp").isNotNull())
             .select("ip", "timestamp", "path", F.unix_seconds("timestamp").alias("ts_epoch")))
    per_second = (fails.groupBy("ip", "ts_epoch")
                  .agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"))
                  .withColumn("bucket", F.floor(F.col("ts_epoch") / F.lit(width))))
    reaches_next = F.col("ts_epoch") >= (F.col("bucket") + 1) * F.lit(width) - F.lit(w)
    expanded = (per_second
                .withColumn("shift", F.explode(F.when(reaches_next, F.array(F.lit(0), F.lit(1)))
                                               .otherwise(F.array(F.lit(0)))))
                .withColumn("own", F.col("shift") == 0)
                .withColumn("bucket", F.col("bucket") + F.col("shift"))
                .drop("shift"))
    frame = Window.partitionBy("ip", "bucket").orderBy("ts_epoch").rangeBetween(-w, 0)
    hits = (expanded
            .withColumn("failures_in_window", F.sum("n").over(frame))
            .where(F.col("own") & (F.col("failures_in_window") >= F.lit(threshold))))
    alerts = (hits.groupBy("ip")
              .agg(F.min_by("first", "ts_epoch").alias("window_end"),
                   F.min_by("failures_in_window", "ts_epoch").alias("failures_in_window")))
    at_alert = fails.select("ip", F.col("timestamp").alias("window_end"), "path").join(alerts, ["ip", "window_end"])
    by_path = Window.partitionBy("ip").orderBy(F.asc_nulls_first("path"))
    return (at_alert.withColumn("nth", F.row_number().over(by_path)).where(F.col("nth") == 1)
            .select("ip", "window_end", "failures_in_window", F.col("path").alias("example_path"),
                    F.lit(int(window_minutes)).alias("window_minutes"))
            .orderBy(F.desc("failures_in_window"), F.asc("ip")))


def iqr_outliers(df: DataFrame, column: str = "total_requests") -> DataFrame:
    """IPs whose request count is strictly above Q3 + 1.5 * IQR.

    Quartiles are exact with linear interpolation. The fence is a scalar
    subquery over the per-IP counts (evaluated once; the counts exchange is
    reused), so there is no join at all.
    """
    return beyond_fence(df.where(F.col("ip").isNotNull()).groupBy("ip").agg(F.count(F.lit(1)).alias(column)), column)


def beyond_fence(counts: DataFrame, column: str) -> DataFrame:
    """The rows (ip, ``column``) above the fence of all of them."""
    q1 = F.percentile(F.col(column), F.lit(0.25))
    q3 = F.percentile(F.col(column), F.lit(0.75))
    fence = counts.select(q3 + F.lit(1.5) * (q3 - q1)).scalar()
    return (counts.where(F.col(column) > fence)
            .withColumn("upper_fence", half_even(fence, 2))
            .withColumn("excess", half_even(F.col(column) - fence, 2))
            .orderBy(F.desc(column), F.asc("ip")))
