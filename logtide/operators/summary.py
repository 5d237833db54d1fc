"""Headline KPIs of a log table (one row)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import ensure_features, half_even

BYTES_PER_GIB = 1073741824
MICROS_PER_DAY = 86400 * 1000000


def summary_stats(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Request count, distinct IPs, span in whole days, error and bot
    percentages, the most frequent status (smallest on ties), GiB served and
    the server-error count, as one row.

    ``date_range_days`` floors the elapsed time, it does not count calendar
    days. One scan: a hash aggregate per (ip, status), combined map-side, whose
    shuffle the totals, the status counts and the IP count all reuse; the
    latter two enter as one-row scalars. With ``approx_distinct`` the first
    aggregate is per status alone and a HyperLogLog++ sketch (about 1% error)
    counts the IPs, so nothing is shuffled by ``ip``.
    """
    df = ensure_features(df)
    ts = F.col("timestamp")
    flag = lambda c: F.sum(F.col(c).cast("bigint"))
    parts = df.groupBy(*(["status"] if approx_distinct else ["ip", "status"])).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"),
        flag("is_error").alias("errors"), F.count("is_error").alias("with_error"),
        flag("is_bot").alias("bots"), F.count("is_bot").alias("with_bot"),
        # decimal sum: a year of traffic can exceed the 64-bit byte count
        F.sum(F.col("bytes").cast("decimal(38,0)")).alias("bytes"),
        F.count_if(F.col("is_server_error")).alias("server_errors"))
    totals = parts.agg(*[F.sum(c).alias(c) for c in ("n", "errors", "with_error", "bots", "with_bot", "bytes",
                                                     "server_errors")],
                       F.min("first").alias("first"), F.max("last").alias("last"))
    top_status = (parts.where(F.col("status").isNotNull()).groupBy("status").agg(F.sum("n").alias("n"))
                  .orderBy(F.desc("n"), F.asc("status")).limit(1).select(F.col("status").cast("int")))
    if approx_distinct:
        ips = df.agg(F.approx_count_distinct("ip", 0.01))
    else:
        ips = parts.where(F.col("ip").isNotNull()).select("ip").distinct().agg(F.count(F.lit(1)))
    span = F.unix_micros("last") - F.unix_micros("first")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b).cast("double") * 100)
    return totals.select(
        F.coalesce("n", F.lit(0).cast("bigint")).alias("total_requests"),
        ips.scalar().alias("unique_ips"),
        F.floor(span / F.lit(MICROS_PER_DAY)).alias("date_range_days"),
        share("errors", "with_error").alias("error_rate"),
        share("bots", "with_bot").alias("bot_traffic_pct"),
        top_status.scalar().alias("top_status"),
        (F.col("bytes").cast("double") / F.lit(BYTES_PER_GIB)).alias("total_bytes_gb"),
        F.coalesce("server_errors", F.lit(0).cast("bigint")).alias("server_errors"),
    )


def feature_rates(df: DataFrame) -> DataFrame:
    """Rows, error % and bot % of the featured table (the numbers the
    reference logs after adding features), one row."""
    df = ensure_features(df)
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  (F.avg(F.col("is_error").cast("int")) * 100).alias("error_pct"),
                  (F.avg(F.col("is_bot").cast("int")) * 100).alias("bot_pct"))


def summary_report(df: DataFrame) -> DataFrame:
    """The same KPIs with the display formatting (``12.34%``, ``0.123 GB``).

    Values are rounded half-even first (Java's ``%.2f`` alone rounds ties
    up, Python's formatting rounds exact ties to even: 0.125 -> "0.12").
    """
    s = summary_stats(df)
    return s.select(
        "total_requests", "unique_ips", "date_range_days",
        F.format_string("%.2f%%", half_even(F.col("error_rate"), 2)).alias("error_rate"),
        F.format_string("%.2f%%", half_even(F.col("bot_traffic_pct"), 2)).alias("bot_traffic_pct"),
        "top_status",
        F.format_string("%.3f GB", half_even(F.col("total_bytes_gb"), 3)).alias("total_bytes_gb"),
        "server_errors",
    )
