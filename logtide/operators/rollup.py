"""Headline figures, top IPs and fences of any span of days from daily parts.

One row per (date, status) holds exact counts and sums and a mergeable
HyperLogLog sketch of the IPs. Days can be added as they end, and any span is
summed up without reading the log again. All figures are exact but the number
of IPs, whose relative standard error is about 0.83 / sqrt(2 ** lg_k): 0.65%
at 14. ``summary.summary_stats`` stays the exact way.

A second table of exact counts per (date, ip) answers the per-IP questions:
its rows are summed per IP over the span, so quartiles and ranks are those of
the log itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import ensure_features
from ..sinks.writers import write_parquet
from .clients import busiest
from .detectors import beyond_fence
from .summary import BYTES_PER_GIB, MICROS_PER_DAY

LG_K = 14
SUMS = ("n", "errors", "with_error", "bots", "with_bot", "bytes", "server_errors")


def daily_rollup(df: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """One row per (date, status): ``SUMS``, first and last timestamp, and the
    sketch ``ips``. Sketches are merged map-side, so a hot day or IP sends one
    row a task."""
    df = ensure_features(df)
    flag = lambda c: F.sum(F.col(c).cast("bigint"))
    return df.groupBy("date", "status").agg(
        F.count(F.lit(1)).alias("n"), flag("is_error").alias("errors"), F.count("is_error").alias("with_error"),
        flag("is_bot").alias("bots"), F.count("is_bot").alias("with_bot"),
        F.sum(F.col("bytes").cast("decimal(38,0)")).alias("bytes"), F.count_if("is_server_error").alias("server_errors"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.hll_sketch_agg("ip", lg_k).alias("ips"))


def summarize_rollup(rollup: DataFrame, by: dict[str, Column] | None = None) -> DataFrame:
    """``summary_stats`` of the rollup's rows, with ``unique_ips`` estimated:
    one row, or one for each value of the columns ``by`` (name -> column of
    date). Filter the rollup by date first to choose a span."""
    by = by or {}
    parts = rollup.select("*", *[c.alias(name) for name, c in by.items()])
    ranked = F.when(F.col("status").isNotNull(), F.struct("n", (-F.col("status")).alias("rank"), F.col("status").cast("int").alias("code")))
    per_status = parts.groupBy(*by, "status").agg(
        *[F.sum(c).alias(c) for c in SUMS], F.min("first").alias("first"), F.max("last").alias("last"),
        F.hll_union_agg("ips").alias("ips"))
    totals = per_status.groupBy(*by).agg(
        F.max(ranked).alias("top"), *[F.sum(c).alias(c) for c in SUMS], F.min("first").alias("first"), F.max("last").alias("last"),
        F.hll_union_agg("ips").alias("ips"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b).cast("double") * 100)
    return totals.select(
        *by, F.coalesce("n", F.lit(0).cast("bigint")).alias("total_requests"),
        F.coalesce(F.hll_sketch_estimate("ips"), F.lit(0).cast("bigint")).alias("unique_ips"),
        F.floor((F.unix_micros("last") - F.unix_micros("first")) / F.lit(MICROS_PER_DAY)).alias("date_range_days"),
        share("errors", "with_error").alias("error_rate"), share("bots", "with_bot").alias("bot_traffic_pct"),
        F.col("top.code").alias("top_status"), (F.col("bytes").cast("double") / F.lit(BYTES_PER_GIB)).alias("total_bytes_gb"),
        F.coalesce("server_errors", F.lit(0).cast("bigint")).alias("server_errors"))


def daily_ip_rollup(df: DataFrame) -> DataFrame:
    """One row per (date, ip) with ``top_ips``' counts; null IPs and dates are left out."""
    df = ensure_features(df)
    return (df.where(F.col("ip").isNotNull() & F.col("date").isNotNull()).groupBy("date", "ip")
            .agg(F.count(F.lit(1)).alias("total_requests"), F.count_if("is_error").alias("error_requests"),
                 F.count_if("is_bot").alias("bot_requests")))


def store_days(rollup: DataFrame, path: str) -> None:
    """Write a rollup's days into the table at ``path``: days that it holds
    replace stored ones, so a day can be done again, and other days stay."""
    write_parquet(rollup, path, partition_by="date", days_only=True)


def _per_ip(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("ip").agg(*[F.sum(c).alias(c) for c in ("total_requests", "error_requests", "bot_requests")])


def rollup_top_ips(rollup: DataFrame, n: int = 15) -> DataFrame:
    """``clients.top_ips`` of the rollup's days."""
    return busiest(_per_ip(rollup), n)


def rollup_iqr_outliers(rollup: DataFrame) -> DataFrame:
    """``detectors.iqr_outliers`` of the rollup's days."""
    return beyond_fence(_per_ip(rollup).select("ip", "total_requests"), "total_requests")
