"""Traffic over time: hourly and daily counts, requests by hour of day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import ensure_features, utc_hour_start


def hourly_traffic(df: DataFrame) -> DataFrame:
    """(hour_bucket, request_count) per clock hour present in the data, ascending
    (UTC hours, whatever the caller's session time zone)."""
    return (df.where(F.col("timestamp").isNotNull())
            .groupBy(utc_hour_start(F.col("timestamp")).alias("hour_bucket"))
            .agg(F.count(F.lit(1)).alias("request_count"))
            .orderBy("hour_bucket"))


def daily_traffic(df: DataFrame) -> DataFrame:
    """(date, request_count) per calendar day (UTC), ascending."""
    df = ensure_features(df)
    return (df.where(F.col("date").isNotNull())
            .groupBy("date")
            .agg(F.count(F.lit(1)).alias("request_count"))
            .orderBy("date"))


def peak_hours(df: DataFrame) -> DataFrame:
    """Requests by hour of day, busiest first.

    ``avg_requests`` keeps the reference's meaning (the total over all days);
    ``avg_per_day`` divides it by the number of distinct dates in the table.
    Both come from one per-(date, hour) aggregate (at most 24 rows per day of
    log span): the day count is a scalar subquery over it, and its exchange
    is reused, so the log is scanned once.
    """
    df = ensure_features(df)
    per_date_hour = (df.where(F.col("hour").isNotNull())
                     .groupBy("date", "hour").agg(F.count(F.lit(1)).alias("n")))
    n_days = per_date_hour.select(F.count_distinct("date")).scalar()
    return (per_date_hour.groupBy("hour")
            .agg(F.sum("n").alias("avg_requests"))
            .withColumn("avg_per_day", F.col("avg_requests") / n_days)
            .orderBy(F.desc("avg_requests"), F.asc("hour")))
