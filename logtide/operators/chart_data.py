"""The tables behind the reference's charts (drawing itself is not built)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import ensure_features, utc_hour_start
from ..functions.fixed_values import AUTH_FAILURE_STATUSES, WEEKDAYS


def error_heatmap(df: DataFrame) -> DataFrame:
    """Mean error flag per (day_of_week, hour) in long form, Monday first.

    Cells cover every weekday that occurs times every hour that occurs;
    missing combinations are 0 (the pivot-and-fill of the chart). After the
    first aggregate everything is at most 7 x 24 rows: the hour list is a
    scalar subquery and is exploded per weekday, so no join grows with data.
    """
    df = ensure_features(df)
    cells = (df.where(F.col("day_of_week").isNotNull() & F.col("hour").isNotNull())
             .groupBy("day_of_week", "hour")
             .agg(F.avg(F.col("is_error").cast("double")).alias("cell_rate")))
    hours = cells.select(F.array_sort(F.collect_set("hour"))).scalar()
    grid = (cells.select("day_of_week").distinct()
            .withColumn("hour", F.explode(hours)))
    order = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("day_of_week")).cast("int")
    return (grid.join(cells, ["day_of_week", "hour"], "left")
            .select("day_of_week", order.alias("day_index"), "hour",
                    F.coalesce(F.col("cell_rate"), F.lit(0.0)).alias("error_rate"))
            .orderBy("day_index", "hour"))


def bot_vs_human(df: DataFrame) -> DataFrame:
    """Always two rows: Human Traffic and Bot Traffic with their counts (0 if none)."""
    df = ensure_features(df)
    totals = df.agg(F.count_if(~F.col("is_bot")).alias("human"), F.count_if(F.col("is_bot")).alias("bot"))
    return totals.select(F.inline(F.array(
        F.struct(F.lit("Human Traffic").alias("label"), F.col("human").alias("count")),
        F.struct(F.lit("Bot Traffic").alias("label"), F.col("bot").alias("count")))))


def auth_failure_timeline(df: DataFrame, top_n: int = 5) -> DataFrame:
    """401/403 counts per (hour_bucket, ip) for the ``top_n`` IPs with most failures.

    Failures are aggregated per (hour, ip) in one scan, combined map-side; an
    IP's hours (at most one entry per hour of the log) are then gathered with
    their total, and a TakeOrderedAndProject keeps ``top_n`` IPs.
    """
    fails = df.where(F.col("status").isin(*AUTH_FAILURE_STATUSES) & F.col("ip").isNotNull())
    counts = (fails.groupBy(utc_hour_start(F.col("timestamp")).alias("hour_bucket"), "ip")
              .agg(F.count(F.lit(1)).alias("failures")))
    top = (counts.groupBy("ip").agg(F.sum("failures").alias("n"),
                                    F.collect_list(F.struct("hour_bucket", "failures")).alias("hours"))
           .orderBy(F.desc("n"), F.asc("ip")).limit(top_n))
    return (top.select("ip", F.inline("hours")).select("hour_bucket", "ip", "failures")
            .orderBy("hour_bucket", "ip"))


def anomaly_points(anomalies: DataFrame) -> DataFrame:
    """Z-score anomalies with the timestamp of their (date, hour) window."""
    ts = F.timestamp_seconds(F.unix_date("date").cast("bigint") * 86400 + F.col("hour").cast("bigint") * 3600)
    return anomalies.withColumn("ts", ts)
