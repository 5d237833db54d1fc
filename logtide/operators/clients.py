"""Per-client aggregates: top IPs, bot/human split, top user agents, endpoints, bandwidth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import ensure_features, half_even


def top_ips(df: DataFrame, n: int = 15) -> DataFrame:
    """Top ``n`` IPs by requests with error and bot counts and the error rate.

    One hash aggregate on ``ip`` (map-side partial aggregation collapses a hot
    IP before the shuffle) followed by a TakeOrderedAndProject.
    """
    df = ensure_features(df)
    stats = (df.where(F.col("ip").isNotNull())
             .groupBy("ip")
             .agg(F.count(F.lit(1)).alias("total_requests"),
                  F.count_if(F.col("is_error")).alias("error_requests"),
                  F.count_if(F.col("is_bot")).alias("bot_requests")))
    return busiest(stats, n)


def busiest(stats: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of per-IP counts, with the error rate."""
    return (stats
            .withColumn("error_rate", half_even(F.col("error_requests") / F.col("total_requests"), 4))
            .orderBy(F.desc("total_requests"), F.asc("ip"))
            .limit(n))


def user_agent_split(df: DataFrame) -> DataFrame:
    """(label, count) with label Bot or Human; only labels that occur."""
    df = ensure_features(df)
    return (df.groupBy(F.when(F.col("is_bot"), F.lit("Bot")).otherwise(F.lit("Human")).alias("label"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("label")))


def top_user_agents(df: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent non-null user agents (user_agent, count)."""
    return (df.where(F.col("user_agent").isNotNull())
            .groupBy("user_agent")
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("user_agent"))
            .limit(n))


def user_agent_summary(df: DataFrame, n: int = 10) -> dict:
    """Both user-agent results, keyed as the dashboard uses them."""
    return {"traffic_split": user_agent_split(df), "top_user_agents": top_user_agents(df, n)}


def top_endpoints(df: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` paths with most 2xx responses (path, hit_count)."""
    df = ensure_features(df)
    return (df.where(F.col("is_success") & F.col("path").isNotNull())
            .groupBy("path")
            .agg(F.count(F.lit(1)).alias("hit_count"))
            .orderBy(F.desc("hit_count"), F.asc("path"))
            .limit(n))


def bandwidth_usage(df: DataFrame, n: int = 15) -> DataFrame:
    """Top ``n`` paths by bytes served: total, mean, request count and MiB (2 dp)."""
    return (df.where(F.col("path").isNotNull())
            .groupBy("path")
            .agg(F.sum("bytes").alias("total_bytes"),
                 F.avg("bytes").alias("avg_bytes"),
                 F.count("bytes").alias("request_count"))
            .orderBy(F.desc("total_bytes"), F.asc("path"))
            .limit(n)
            .withColumn("total_mb", half_even(F.col("total_bytes") / F.lit(1048576), 2)))
