"""Registered queries: one callable per operator, each over the whole
``access_log`` view derived from the given tables.

Every callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame.
Parameters follow the survey's test-view table (z = 2.0, brute force over
60 minutes with threshold 5, top-n sizes of the reference defaults).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.csv_text import CSV_TEXT
from ..functions.features import add_features, half_even
from ..operators import (chart_data, clients, detectors, errors, ip_features, isolation_forest, profile,
                         summary, traffic)
from ..sources.access_view import BASE_COLUMNS, access_log, render_lines
from ..sources.csv_log import map_and_cast
from ..sources.raw_log import parse_lines, parse_quality
from .round_trips import file_queries

Query = Callable[[SparkSession, str], DataFrame]


def _featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_features(access_log(spark, sf_dir))


def iso_temporal(df: DataFrame) -> DataFrame:
    """Render DATE columns as ``yyyy-MM-dd`` and TIMESTAMP columns (whole
    seconds in the test view) as ``yyyy-MM-dd HH:mm:ss`` strings for the
    cross-engine check, so both engines hand over the same text."""
    fmt = {T.DateType: "yyyy-MM-dd", T.TimestampType: "yyyy-MM-dd HH:mm:ss",
           T.TimestampNTZType: "yyyy-MM-dd HH:mm:ss"}
    return df.withColumns({f.name: F.date_format(f.name, fmt[type(f.dataType)])
                           for f in df.schema.fields if type(f.dataType) in fmt})


def round_stats(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round sample statistics (std, mean, percentile) half-even to ``digits``
    decimals for the cross-engine check: engines differ in the last bit."""
    return df.withColumns({f.name: half_even(F.col(f.name), digits)
                           for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)})


def registered_queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q["features"] = lambda s, d: iso_temporal(_featured(s, d))
    q["status_distribution"] = lambda s, d: errors.status_distribution(_featured(s, d))
    q["error_summary"] = lambda s, d: errors.error_summary(_featured(s, d))
    q["top_404_paths"] = lambda s, d: errors.top_404_paths(_featured(s, d), n=10)
    q["hourly_traffic"] = lambda s, d: iso_temporal(traffic.hourly_traffic(_featured(s, d)))
    q["daily_traffic"] = lambda s, d: iso_temporal(traffic.daily_traffic(_featured(s, d)))
    q["peak_hours"] = lambda s, d: traffic.peak_hours(_featured(s, d))
    q["top_ips"] = lambda s, d: clients.top_ips(_featured(s, d), n=15)
    q["bandwidth"] = lambda s, d: clients.bandwidth_usage(_featured(s, d), n=15)
    q["ua_split"] = lambda s, d: clients.user_agent_split(_featured(s, d))
    q["top_user_agents"] = lambda s, d: clients.top_user_agents(_featured(s, d), n=10)
    q["top_endpoints"] = lambda s, d: clients.top_endpoints(_featured(s, d), n=10)
    q["summary_stats"] = lambda s, d: summary.summary_stats(_featured(s, d))
    q["feature_rates"] = lambda s, d: summary.feature_rates(_featured(s, d))
    q["summary_report"] = lambda s, d: summary.summary_report(_featured(s, d))
    q["zscore_anomalies"] = lambda s, d: iso_temporal(round_stats(
        detectors.traffic_anomalies(_featured(s, d), z_threshold=2.0)))
    q["brute_force"] = lambda s, d: iso_temporal(detectors.brute_force(_featured(s, d), window_minutes=60,
                                                                   threshold=5))
    q["iqr_outliers"] = lambda s, d: detectors.iqr_outliers(_featured(s, d))
    q["ip_features"] = lambda s, d: round_stats(ip_features.ip_feature_matrix(_featured(s, d)))
    _register_more(q)
    return {name: _in_utc(query) for name, query in q.items()}


def _in_utc(query: Query) -> Query:
    """The query in a UTC session: the caller's, or a new one beside it."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark = spark.newSession()
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)
    return run


# --- ingest over lines and frames derived from the access_log view ---------

def rendered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view rendered to Apache Combined text, one line per row."""
    return render_lines(access_log(spark, sf_dir, keep_line_id=True), keep=("line_id", "timestamp"))


def quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered lines grouped into one source per day, plus injected blank,
    malformed and bad-timestamp lines (every 50th, 70th and 90th row)."""
    r = rendered_lines(spark, sf_dir)
    lid = F.col("line_id")
    bad_ts = F.regexp_replace("value", r"\[[^\]]+\]", "[99/Foo/2024:25:61:61 +0000]")
    extra = F.array(F.col("value"),
                    F.when(lid % 50 == 0, F.lit("   ")),
                    F.when(lid % 70 == 0, F.lit("not an access log line")),
                    F.when(lid % 90 == 0, bad_ts))
    return (r.select(F.concat(F.lit("access-"), F.date_format("timestamp", "yyyy-MM-dd")).alias("source"),
                     F.explode(extra).alias("value"))
            .where(F.col("value").isNotNull()))


def aliased_csv_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as an all-string frame with CSV-style aliased headers."""
    b = access_log(spark, sf_dir, keep_line_id=True)
    return b.select(
        F.col("ip").alias("Client_IP"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(" Time "),
        F.col("method").alias("Verb"), F.col("path").alias("URL"),
        F.col("status").cast("string").alias("Status_Code"),
        F.when(F.col("bytes") == 0, F.lit("-")).otherwise(F.col("bytes").cast("string")).alias("Size"),
        F.col("referrer").alias("Referer"), F.col("user_agent").alias("UA"),
        F.col("user").alias("UserName"), F.col("line_id").cast("string").alias("line_id"))


def csv_text_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aliased frame written as RFC 4180 text, with quotes, commas and edge
    spaces in every third agent, and parsed again with the reader's options."""
    frame = aliased_csv_frame(spark, sf_dir)
    agent = F.when(F.col("line_id").cast("bigint") % 3 == 0,
                   F.concat(F.lit(' "'), F.col("UA"), F.lit('", like Gecko '))).otherwise(F.col("UA"))
    frame = frame.withColumn("UA", agent)
    text = frame.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in frame.columns]), CSV_TEXT).alias("text"))
    schema = ", ".join(f"`{c}` string" for c in frame.columns)
    return text.select(F.from_csv("text", schema, CSV_TEXT).alias("row")).select("row.*")


def forest_summary(forest: DataFrame) -> DataFrame:
    """IPs, flagged IPs, and rows whose flag disagrees with ``raw_score``."""
    return forest.agg(F.count(F.lit(1)).alias("n_ips"), F.count_if("is_anomaly").alias("n_flagged"),
                      F.count_if(F.col("is_anomaly") != (F.col("raw_score") == -1)).alias("n_disagree"))


def _register_more(q: dict[str, Query]) -> None:
    q["parse_raw_lines"] = lambda s, d: iso_temporal(parse_lines(rendered_lines(s, d)).select(*BASE_COLUMNS))
    q["parse_quality"] = lambda s, d: parse_quality(quality_lines(s, d))
    q["csv_alias_ingest"] = lambda s, d: iso_temporal(map_and_cast(aliased_csv_frame(s, d)))
    q["csv_text_ingest"] = lambda s, d: iso_temporal(map_and_cast(csv_text_frame(s, d)))
    q["column_mapping"] = lambda s, d: profile.column_mapping(aliased_csv_frame(s, d))
    q["error_heatmap"] = lambda s, d: chart_data.error_heatmap(_featured(s, d))
    q["bot_vs_human"] = lambda s, d: chart_data.bot_vs_human(_featured(s, d))
    q["auth_failure_timeline"] = lambda s, d: iso_temporal(chart_data.auth_failure_timeline(_featured(s, d)))
    q["anomaly_points"] = lambda s, d: iso_temporal(round_stats(chart_data.anomaly_points(
        detectors.traffic_anomalies(_featured(s, d), z_threshold=2.0))))
    q["column_profile"] = lambda s, d: profile.column_profile(_featured(s, d))
    # Not SQL-expressible (random trees): checked by row count here and by
    # property tests in tests/test_charts_profile_forest.py.
    q["isolation_forest"] = lambda s, d: isolation_forest.isolation_forest(_featured(s, d))
    q["isolation_forest_summary"] = lambda s, d: forest_summary(isolation_forest.isolation_forest(_featured(s, d)))
    q |= file_queries(rendered_lines, quality_lines, aliased_csv_frame, _featured, iso_temporal)
