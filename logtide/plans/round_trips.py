"""Registered queries that go through files, sinks, jobs and streams.

Each writes what Spark derives from the given tables into a new folder under
``spark.checkpoint.dir`` and returns what the source, sink, job or stream
under test makes of it, so that the SQL of the plain query holds for both.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.csv_text import CSV_TEXT
from ..operators import clients, isolation_forest, rollup
from ..session import ensure_checkpoint_dir
from ..sinks.writers import write_csv, write_parquet
from ..sources.access_view import BASE_COLUMNS
from ..sources.load import load_access_log, read_parquet_log
from ..sources.raw_log import batch_parse_readable
from ..streaming import alerts, live
from .report import run_report


def scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _gzip_files(spark: SparkSession, lines: DataFrame) -> str:
    """A folder of gzip logs, one a task."""
    folder = scratch(spark, "logs")
    lines.select("value").write.option("compression", "gzip").text(folder)
    return folder


def batch_ingest(spark: SparkSession, lines: DataFrame) -> DataFrame:
    table, _ = batch_parse_readable(spark, _gzip_files(spark, lines), "*.gz")
    return table


def csv_split_ingest(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """The aliased frame with line breaks, quotes and commas in every third
    agent, written as CSV and read by records that tasks cut from its lines."""
    agent = F.when(F.col("line_id").cast("bigint") % 3 == 0, F.concat(F.lit('two\n"lines", '), F.col("UA"), F.lit("\n")))
    folder = scratch(spark, "frame") + ".csv"
    frame.withColumn("UA", agent.otherwise(F.col("UA"))).write.options(**CSV_TEXT).option("header", "true").csv(folder)
    return load_access_log(spark, folder, features=False, multi_line="split")


def parquet_round_trip(spark: SparkSession, featured: DataFrame) -> DataFrame:
    folder = scratch(spark, "table") + ".parquet"
    write_parquet(featured, folder, partition_by="date")
    return load_access_log(spark, folder, features=False)


def csv_sink(spark: SparkSession, featured: DataFrame) -> DataFrame:
    result, folder = clients.top_ips(featured, n=15), scratch(spark, "top-ips")
    write_csv(result, folder)
    return spark.read.options(**CSV_TEXT).option("header", "true").schema(result.schema).csv(folder)


def report_job(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """The brute-force result of the report job over gzip logs."""
    written = run_report(spark, _gzip_files(spark, lines), scratch(spark, "report"), ("brute_force",),
                         {"window_minutes": 60, "threshold": 5}, pattern="*.gz", fmt="parquet")
    return spark.read.parquet(written["_bruteforce"])


def report_quality(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Line counts that the report job's ingest took on its way."""
    written = run_report(spark, _gzip_files(spark, lines), scratch(spark, "report"), ("quality",), pattern="*.gz", fmt="parquet")
    return spark.read.parquet(written["_parse_quality"])


def _streamed(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What a stream over all files that are there writes until it has read them."""
    folder = scratch(spark, name)
    query = live.start_stream(stream, f"{name}-{uuid.uuid4().hex}", folder, trigger={"availableNow": True},
                              checkpoint_location=f"{folder}-progress")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)


def stream_ingest(spark: SparkSession, lines: DataFrame) -> DataFrame:
    return _streamed(spark, live.stream_access_log(spark, _gzip_files(spark, lines)), "stream-ingest")


def stream_hourly(spark: SparkSession, lines: DataFrame) -> DataFrame:
    parsed = live.stream_access_log(spark, _gzip_files(spark, lines))
    return _streamed(spark, live.stream_hourly_traffic(parsed), "stream-hourly")


def stream_alerts(spark: SparkSession, lines: DataFrame) -> DataFrame:
    parsed = live.stream_access_log(spark, _gzip_files(spark, lines))
    return _streamed(spark, live.stream_brute_force(parsed, window_minutes=60, threshold=5), "stream-alerts")


def stream_keyed_alerts(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """The same alerts by keyed state, in a session beside the caller's whose state store is RocksDB."""
    folder = _gzip_files(spark, lines)
    beside = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        beside.conf.set(name, spark.conf.get(name))
    beside.conf.set(alerts.PROVIDER, alerts.ROCKSDB)
    found = alerts.stream_alerts(live.stream_access_log(beside, folder), window_minutes=60, threshold=5)
    return _streamed(beside, found, "stream-keyed-alerts")


def small_model() -> dict:
    """Two trees that SQL can state: requests up to 60 or more; bots up to a
    third or more, and then errors up to a fifth or more."""
    model = {k: np.zeros((2, 5), dtype=float if k in ("threshold", "leaf_depth") else np.int32)
             for k in isolation_forest.NODE_VALUES}
    model["feature"][:] = -1
    for tree, node, feature, threshold, left in ((0, 0, 0, 60.0, 1), (1, 0, 3, 1 / 3, 1), (1, 1, 1, 0.2, 3)):
        model["feature"][tree, node], model["threshold"][tree, node] = feature, threshold
        model["left_child"][tree, node], model["right_child"][tree, node] = left, left + 1
    for tree, node, depth in ((0, 1, 6.0), (0, 2, 2.0), (1, 2, 3.0), (1, 3, 8.0), (1, 4, 4.0)):
        model["leaf_depth"][tree, node] = depth
    return model | {"psi": 256, "n": 1000, "max_depth": 8, "offset": -0.6, "contamination": 0.05, "seed": 42}


def forest_model(spark: SparkSession, featured: DataFrame) -> DataFrame:
    """Scores by a model that was written and loaded again."""
    folder = scratch(spark, "model")
    isolation_forest.save_model(spark, small_model(), folder)
    scored = isolation_forest.score_log(featured, isolation_forest.load_model(spark, folder))
    return scored.select("ip", "raw_score", "decision_score", "is_anomaly")


def weekly_rollup(spark: SparkSession, featured: DataFrame) -> DataFrame:
    """Weeks summed up from the stored daily rollup; ``ips_close`` tells whether
    the estimated number of IPs is within 3% of the exact one."""
    folder = scratch(spark, "rollup")
    write_parquet(rollup.daily_rollup(featured), folder)
    week = F.date_format(F.date_trunc("week", "date"), "yyyy-MM-dd")
    weeks = rollup.summarize_rollup(read_parquet_log(spark, folder), {"week": week})
    exact = featured.groupBy(week.alias("week")).agg(F.countDistinct("ip").alias("exact"))
    return (weeks.join(exact, "week").withColumn("ips_close", F.abs(F.col("unique_ips") - F.col("exact")) <= 0.03 * F.col("exact"))
            .drop("unique_ips", "exact"))


def stored_ip_days(spark: SparkSession, featured: DataFrame) -> DataFrame:
    """The daily per-IP rollup, stored in two steps of which the second repeats days."""
    folder, daily = scratch(spark, "ip-days"), rollup.daily_ip_rollup(featured)
    odd = F.dayofmonth("date") % 2 == 1
    rollup.store_days(daily.where(odd | (F.dayofmonth("date") < 10)), folder)
    rollup.store_days(daily.where(~odd), folder)
    return read_parquet_log(spark, folder)


def file_queries(rendered, quality, frame, featured, iso_temporal) -> dict:
    """Query name -> (spark, sf_dir) -> DataFrame; the arguments make the inputs."""
    base = lambda df: iso_temporal(df.select(*BASE_COLUMNS))
    return {
        "batch_file_ingest": lambda s, d: base(batch_ingest(s, rendered(s, d))),
        "csv_split_ingest": lambda s, d: iso_temporal(csv_split_ingest(s, frame(s, d))),
        "parquet_round_trip": lambda s, d: iso_temporal(parquet_round_trip(s, featured(s, d))),
        "csv_sink": lambda s, d: csv_sink(s, featured(s, d)),
        "report_job": lambda s, d: iso_temporal(report_job(s, rendered(s, d))),
        "report_quality": lambda s, d: report_quality(s, quality(s, d)),
        "stream_ingest": lambda s, d: base(stream_ingest(s, rendered(s, d))),
        "stream_hourly_traffic": lambda s, d: iso_temporal(stream_hourly(s, rendered(s, d))),
        "stream_brute_force": lambda s, d: iso_temporal(stream_alerts(s, rendered(s, d))),
        "stream_keyed_alerts": lambda s, d: iso_temporal(stream_keyed_alerts(s, rendered(s, d))),
        "forest_model_scores": lambda s, d: forest_model(s, featured(s, d)),
        "rollup_top_ips": lambda s, d: rollup.rollup_top_ips(stored_ip_days(s, featured(s, d))),
        "rollup_iqr_outliers": lambda s, d: rollup.rollup_iqr_outliers(stored_ip_days(s, featured(s, d))),
        "weekly_rollup": lambda s, d: weekly_rollup(s, featured(s, d)),
    }
