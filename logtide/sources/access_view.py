"""``access_log`` view derived from the driver's ``events`` table.

The driver tables hold no access log, so every registered query reads this
projection of ``events``. The SQL text is shared with the DuckDB oracle so both
engines see the same rows. It is a single narrow projection over the Parquet
scan (no shuffle); Catalyst prunes ``props`` and pushes predicates of the
queries above it into the scan where the columns map through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import require_utc

ACCESS_VIEW_SELECT = """
SELECT event_id AS line_id,
  CASE WHEN hour(ts) IN (3, 4) AND event_id % 2 = 0 THEN '203.0.113.' || CAST(day(ts) % 3 AS STRING)
       ELSE '10.0.' || CAST(CAST(FLOOR(user_id / 256.0) AS BIGINT) AS STRING) || '.' || CAST(user_id % 256 AS STRING) END AS ip,
  CASE WHEN event_type = 'purchase' THEN 'u' || CAST(user_id AS STRING) END AS user,
  date_trunc('second', ts) AS timestamp,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_type IN ('purchase','signup') THEN 'POST' ELSE 'GET' END AS method,
  CASE WHEN event_id % 97 = 0 THEN NULL
       WHEN hour(ts) IN (3, 4) AND event_id % 2 = 0 THEN '/login'
       ELSE '/' || event_type || '/' || CAST(user_id % 20 AS STRING) END AS path,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'HTTP/1.1' END AS protocol,
  CAST(CASE WHEN hour(ts) IN (3, 4) AND event_id % 2 = 0 THEN 401
       WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN 403 ELSE 404 END
       WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 302 ELSE 200 END AS SMALLINT) AS status,
  CAST(FLOOR(value * 100) AS BIGINT) AS bytes,
  CASE event_id % 3 WHEN 0 THEN 'http://www.example.com/start.html' WHEN 1 THEN '' END AS referrer,
  CASE event_id % 5 WHEN 0 THEN 'Googlebot/2.1' WHEN 1 THEN 'python-requests/2.28' WHEN 2 THEN NULL ELSE 'Mozilla/5.0' END AS user_agent
FROM events
"""

BASE_COLUMNS = ("ip", "user", "timestamp", "method", "path", "protocol", "status",
                "bytes", "referrer", "user_agent")


def access_log(spark: SparkSession, sf_dir: str, keep_line_id: bool = False) -> DataFrame:
    """The base access-log table (ten typed columns) over ``events``.

    The events DataFrame is bound as a SQL parameter, so no temporary view
    name is registered in the caller's session.
    """
    require_utc(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = spark.sql(ACCESS_VIEW_SELECT.replace("FROM events", "FROM {events}"), events=events)
    return df if keep_line_id else df.drop("line_id")


def render_lines(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Render typed rows back to Apache Combined lines (column ``value``).

    Null user/referrer/agent become ``-``; a null path becomes the request
    ``"-"``; zero bytes become ``-``; the zone is written ``+0000``.
    """
    dash = F.lit("-")
    request = F.when(F.col("path").isNull(), dash).otherwise(
        F.concat_ws(" ", F.coalesce(F.col("method"), dash), F.col("path"), F.col("protocol")))
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(F.col(c), dash), F.lit('"'))
    line = F.concat_ws(
        " ",
        F.col("ip"), dash, F.coalesce(F.col("user"), dash),
        F.concat(F.lit("["), F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000]")),
        F.concat(F.lit('"'), request, F.lit('"')),
        F.col("status").cast("string"),
        F.when(F.col("bytes") == 0, dash).otherwise(F.col("bytes").cast("string")),
        quoted("referrer"), quoted("user_agent"),
    )
    return df.select(*keep, line.alias("value"))
