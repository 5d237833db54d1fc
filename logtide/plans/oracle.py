"""DuckDB oracle SQL for the registered queries.

Each statement starts from the same ``access_log`` projection of ``events``
that the Spark side uses, adds the derived columns in SQL, and states the
tie-breaks and half-even rounding explicitly so both engines agree.
"""

from __future__ import annotations

from ..functions.fixed_values import BOT_SIGNATURES
from ..functions.fixed_values import (CATEGORY_CLIENT_ERROR, CATEGORY_REDIRECT, CATEGORY_SERVER_ERROR,
                                      CATEGORY_SUCCESS)
from ..sources.access_view import ACCESS_VIEW_SELECT

_BOT = "(?i)(" + "|".join(BOT_SIGNATURES) + ")"

PREFIX = f"""WITH access_log AS ({ACCESS_VIEW_SELECT}),
feat AS (
  SELECT *, CAST(hour(timestamp) AS INTEGER) AS hour, dayname(timestamp) AS day_of_week, CAST(timestamp AS DATE) AS date,
    status BETWEEN 200 AND 299 AS is_success, status BETWEEN 300 AND 399 AS is_redirect,
    status BETWEEN 400 AND 499 AS is_client_error, status >= 500 AS is_server_error, status >= 400 AS is_error,
    coalesce(regexp_matches(user_agent, '{_BOT}'), false) AS is_bot
  FROM access_log)
"""

CATEGORY = (f"CASE WHEN {{c}} < 300 THEN '{CATEGORY_SUCCESS}' WHEN {{c}} < 400 THEN '{CATEGORY_REDIRECT}' "
            f"WHEN {{c}} < 500 THEN '{CATEGORY_CLIENT_ERROR}' ELSE '{CATEGORY_SERVER_ERROR}' END")


def _q(body: str) -> str:
    return PREFIX + body


def oracle_statements() -> dict[str, str]:
    s: dict[str, str] = {}
    s["features"] = _q("SELECT * EXCLUDE (line_id, date, timestamp), strftime(date, '%Y-%m-%d') AS date, "
                       "strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp FROM feat")
    s["status_distribution"] = _q(f"""
SELECT status AS status_code, count(*) AS count, {CATEGORY.format(c='status')} AS category
FROM feat WHERE status IS NOT NULL GROUP BY status ORDER BY status_code""")
    s["error_summary"] = _q("""
SELECT status, path, count(*) AS count FROM feat
WHERE is_error AND path IS NOT NULL GROUP BY status, path ORDER BY count DESC, status, path""")
    s["top_404_paths"] = _q("""
SELECT path, count(*) AS count FROM feat WHERE status = 404 AND path IS NOT NULL
GROUP BY path ORDER BY count DESC, path LIMIT 10""")
    s["hourly_traffic"] = _q("""
SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M:%S') AS hour_bucket, count(*) AS request_count
FROM feat
GROUP BY hour_bucket ORDER BY hour_bucket""")
    s["daily_traffic"] = _q("""
SELECT strftime(date, '%Y-%m-%d') AS date, count(*) AS request_count FROM feat GROUP BY date ORDER BY date""")
    s["peak_hours"] = _q("""
SELECT hour, count(*) AS avg_requests,
  count(*) / (SELECT count(DISTINCT date) FROM feat) AS avg_per_day
FROM feat GROUP BY hour ORDER BY avg_requests DESC, hour""")
    s["top_ips"] = _q("""
SELECT ip, count(*) AS total_requests, CAST(count_if(is_error) AS BIGINT) AS error_requests, CAST(count_if(is_bot) AS BIGINT) AS bot_requests,
  round_even(CAST(count_if(is_error) AS DOUBLE) / count(*), 4) AS error_rate
FROM feat WHERE ip IS NOT NULL GROUP BY ip ORDER BY total_requests DESC, ip LIMIT 15""")
    s["bandwidth"] = _q("""
SELECT path, CAST(sum(bytes) AS BIGINT) AS total_bytes, avg(bytes) AS avg_bytes, count(bytes) AS request_count,
  round_even(CAST(sum(bytes) AS DOUBLE) / 1048576, 2) AS total_mb
FROM feat WHERE path IS NOT NULL GROUP BY path ORDER BY total_bytes DESC, path LIMIT 15""")
    s["ua_split"] = _q("""
SELECT CASE WHEN is_bot THEN 'Bot' ELSE 'Human' END AS label, count(*) AS count
FROM feat GROUP BY label ORDER BY count DESC, label""")
    s["top_user_agents"] = _q("""
SELECT user_agent, count(*) AS count FROM feat WHERE user_agent IS NOT NULL
GROUP BY user_agent ORDER BY count DESC, user_agent LIMIT 10""")
    s["top_endpoints"] = _q("""
SELECT path, count(*) AS hit_count FROM feat WHERE is_success AND path IS NOT NULL
GROUP BY path ORDER BY hit_count DESC, path LIMIT 10""")
    s["summary_stats"] = _q("""
SELECT count(*) AS total_requests, count(DISTINCT ip) AS unique_ips,
  CAST(floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400000000) AS BIGINT) AS date_range_days,
  avg(CAST(is_error AS INTEGER)) * 100 AS error_rate,
  avg(CAST(is_bot AS INTEGER)) * 100 AS bot_traffic_pct,
  (SELECT CAST(status AS INTEGER) FROM feat WHERE status IS NOT NULL GROUP BY status
     ORDER BY count(*) DESC, status LIMIT 1) AS top_status,
  sum(bytes) / 1073741824 AS total_bytes_gb,
  CAST(count_if(is_server_error) AS BIGINT) AS server_errors
FROM feat""")
    s["summary_report"] = _q("""
SELECT count(*) AS total_requests, count(DISTINCT ip) AS unique_ips,
  CAST(floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400000000) AS BIGINT) AS date_range_days,
  printf('%.2f%%', round_even(avg(CAST(is_error AS INTEGER)) * 100, 2)) AS error_rate,
  printf('%.2f%%', round_even(avg(CAST(is_bot AS INTEGER)) * 100, 2)) AS bot_traffic_pct,
  (SELECT CAST(status AS INTEGER) FROM feat WHERE status IS NOT NULL GROUP BY status
     ORDER BY count(*) DESC, status LIMIT 1) AS top_status,
  printf('%.3f GB', round_even(sum(bytes) / 1073741824, 3)) AS total_bytes_gb,
  CAST(count_if(is_server_error) AS BIGINT) AS server_errors
FROM feat""")
    s["feature_rates"] = _q("""
SELECT count(*) AS rows, avg(CAST(is_error AS INTEGER)) * 100 AS error_pct,
  avg(CAST(is_bot AS INTEGER)) * 100 AS bot_pct FROM feat""")
    s["zscore_anomalies"] = _q(ZSCORE_CTE.format(z=2.0) + """
SELECT strftime(date, '%Y-%m-%d') AS date, hour, ip, request_count, round_even(window_mean, 9) AS window_mean,
  round_even(window_std, 9) AS window_std, round_even(z_score, 9) AS z_score
FROM scored ORDER BY z_score DESC, date, hour, ip""")
    s["brute_force"] = _q("""
, fails AS (SELECT ip, timestamp, path, CAST(floor(epoch_us(timestamp) / 1000000) AS BIGINT) AS ts_epoch
  FROM feat WHERE status IN (401, 403) AND ip IS NOT NULL),
cnt AS (SELECT *, count(*) OVER (PARTITION BY ip ORDER BY ts_epoch
  RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS failures_in_window FROM fails),
hit AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts_epoch, timestamp, path NULLS FIRST) AS rn
  FROM cnt WHERE failures_in_window >= 5)
SELECT ip, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS window_end, failures_in_window, path AS example_path,
  60 AS window_minutes
FROM hit WHERE rn = 1 ORDER BY failures_in_window DESC, ip""")
    s["iqr_outliers"] = _q("""
, c AS (SELECT ip, count(*) AS total_requests FROM feat WHERE ip IS NOT NULL GROUP BY ip),
f AS (SELECT quantile_cont(CAST(total_requests AS DOUBLE), 0.75)
        + 1.5 * (quantile_cont(CAST(total_requests AS DOUBLE), 0.75)
                 - quantile_cont(CAST(total_requests AS DOUBLE), 0.25)) AS fence FROM c)
SELECT ip, total_requests, round_even(fence, 2) AS upper_fence, round_even(total_requests - fence, 2) AS excess
FROM c JOIN f ON total_requests > fence ORDER BY total_requests DESC, ip""")
    s["ip_features"] = _q(IP_FEATURES_CTE + """
SELECT ip, total_requests, round_even(error_rate, 9) AS error_rate, round_even(avg_bytes, 9) AS avg_bytes,
  round_even(bot_rate, 9) AS bot_rate, unique_paths, round_even(status_std, 9) AS status_std,
  round_even(p95_request_gap, 9) AS p95_request_gap FROM ipf""")
    _more(s)
    _through_files(s)
    return s


def _through_files(s: dict[str, str]) -> None:
    """What the sources, sinks, jobs and streams give is what the plain queries give."""
    s["batch_file_ingest"] = s["stream_ingest"] = s["parse_raw_lines"]
    s["parquet_round_trip"], s["csv_sink"] = s["features"], s["top_ips"]
    s["report_job"] = s["stream_brute_force"] = s["stream_keyed_alerts"] = s["brute_force"]
    s["rollup_top_ips"], s["rollup_iqr_outliers"] = s["top_ips"], s["iqr_outliers"]
    s["csv_split_ingest"] = s["csv_text_ingest"].replace("""' "' || user_agent || '", like Gecko '""", """'two' || chr(10) || '"lines", ' || user_agent || chr(10)""")
    s["report_quality"] = f"""
SELECT CAST(sum(total_lines) AS BIGINT) AS total_lines, CAST(sum(parsed_lines) AS BIGINT) AS parsed_lines,
  CAST(sum(failed_lines) AS BIGINT) AS failed_lines, CAST(sum(blank_lines) AS BIGINT) AS blank_lines,
  CAST(sum(bad_timestamps) AS BIGINT) AS bad_timestamps, sum(parsed_lines) / sum(total_lines) * 100 AS parse_pct
FROM ({s["parse_quality"]}) q"""
    # Windows that end no later than an hour before the newest row.
    s["stream_hourly_traffic"] = _q("""
SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M:%S') AS hour_bucket, count(*) AS request_count
FROM feat WHERE date_trunc('hour', timestamp) + INTERVAL 1 HOUR <= (SELECT max(timestamp) FROM feat) - INTERVAL 1 HOUR
GROUP BY hour_bucket ORDER BY hour_bucket""")
    s["forest_model_scores"] = _q(IP_FEATURES_CTE + """
, depths AS (SELECT ip, (CASE WHEN total_requests <= 60 THEN 6.0::DOUBLE ELSE 2.0::DOUBLE END
    + CASE WHEN bot_rate > 1::DOUBLE / 3::DOUBLE THEN 3.0::DOUBLE WHEN error_rate <= 0.2::DOUBLE THEN 8.0::DOUBLE ELSE 4.0::DOUBLE END) / 2
    AS depth FROM ipf),
scores AS (SELECT ip, 0.6::DOUBLE - pow(2::DOUBLE, -depth / (2 * (ln(255::DOUBLE) + 0.5772156649::DOUBLE) - 2 * 255::DOUBLE / 256)) AS decision
           FROM depths)
SELECT ip, CAST(CASE WHEN decision < 0 THEN -1 ELSE 1 END AS INTEGER) AS raw_score, round_even(decision, 4) AS decision_score,
  decision < 0 AS is_anomaly FROM scores""")
    s["weekly_rollup"] = _q("""
, weeks AS (SELECT *, strftime(date_trunc('week', date), '%Y-%m-%d') AS week FROM feat),
top AS (SELECT week, status FROM weeks WHERE status IS NOT NULL GROUP BY week, status
        QUALIFY row_number() OVER (PARTITION BY week ORDER BY count(*) DESC, status) = 1)
SELECT week, count(*) AS total_requests,
  CAST(floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400000000) AS BIGINT) AS date_range_days,
  avg(CAST(is_error AS INTEGER)) * 100 AS error_rate, avg(CAST(is_bot AS INTEGER)) * 100 AS bot_traffic_pct,
  (SELECT CAST(status AS INTEGER) FROM top WHERE top.week = weeks.week) AS top_status,
  sum(bytes) / 1073741824 AS total_bytes_gb, CAST(count_if(is_server_error) AS BIGINT) AS server_errors, true AS ips_close
FROM weeks GROUP BY week ORDER BY week""")


FEATURE_TYPES = [("ip", "string"), ("user", "string"), ("timestamp", "timestamp"), ("method", "string"),
                 ("path", "string"), ("protocol", "string"), ("status", "smallint"), ("bytes", "bigint"),
                 ("referrer", "string"), ("user_agent", "string"), ("hour", "int"), ("day_of_week", "string"),
                 ("date", "date"), ("is_success", "boolean"), ("is_redirect", "boolean"),
                 ("is_client_error", "boolean"), ("is_server_error", "boolean"), ("is_error", "boolean"),
                 ("is_bot", "boolean")]

WEEKDAY_CASE = ("CASE day_of_week WHEN 'Monday' THEN 1 WHEN 'Tuesday' THEN 2 WHEN 'Wednesday' THEN 3 "
                "WHEN 'Thursday' THEN 4 WHEN 'Friday' THEN 5 WHEN 'Saturday' THEN 6 WHEN 'Sunday' THEN 7 END")


def _more(s: dict[str, str]) -> None:
    base = ("ip, user, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, method, path, protocol, status, "
            "bytes, referrer, user_agent")
    s["parse_raw_lines"] = _q(f"SELECT {base} FROM access_log")
    s["parse_quality"] = _q("""
SELECT 'access-' || strftime(timestamp, '%Y-%m-%d') AS source,
  CAST(count(*) + count_if(line_id % 50 = 0) + count_if(line_id % 70 = 0) + count_if(line_id % 90 = 0) AS BIGINT)
    AS total_lines,
  CAST(count(*) + count_if(line_id % 90 = 0) AS BIGINT) AS parsed_lines,
  CAST(count_if(line_id % 70 = 0) AS BIGINT) AS failed_lines,
  CAST(count_if(line_id % 50 = 0) AS BIGINT) AS blank_lines,
  CAST(count_if(line_id % 90 = 0) AS BIGINT) AS bad_timestamps,
  CAST(count(*) + count_if(line_id % 90 = 0) AS DOUBLE)
    / (count(*) + count_if(line_id % 50 = 0) + count_if(line_id % 70 = 0) + count_if(line_id % 90 = 0)) * 100.0
    AS parse_pct
FROM access_log GROUP BY source ORDER BY source""")
    s["csv_alias_ingest"] = _q("""
SELECT ip, user, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, method, path, 'HTTP/1.1' AS protocol,
  status, bytes,
  NULLIF(referrer, '') AS referrer, user_agent, CAST(line_id AS VARCHAR) AS line_id FROM access_log""")
    s["csv_text_ingest"] = _q("""
SELECT ip, user, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, method, path, 'HTTP/1.1' AS protocol,
  status, bytes, NULLIF(referrer, '') AS referrer,
  CASE WHEN line_id % 3 = 0 THEN ' "' || user_agent || '", like Gecko ' ELSE user_agent END AS user_agent,
  CAST(line_id AS VARCHAR) AS line_id FROM access_log""")
    # Scores that don't tie at the rank: the flagged are those below the interpolated quantile.
    s["isolation_forest_summary"] = _q("""
SELECT count(DISTINCT ip) AS n_ips, CAST(ceil(0.05 * (count(DISTINCT ip) - 1)) AS BIGINT) AS n_flagged,
  CAST(0 AS BIGINT) AS n_disagree FROM access_log""")
    s["column_mapping"] = _q("""
SELECT * FROM (VALUES
  (0, 'ip', 'detected', 'Client_IP', (SELECT min(ip) FROM access_log)),
  (1, 'timestamp', 'detected', ' Time ',
     (SELECT strftime(min(timestamp), '%Y-%m-%dT%H:%M:%SZ') FROM access_log)),
  (2, 'method', 'detected', 'Verb', (SELECT min(method) FROM access_log)),
  (3, 'path', 'detected', 'URL', (SELECT min(path) FROM access_log)),
  (4, 'status', 'detected', 'Status_Code', (SELECT min(CAST(status AS VARCHAR)) FROM access_log)),
  (5, 'bytes', 'detected', 'Size',
     (SELECT min(CASE WHEN bytes = 0 THEN '-' ELSE CAST(bytes AS VARCHAR) END) FROM access_log)),
  (6, 'referrer', 'detected', 'Referer', (SELECT min(referrer) FROM access_log)),
  (7, 'user_agent', 'detected', 'UA', (SELECT min(user_agent) FROM access_log)),
  (8, 'user', 'detected', 'UserName', (SELECT min(user) FROM access_log))
) AS t(position, standard_name, status, source_column, sample)""")
    s["error_heatmap"] = _q(f"""
, cells AS (SELECT day_of_week, hour, avg(CAST(is_error AS DOUBLE)) AS cell_rate FROM feat
  GROUP BY day_of_week, hour),
grid AS (SELECT d.day_of_week, h.hour FROM (SELECT DISTINCT day_of_week FROM cells) d
  CROSS JOIN (SELECT DISTINCT hour FROM cells) h)
SELECT g.day_of_week, CAST({WEEKDAY_CASE.replace('day_of_week', 'g.day_of_week')} AS INTEGER) AS day_index, g.hour,
  coalesce(c.cell_rate, 0.0) AS error_rate
FROM grid g LEFT JOIN cells c ON g.day_of_week = c.day_of_week AND g.hour = c.hour
ORDER BY day_index, hour""")
    s["bot_vs_human"] = _q("""
SELECT 'Human Traffic' AS label, CAST(count_if(NOT is_bot) AS BIGINT) AS count FROM feat
UNION ALL SELECT 'Bot Traffic' AS label, CAST(count_if(is_bot) AS BIGINT) AS count FROM feat""")
    s["auth_failure_timeline"] = _q("""
, fails AS (SELECT * FROM feat WHERE status IN (401, 403) AND ip IS NOT NULL),
top AS (SELECT ip FROM fails GROUP BY ip ORDER BY count(*) DESC, ip LIMIT 5)
SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M:%S') AS hour_bucket, ip, count(*) AS failures
FROM fails WHERE ip IN (SELECT ip FROM top) GROUP BY hour_bucket, ip ORDER BY hour_bucket, ip""")
    s["anomaly_points"] = _q(ZSCORE_CTE.format(z=2.0) + """
SELECT strftime(date, '%Y-%m-%d') AS date, hour, ip, request_count, round_even(window_mean, 9) AS window_mean,
  round_even(window_std, 9) AS window_std, round_even(z_score, 9) AS z_score,
  strftime(CAST(date AS TIMESTAMP) + hour * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS ts
FROM scored ORDER BY z_score DESC, date, hour, ip""")
    parts = []
    for i, (c, t) in enumerate(FEATURE_TYPES):
        parts.append(f"SELECT {i} AS position, '{c}' AS column, '{t}' AS dtype, count(\"{c}\") AS non_null, "
                     f"round_even(CAST(count(*) - count(\"{c}\") AS DOUBLE) / count(*) * 100, 1) AS null_pct, "
                     f"CAST(min(\"{c}\") AS VARCHAR) AS sample FROM feat")
    s["column_profile"] = _q("\nUNION ALL\n".join(parts))


ZSCORE_CTE = """
, counts AS (SELECT date, hour, ip, count(*) AS request_count FROM feat WHERE ip IS NOT NULL
  GROUP BY date, hour, ip),
stats AS (SELECT date, hour, avg(request_count) AS window_mean,
  greatest(coalesce(stddev_samp(request_count), 1.0), 1.0) AS window_std FROM counts GROUP BY date, hour),
scored AS (SELECT c.date, c.hour, c.ip, c.request_count, s.window_mean, s.window_std,
  round_even((c.request_count - s.window_mean) / s.window_std, 3) AS z_score
  FROM counts c JOIN stats s ON c.date = s.date AND c.hour = s.hour
  WHERE round_even((c.request_count - s.window_mean) / s.window_std, 3) >= {z})
"""

IP_FEATURES_CTE = """
, g AS (SELECT ip, status, bytes, path, is_error, is_bot,
  (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY ip ORDER BY timestamp))) / 1e6 AS gap
  FROM feat WHERE ip IS NOT NULL),
ipf AS (SELECT ip, count(*) AS total_requests,
  coalesce(avg(CAST(is_error AS DOUBLE)), 0) AS error_rate, coalesce(avg(bytes), 0) AS avg_bytes,
  coalesce(avg(CAST(is_bot AS DOUBLE)), 0) AS bot_rate, count(DISTINCT path) AS unique_paths,
  coalesce(stddev_samp(status), 0) AS status_std, coalesce(quantile_cont(gap, 0.95), 0) AS p95_request_gap
  FROM g GROUP BY ip)
"""
