"""Fixed values that must equal the reference analyzer's for identical results.

Everything in this module is data, not logic: the access-log line pattern, the
timestamp format, the bot user-agent signature list, the status category labels,
the CSV column alias lists and the defaults for absent CSV columns. Keep them
together, in their natural order, as plain text.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference behaviour exactly)
# ---------------------------------------------------------------------------

# Apache Combined Log Format, ten fields. Java regex syntax; anchored at the
# start only (trailing text after the user agent is allowed). Groups:
#  1 ip, 2 user, 3 timestamp, 4 method, 5 path, 6 protocol, 7 status, 8 bytes,
#  9 optional referrer block, 10 referrer, 11 optional agent block, 12 user agent.
ACCESS_LINE_PATTERN = (
    r'^(\S+)\s+'                   # client ip
    r'\S+\s+'                      # ident, ignored
    r'(\S+)\s+'                    # auth user
    r'\[([^\]]+)\]\s+'             # [timestamp]
    r'"([A-Z]+|-)?\s*'             # method or -
    r'(\S+)?\s*'                   # path
    r'(HTTP/[\d.]+)?"\s*'          # protocol
    r'(\d{3})\s+'                  # status, three digits
    r'(\S+)'                       # bytes or -
    r'(\s+"([^"]*)")?'             # optional "referrer"
    r'(\s+"([^"]*)")?'             # optional "user agent"
)

# strptime "%d/%b/%Y:%H:%M:%S %z" expressed as Spark datetime patterns; like
# strptime, day, hour, minute and second take one or two digits, and the zone
# may be written +0000, +00:00 or Z.
ACCESS_TIME_FORMATS = ("d/MMM/yyyy:H:m:s Z", "d/MMM/yyyy:H:m:s XXX")

# Case-insensitive substring signatures of automated clients.
BOT_SIGNATURES = (
    "bot", "crawler", "spider", "scraper", "python-requests", "curl", "wget",
    "Go-http", "libwww", "Scrapy", "Googlebot", "Bingbot", "DotBot", "AhrefsBot",
    "SemrushBot", "MJ12bot", "facebookexternalhit",
)

# Status category labels (the first bucket also receives 1xx, the last 6xx+).
CATEGORY_SUCCESS = "Success (2xx)"
CATEGORY_REDIRECT = "Redirect (3xx)"
CATEGORY_CLIENT_ERROR = "Client Error (4xx)"
CATEGORY_SERVER_ERROR = "Server Error (5xx)"

# Monday-first weekday order of the error heatmap.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# Auth failure statuses used by brute-force detection and its timeline.
AUTH_FAILURE_STATUSES = (401, 403)

# CSV header aliases per standard column; list order is match priority.
CSV_COLUMN_ALIASES = {
    "ip": ["ip", "ip_address", "client_ip", "source_ip", "remote_addr",
           "host", "clientip", "remote_host", "src_ip", "c-ip"],
    "timestamp": ["timestamp", "time", "datetime", "date_time", "log_time",
                  "request_time", "date", "@timestamp", "time_stamp", "ts"],
    "method": ["method", "http_method", "request_method", "verb", "cs-method"],
    "path": ["path", "url", "request", "uri", "endpoint", "cs-uri-stem",
             "request_uri", "resource", "page", "cs-uri", "service"],
    "status": ["status", "status_code", "response_code", "http_status",
               "code", "sc-status", "response", "http_code", "statuscode"],
    "bytes": ["bytes", "size", "response_size", "content_length", "bytes_sent",
              "sc-bytes", "body_bytes_sent", "byte_count"],
    "referrer": ["referrer", "referer", "http_referer", "cs-referer"],
    "user_agent": ["user_agent", "useragent", "browser", "agent",
                   "cs-user-agent", "http_user_agent", "ua"],
    "user": ["user", "username", "user_name", "auth_user", "cs-username",
             "remote_user", "login"],
}

# Columns a CSV log must provide after alias mapping.
CSV_REQUIRED_COLUMNS = ("timestamp", "status")

# Values given to standard columns that are absent from a CSV log.
CSV_DEFAULTS = {
    "ip": "unknown",
    "method": "GET",
    "path": "/",
    "user_agent": "unknown",
    "referrer": None,
    "user": None,
    "protocol": "HTTP/1.1",
}

# Bytes cells in a CSV log that mean zero.
CSV_BYTES_AS_ZERO = ("-", "", "None", "null")

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------

# ---------------------------------------------------------------------------
# FIXED VALUES, continued: cell texts that pandas' CSV reader turns into
# missing values by default (public pandas behaviour), nulled the same way here.
# ---------------------------------------------------------------------------
CSV_NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                   "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                   "nan", "null")
