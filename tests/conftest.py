import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from logtide.session import build_session, ensure_checkpoint_dir  # noqa: E402
from logtide.sources.access_view import BASE_COLUMNS  # noqa: E402

SCHEMA = ("ip string, user string, timestamp timestamp, method string, path string, protocol string, "
          "status smallint, bytes bigint, referrer string, user_agent string")

BASE_TS = dt.datetime(2024, 1, 15, 8, 0, 0)


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", shuffle_partitions=4)
    ensure_checkpoint_dir(s)
    yield s


def make_log(spark, rows):
    """Typed log from dicts; defaults follow the reference's fixture builder:
    ip 192.168.1.1, GET /index.html HTTP/1.1, 200, 1024 bytes, Mozilla/5.0,
    30 s between rows from 2024-01-15 08:00:00 UTC."""
    full = []
    for i, r in enumerate(rows):
        d = {"ip": "192.168.1.1", "user": None, "timestamp": BASE_TS + dt.timedelta(seconds=30 * i),
             "method": "GET", "path": "/index.html", "protocol": "HTTP/1.1", "status": 200,
             "bytes": 1024, "referrer": None, "user_agent": "Mozilla/5.0"}
        d.update(r)
        full.append(tuple(d[c] for c in BASE_COLUMNS))
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture()
def mixed_traffic(spark):
    """Nine rows: two 200, a 404 and a 500, two 200 from bots, three 401."""
    rows = [
        {"ip": "10.0.0.1"}, {"ip": "10.0.0.1"},
        {"ip": "10.0.0.2", "status": 404, "path": "/missing"},
        {"ip": "10.0.0.2", "status": 500, "path": "/api"},
        {"ip": "10.0.0.3", "user_agent": "Googlebot/2.1"},
        {"ip": "10.0.0.3", "user_agent": "python-requests/2.28"},
        {"ip": "10.0.0.4", "status": 401, "path": "/login"},
        {"ip": "10.0.0.4", "status": 401, "path": "/login"},
        {"ip": "10.0.0.4", "status": 401, "path": "/login"},
    ]
    return make_log(spark, rows)
