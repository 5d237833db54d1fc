"""Property tests (hypothesis): each example is one Spark job, so examples are few."""

import datetime as dt

import numpy as np
import pandas as pd
from conftest import BASE_TS, make_log
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from logtide.functions.features import add_features
from logtide.functions.stats import exact_stddev_samp
from logtide.operators import detectors
from logtide.sources.access_view import BASE_COLUMNS, render_lines
from logtide.sources.raw_log import parse_lines
from test_detectors import brute_reference

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

token = st.text(alphabet=st.characters(min_codepoint=33, max_codepoint=126, exclude_characters='"'),
                min_size=1, max_size=12)
free_text = st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=126, exclude_characters='"'),
                    max_size=20)


@st.composite
def log_rows(draw):
    n = draw(st.integers(1, 25))
    rows = []
    for _ in range(n):
        has_path = draw(st.booleans())
        rows.append({
            "ip": draw(token), "user": draw(st.one_of(st.none(), token.filter(lambda t: t != "-"))),
            "timestamp": BASE_TS + dt.timedelta(seconds=draw(st.integers(0, 10**7))),
            "method": draw(st.sampled_from(["GET", "POST", "PUT"])) if has_path else None,
            "path": "/" + draw(token) if has_path else None,
            "protocol": draw(st.sampled_from(["HTTP/1.0", "HTTP/1.1", "HTTP/2.0"])) if has_path else None,
            "status": draw(st.integers(100, 999)), "bytes": draw(st.integers(0, 10**9)),
            "referrer": draw(st.one_of(st.none(), free_text.filter(lambda t: t != "-"))),
            "user_agent": draw(st.one_of(st.none(), free_text.filter(lambda t: t != "-"))),
        })
    return rows


@SLOW
@given(rows=log_rows())
def test_render_then_parse_is_lossless(spark, rows):
    df = make_log(spark, rows)
    back = parse_lines(render_lines(df)).select(*BASE_COLUMNS)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(map(key, back.collect())) == sorted(map(key, df.collect()))


@st.composite
def failures(draw):
    n = draw(st.integers(5, 120))
    secs = sorted(draw(st.lists(st.integers(0, 3000), min_size=n, max_size=n)))
    return [{"ip": f"ip{draw(st.integers(0, 3))}", "status": draw(st.sampled_from([401, 403, 200])),
             "timestamp": BASE_TS + dt.timedelta(seconds=s), "path": draw(st.sampled_from(["/a", "/b", None]))}
            for s in secs]


@SLOW
@given(rows=failures(), threshold=st.integers(2, 8), bucket=st.sampled_from([300, 700, 86400]))
def test_brute_force_equals_quadratic_reference_for_any_bucket(spark, rows, threshold, bucket):
    df = add_features(make_log(spark, rows))
    got = {r.ip: (int(r.window_end.replace(tzinfo=dt.timezone.utc).timestamp()), r.failures_in_window)
           for r in detectors.brute_force(df, window_minutes=5, threshold=threshold,
                                          bucket_seconds=bucket).collect()}
    pdf = pd.DataFrame(rows)
    pdf["timestamp"] = pd.to_datetime(pdf.timestamp).dt.tz_localize("UTC")
    assert got == brute_reference(pdf, 300, threshold)


@SLOW
@given(values=st.lists(st.integers(-1000, 1000), min_size=2, max_size=60), parts=st.integers(1, 7))
def test_exact_std_matches_numpy_for_any_partitioning(spark, values, parts):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(v,) for v in values], "x int").repartition(parts)
    got = df.agg(exact_stddev_samp(F.col("x"))).first()[0]
    assert abs(got - float(np.std(values, ddof=1))) <= 1e-9 * max(1.0, float(np.std(values, ddof=1)))
