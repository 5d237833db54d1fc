import datetime as dt
import gzip
import os
import tempfile

import pytest

from logtide.sources.raw_log import batch_parse, parse_lines, parse_log_file, parse_quality, read_log_lines

FULL = ('198.51.100.7 - ada [03/Mar/2021:21:05:09 -0500] "GET /img/logo.svg HTTP/1.0" 200 4711 '
        '"http://shop.example.org/a.html" "Agent/2.5 [fr] (Plan9; R ;x)"')
MINIMAL = '10.0.0.5 - - [15/Jan/2024:08:00:00 +0000] "POST /api/login HTTP/1.1" 401 0'
DASH_BYTES = '10.0.0.6 - - [15/Jan/2024:08:00:00 +0000] "GET /nope HTTP/1.1" 404 -'


def parse(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return [r.asDict() for r in parse_lines(df).collect()]


def scratch():
    return tempfile.mkdtemp(prefix="logtide-test-")


def test_full_line_all_fields(spark):
    (r,) = parse(spark, [FULL])
    assert r["ip"] == "198.51.100.7" and r["user"] == "ada"
    assert r["method"] == "GET" and r["path"] == "/img/logo.svg" and r["protocol"] == "HTTP/1.0"
    assert r["status"] == 200 and r["bytes"] == 4711
    assert r["referrer"] == "http://shop.example.org/a.html"
    assert r["user_agent"] == "Agent/2.5 [fr] (Plan9; R ;x)"
    assert r["timestamp"] == dt.datetime(2021, 3, 4, 2, 5, 9)  # UTC (session zone)


def test_minimal_line_nulls(spark):
    (r,) = parse(spark, [MINIMAL])
    assert r["user"] is None and r["referrer"] is None and r["user_agent"] is None
    assert r["status"] == 401 and r["bytes"] == 0 and r["method"] == "POST"


def test_dash_bytes_is_zero(spark):
    (r,) = parse(spark, [DASH_BYTES])
    assert r["bytes"] == 0 and r["status"] == 404


def test_malformed_and_blank_lines_give_no_rows(spark):
    assert parse(spark, ["some words without any layout", "", "   "]) == []


def test_application_log_is_not_an_access_log(spark):
    lines = ["12:00:01.5 worker-3 WARN queue is long", "12:00:02.0 worker-3 INFO queue is short"]
    assert parse(spark, lines) == []


def test_request_dash(spark):
    (r,) = parse(spark, ['1.2.3.4 - - [15/Jan/2024:08:00:00 +0000] "-" 400 0 "-" "-"'])
    assert r["method"] is None and r["path"] is None and r["protocol"] is None
    assert r["referrer"] is None and r["user_agent"] is None


def test_path_with_space_does_not_match(spark):
    assert parse(spark, ['1.2.3.4 - - [15/Jan/2024:08:00:00 +0000] "GET /a b HTTP/1.1" 200 5']) == []


def test_trailing_text_and_outer_whitespace(spark):
    (r,) = parse(spark, ["  " + FULL + " extra trailing junk \t"])
    assert r["user_agent"].startswith("Agent/2.5")


def test_empty_referrer_stays_empty(spark):
    (r,) = parse(spark, ['1.2.3.4 - - [15/Jan/2024:08:00:00 +0000] "GET / HTTP/1.1" 200 5 "" "UA"'])
    assert r["referrer"] == "" and r["user_agent"] == "UA"


def test_zone_forms_and_one_digit_day(spark):
    lines = ['1.2.3.4 - - [5/Jan/2024:08:00:00 +00:00] "GET / HTTP/1.1" 200 5',
             '1.2.3.4 - - [05/Jan/2024:08:00:00 Z] "GET / HTTP/1.1" 200 5',
             '1.2.3.4 - - [05/jan/2024:09:00:00 +0100] "GET / HTTP/1.1" 200 5']
    rows = parse(spark, lines)
    assert [r["timestamp"] for r in rows] == [dt.datetime(2024, 1, 5, 8, 0, 0)] * 3


def test_bad_timestamp_row_dropped(spark):
    assert parse(spark, ['1.2.3.4 - - [45/Foo/2024:08:00:00 +0000] "GET / HTTP/1.1" 200 5']) == []
    assert parse(spark, ['1.2.3.4 - - [15/Jan/2024:24:00:00 +0000] "GET / HTTP/1.1" 200 5']) == []


def test_one_digit_time_fields_like_strptime(spark):
    (r,) = parse(spark, ['1.2.3.4 - - [5/Jan/2024:3:4:5 -0100] "GET / HTTP/1.1" 200 5'])
    assert r["timestamp"] == dt.datetime(2024, 1, 5, 4, 4, 5)
    (r,) = parse(spark, ['1.2.3.4 - - [ 5/Jan/2024:08:00:00 +0000] "GET / HTTP/1.1" 200 5'])
    assert r["timestamp"] == dt.datetime(2024, 1, 5, 8, 0, 0)
    assert parse(spark, ['1.2.3.4 - - [  5/Jan/2024:08:00:00 +0000] "GET / HTTP/1.1" 200 5']) == []


def test_bytes_decimal_and_exponent(spark):
    rows = parse(spark, ['1.2.3.4 - - [15/Jan/2024:08:00:00 +0000] "GET / HTTP/1.1" 200 12.7',
                         '1.2.3.4 - - [15/Jan/2024:08:00:00 +0000] "GET / HTTP/1.1" 200 1e3',
                         '1.2.3.4 - - [15/Jan/2024:08:00:00 +0000] "GET / HTTP/1.1" 200 abc'])
    assert sorted(r["bytes"] for r in rows) == [0, 12, 1000]


def test_invalid_utf8_replaced(spark):
    d = scratch()
    p = os.path.join(d, "bad.log")
    with open(p, "wb") as f:
        f.write(b'1.2.3.4 - - [15/Jan/2024:08:00:00 +0000] "GET /caf\xe9 HTTP/1.1" 200 5\n')
    (r,) = [x.asDict() for x in parse_log_file(spark, p).collect()]
    assert r["path"] == "/caf�"


def test_parse_file_plain_gzip_and_errors(spark):
    d = scratch()
    plain = os.path.join(d, "a.log")
    with open(plain, "w") as f:
        f.write(FULL + "\n\n" + MINIMAL + "\nnot a line\n")
    gz = os.path.join(d, "b.log.gz")
    with gzip.open(gz, "wt") as f:
        f.write(DASH_BYTES + "\n")
    assert parse_log_file(spark, plain).count() == 2
    assert parse_log_file(spark, gz).count() == 1
    with pytest.raises(FileNotFoundError):
        parse_log_file(spark, os.path.join(d, "missing.log"))
    bad = os.path.join(d, "bad.log")
    with open(bad, "w") as f:
        f.write("\n".join(["nope"] * 5) + "\n")
    with pytest.raises(ValueError):
        parse_log_file(spark, bad)


def test_batch_parse_skips_bad_files(spark):
    d = scratch()
    with open(os.path.join(d, "1.log"), "w") as f:
        f.write(FULL + "\n")
    with open(os.path.join(d, "2.log"), "w") as f:
        f.write("garbage\n")
    with open(os.path.join(d, "3.txt"), "w") as f:
        f.write(MINIMAL + "\n")
    assert batch_parse(spark, d, "*.log").count() == 1
    with pytest.raises(FileNotFoundError):
        batch_parse(spark, d, "*.nomatch")


def test_parse_quality_counts(spark):
    d = scratch()
    p = os.path.join(d, "q.log")
    with open(p, "w") as f:
        f.write("\n".join([FULL, "", "junk", MINIMAL,
                           '1.2.3.4 - - [45/Foo/2024:08:00:00 +0000] "GET / HTTP/1.1" 200 5']) + "\n")
    (r,) = parse_quality(read_log_lines(spark, p)).collect()
    assert (r.total_lines, r.parsed_lines, r.failed_lines, r.blank_lines, r.bad_timestamps) == (5, 3, 1, 1, 1)
    assert r.parse_pct == pytest.approx(60.0)


def test_line_with_nul_takes_exact_path(spark):
    nul = '1.2.3.4 - - [15/Jan/2024:08:00:00 +0000] "GET /x HTTP/1.1" 200 5 "r\x00ef" "U\x00A"'
    (r,) = parse(spark, [nul])
    assert r["referrer"] == "r\x00ef" and r["user_agent"] == "U\x00A" and r["path"] == "/x"
    assert parse(spark, ["junk \x00 line"]) == []


def test_parse_plan_evaluates_regex_once(spark):
    df = spark.createDataFrame([(FULL,)], "value string")
    plan = parse_lines(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?s)(?U)^") == 1      # the whole-line pattern is applied once
