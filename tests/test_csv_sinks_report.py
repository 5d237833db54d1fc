import datetime as dt
import glob
import os
import tempfile

import pandas as pd
import pytest
from conftest import make_log

from logtide.functions.features import add_features
from logtide.plans.report import run_report
from logtide.sinks.writers import write_csv, write_parquet
from logtide.sources.access_view import render_lines
from logtide.sources.csv_log import column_mapping_report, read_csv_log, rename_plan
from logtide.sources.load import load_access_log, read_parquet_log


def scratch():
    return tempfile.mkdtemp(prefix="logtide-test-")


def write_text(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_rename_plan_priorities():
    plan = rename_plan(["Client_IP", " Time ", "Date", "Verb", "URL", "Status_Code", "UA", "other"])
    assert plan == {"Client_IP": "ip", " Time ": "timestamp", "Verb": "method", "URL": "path",
                    "Status_Code": "status", "UA": "user_agent"}
    assert rename_plan(["timestamp", "time", "status"]) == {}
    rows = {r["standard_name"]: r for r in column_mapping_report(["Client_IP", "Time", "Status"])}
    assert rows["ip"]["source_column"] == "Client_IP" and rows["bytes"]["status"] == "default"


def test_csv_ingest_casts_defaults_and_drops(spark):
    d = scratch()
    p = write_text(os.path.join(d, "log.csv"), "\n".join([
        "Client_IP,Time,Verb,URL,Status_Code,Size,UA,extra",
        "1.1.1.1,2024-01-15T08:00:00Z,GET,/a,200,-,Mozilla,x",
        "1.1.1.2,2024-01-15 09:30:00,POST,/b,404,12.7,NA,y",
        "1.1.1.3,not a time,GET,/c,200,5,UA,z",
        "1.1.1.4,2024-01-15T10:00:00+01:00,GET,/d,abc,5,UA,z",
        "1.1.1.5,2024-01-15T11:00:00Z,GET,/e,200.5,5,UA,z",
        "1.1.1.6,1705305600,GET,/f,200,5,UA,z",
        "1.1.1.7,2024-01-15T12:00:00Z,GET,/g,500.0,null,UA,w",
        "1.1.1.8,2024-01-15T12:00:00Z,GET,/h,200,,UA,w",
        "1.1.1.9,2024-01-15T12:00:00Z,GET,/i,200,None,UA,w",
    ]) + "\n")
    rows = [r.asDict() for r in read_csv_log(spark, p).orderBy("ip").collect()]
    assert [r["ip"] for r in rows] == ["1.1.1.1", "1.1.1.2", "1.1.1.7", "1.1.1.8", "1.1.1.9"]
    a, b, g = rows[:3]
    assert rows[3]["bytes"] == 0 and rows[4]["bytes"] == 0
    assert a["timestamp"] == dt.datetime(2024, 1, 15, 8, 0) and a["bytes"] == 0 and a["protocol"] == "HTTP/1.1"
    assert b["bytes"] == 12 and b["user_agent"] is None and b["status"] == 404
    assert g["status"] == 500 and g["bytes"] == 0 and g["extra"] == "w"
    assert a["referrer"] is None and a["user"] is None


def test_csv_missing_status_and_absent_columns(spark):
    d = scratch()
    p = write_text(os.path.join(d, "nostatus.csv"), "time,url\n2024-01-15T08:00:00Z,/a\n")
    with pytest.raises(ValueError):
        read_csv_log(spark, p)
    q = write_text(os.path.join(d, "min.csv"), " TIMESTAMP , status \n2024-01-15T08:00:00Z,200\n")
    (r,) = read_csv_log(spark, q).collect()
    assert (r.ip, r.method, r.path, r.user_agent, r.bytes) == ("unknown", "GET", "/", "unknown", 0)


def test_parquet_roundtrip_partitioned(spark, mixed_traffic):
    d = scratch()
    f = add_features(mixed_traffic)
    write_parquet(f, os.path.join(d, "t"), partition_by="date")
    back = read_parquet_log(spark, os.path.join(d, "t"))
    assert back.count() == 9 and set(f.columns) == set(back.columns)
    plan = back.where("date = DATE'2024-01-15'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_load_dispatch_and_report_job(spark, mixed_traffic):
    d = scratch()
    lines = [r.value for r in render_lines(mixed_traffic).collect()]
    log = write_text(os.path.join(d, "access.log"), "\n".join(lines) + "\n")
    df = load_access_log(spark, log)
    assert df.count() == 9 and "is_bot" in df.columns
    out = run_report(spark, log, os.path.join(d, "rep"), ("summary", "top_ips", "brute_force"),
                     {"threshold": 3, "window_minutes": 5})
    assert set(out) == {"_summary", "_top_ips", "_bruteforce"}
    top = pd.concat(pd.read_csv(x) for x in glob.glob(os.path.join(out["_top_ips"], "*.csv")))
    assert top.total_requests.max() == 3
    bf = pd.concat(pd.read_csv(x) for x in glob.glob(os.path.join(out["_bruteforce"], "*.csv")))
    assert list(bf.ip) == ["10.0.0.4"]
    out2 = run_report(spark, log, os.path.join(d, "rep2"), (), save_parquet=os.path.join(d, "pq"))
    assert set(out2) == {"_summary"} and os.path.isdir(os.path.join(d, "pq"))
    out3 = run_report(spark, log, os.path.join(d, "rep3"), ("iqr", "full_table"), fmt="parquet")
    assert spark.read.parquet(out3["_parsed"]).count() == 9
    assert set(out3) == {"_iqr_outliers", "_parsed"}


def test_write_csv(spark):
    d = scratch()
    df = make_log(spark, [{"ip": "a"}, {"ip": "b"}])
    write_csv(df, os.path.join(d, "x"))
    back = pd.concat(pd.read_csv(x) for x in glob.glob(os.path.join(d, "x", "*.csv")))
    assert sorted(back.ip) == ["a", "b"]


def test_load_with_repartition(spark, mixed_traffic):
    import gzip
    d = scratch()
    lines = [r.value for r in render_lines(mixed_traffic).collect()]
    p = os.path.join(d, "a.log.gz")
    with gzip.open(p, "wt") as f:
        f.write("\n".join(lines) + "\n")
    df = load_access_log(spark, p, repartition=4)
    assert df.count() == 9 and df.rdd.getNumPartitions() == 4


def test_report_cli_main(spark, mixed_traffic):
    from logtide.plans.report import main
    d = scratch()
    lines = [r.value for r in render_lines(mixed_traffic).collect()]
    log = write_text(os.path.join(d, "access.log"), "\n".join(lines) + "\n")
    out = main(["--input", log, "--out", os.path.join(d, "cli"), "--analyses", "top_ips,brute_force",
                "--threshold", "3", "--repartition", "2", "--format", "parquet"])
    assert set(out) == {"_top_ips", "_bruteforce"}
    assert [r.ip for r in spark.read.parquet(out["_bruteforce"]).collect()] == ["10.0.0.4"]


def test_csv_quoting_as_rfc_4180(spark):
    d = scratch()
    p = write_text(os.path.join(d, "q.csv"), "time,status,size,ua,note\n"
                   '2024-01-15T08:00:00Z,200,5,"Moz ""x"", like Gecko",a\n'
                   '2024-01-15T08:00:01Z,200,6,"two\nlines", edge \n')
    rows = read_csv_log(spark, p).orderBy("timestamp").collect()
    assert [(r.user_agent, r.bytes, r.note) for r in rows] == [('Moz "x", like Gecko', 5, "a"), ("two\nlines", 6, " edge ")]
    plain = write_text(os.path.join(d, "p.csv"), 'time,status,ua\n2024-01-15T08:00:00Z,200,"a,b"\n')
    assert [r.user_agent for r in read_csv_log(spark, plain, multi_line=False).collect()] == ["a,b"]


def test_written_csv_reads_back_the_same(spark):
    d = scratch()
    cells = [" lead trail ", 'say "hi"', "a,b", "two\nlines", "back\\slash", "plain", "é", '"']
    df = spark.createDataFrame([(i, c, None) for i, c in enumerate(cells)], "i int, c string, n string").coalesce(1)
    write_csv(df, os.path.join(d, "x"))
    back = pd.concat(pd.read_csv(x) for x in glob.glob(os.path.join(d, "x", "*.csv"))).sort_values("i")
    assert list(back.c) == cells and back.n.isna().all()


def test_csv_columns_that_clash_are_kept(spark):
    d = scratch()
    p = write_text(os.path.join(d, "c.csv"), "Time,Status,Protocol,Date,Hour,is_bot,URL\n"
                   "2024-01-15T08:00:00Z,200,SPDY,1999,99,maybe,/a\n")
    df = add_features(read_csv_log(spark, p))
    (r,) = df.select("protocol", "Protocol_raw", "date", "Date_raw", "hour", "Hour_raw", "is_bot", "is_bot_raw").collect()
    assert tuple(r) == ("HTTP/1.1", "SPDY", dt.date(2024, 1, 15), "1999", 8, "99", False, "maybe")
    write_parquet(df, os.path.join(d, "pq"), partition_by="date")
    assert read_parquet_log(spark, os.path.join(d, "pq")).count() == 1


def test_features_keep_a_column_that_differs_by_case(spark):
    df = make_log(spark, [{}]).selectExpr("*", "'mine' AS Date", "7 AS HOUR")
    (r,) = add_features(df).select("date", "Date_raw", "hour", "HOUR_raw").collect()
    assert tuple(r) == (dt.date(2024, 1, 15), "mine", 8, 7)


@pytest.mark.parametrize(("header", "named"), [("url,status", "timestamp"), ("time,url", "status"), ("url,ua", "status")])
def test_csv_missing_required_columns(spark, header, named):
    p = write_text(os.path.join(scratch(), "m.csv"), header + "\nx,y\n")
    with pytest.raises(ValueError, match=named):
        read_csv_log(spark, p)


def test_report_refuses_unknown_analyses_and_cleans_its_stage(spark, mixed_traffic):
    d = scratch()
    log = write_text(os.path.join(d, "a.log"), "\n".join(r.value for r in render_lines(mixed_traffic).collect()) + "\n")
    with pytest.raises(ValueError, match="top_ip"):
        run_report(spark, log, os.path.join(d, "r"), ("top_ip",))
    stage = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(glob.glob(stage + "/report-*"))
    assert set(run_report(spark, log, os.path.join(d, "r"), ("top_ips",))) == {"_top_ips"}
    assert set(glob.glob(stage + "/report-*")) == before


def test_partitioned_parquet_has_few_files(spark):
    d = scratch()
    rows = [{"timestamp": dt.datetime(2024, 1, 1 + i % 3, 8)} for i in range(300)]
    df = add_features(make_log(spark, rows)).repartition(16)
    write_parquet(df, os.path.join(d, "t"), partition_by="date")
    assert all(len(glob.glob(x + "/*.parquet")) == 1 for x in glob.glob(os.path.join(d, "t", "date=*")))
