"""Ingest metrics, the restartable report job, the fitted forest, daily rollups."""

import datetime as dt
import glob
import gzip
import os

import pytest
from conftest import BASE_TS, make_log
from pyspark.sql import functions as F

from logtide.functions.features import add_features
from logtide.operators import isolation_forest as forest
from logtide.operators import rollup, summary
from logtide.plans import report
from logtide.plans.report import Manifest, input_fingerprint, run_report
from logtide.sources.access_view import render_lines
from logtide.sources.raw_log import ParseMetrics, parse_lines, parse_quality
from logtide.streaming.live import batch_quality, stream_access_log, stream_hourly_traffic


def some_log(spark, ips=24, days=2):
    rows = []
    for i in range(ips):
        for k in range(3 + 5 * (i % 7) + (200 if i == 3 else 0)):
            rows.append({"ip": f"10.0.0.{i}", "status": (200, 200, 404, 500, 401)[(i * k) % 5 if i % 4 == 0 else 0],
                         "path": f"/p{k % (1 + i % 5)}", "timestamp": BASE_TS + dt.timedelta(seconds=37 * k + i, days=k % days),
                         "user_agent": "Googlebot" if i == 5 else "Mozilla"})
    return make_log(spark, rows)


def write_lines(folder, name, lines):
    path = os.path.join(str(folder), name)
    with (gzip.open if name.endswith(".gz") else open)(path, "wt") as f:
        f.write("\n".join(lines) + "\n")
    return path


def rendered(df):
    return [r.value for r in render_lines(df).collect()]


BAD = ["", "   ", "no log line", 'x - - [99/Foo/2024:25:61:61 +0000] "GET / HTTP/1.1" 200 5']


# --- metrics ----------------------------------------------------------------

def test_metrics_are_parse_quality_without_a_scan_of_their_own(spark, mixed_traffic):
    lines = spark.createDataFrame([("a", x) for x in rendered(mixed_traffic) + BAD], "source string, value string").repartition(3)
    metrics = ParseMetrics("own_test")
    parsed = parse_lines(lines, metrics=metrics)
    assert parsed.count() == 9
    expected = parse_quality(lines).drop("source").first().asDict()
    assert metrics.get() == expected and expected["bad_timestamps"] == 1 and expected["blank_lines"] == 2


def test_streams_report_every_batch_and_late_rows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    hours = [{"timestamp": BASE_TS + dt.timedelta(hours=h, minutes=m)} for h in range(6) for m in (0, 30)]
    write_lines(src, "a.log", rendered(make_log(spark, hours)) + BAD)
    os.utime(src / "a.log", (1, 1))
    write_lines(src, "b.log", rendered(make_log(spark, [{"timestamp": BASE_TS + dt.timedelta(hours=7)}])) + BAD[:1])
    os.utime(src / "b.log", (2, 2))
    write_lines(src, "c.log", rendered(make_log(spark, [{"timestamp": BASE_TS}, {"timestamp": BASE_TS + dt.timedelta(hours=7)}])))
    parsed = stream_access_log(spark, str(src), max_files_per_trigger=1, metrics=ParseMetrics("own_stream", streaming=True))
    query = (stream_hourly_traffic(parsed).writeStream.format("memory").queryName("own_stream").outputMode("append")
             .trigger(availableNow=True).start())
    query.awaitTermination(300)
    seen = batch_quality(query, "own_stream")
    total = lambda name: sum(x.get(name, 0) for x in seen)
    assert (total("total_lines"), total("parsed_lines"), total("failed_lines"), total("blank_lines")) == (20, 16, 1, 3)
    assert total("bad_timestamps") == 1 and total("dropped_late") == 1


# --- report job -------------------------------------------------------------

def files_of(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(path + "/*")}


CHOSEN = ("top_ips", "top_404", "anomalies", "brute_force", "iqr")


def test_a_stopped_job_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    log = write_lines(tmp_path, "a.log", rendered(some_log(spark)))
    out, options = str(tmp_path / "r"), {"fmt": "parquet", "resume": True}
    monkeypatch.setattr(report.detectors, "brute_force", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run_report(spark, log, out, CHOSEN, {"threshold": 3}, **options)
    monkeypatch.undo()
    done = Manifest(spark, out).entries()
    assert set(done) == {"_top_ips", "_top_404", "_anomalies", "_stage"}
    before = {s: files_of(done[s][1]) for s in ("_top_ips", "_top_404", "_anomalies")}
    monkeypatch.setattr(report, "load_access_log", lambda *a, **k: 1 / 0)  # the stage table is still there
    written = run_report(spark, log, out, CHOSEN, {"threshold": 3}, **options)
    monkeypatch.undo()
    assert set(written) == {"_top_ips", "_top_404", "_anomalies", "_bruteforce", "_iqr_outliers"}
    assert {s: files_of(written[s]) for s in before} == before
    assert set(Manifest(spark, out).entries()) == set(written) and not os.path.exists(done["_stage"][1].removeprefix("file:"))

    monkeypatch.setattr(report, "load_access_log", lambda *a, **k: 1 / 0)  # nothing is left to do
    assert run_report(spark, log, out, CHOSEN, {"threshold": 3}, **options) == written
    monkeypatch.undo()
    before = {s: files_of(p) for s, p in written.items()}
    assert run_report(spark, log, out, CHOSEN, {"threshold": 4}, **options) == written
    assert {s for s, p in written.items() if files_of(p) != before[s]} == {"_bruteforce"}
    write_lines(tmp_path, "a.log", rendered(some_log(spark, ips=12)))
    run_report(spark, log, out, CHOSEN, {"threshold": 4}, **options)
    assert {s for s, p in written.items() if files_of(p) == before[s]} == set()
    fresh = run_report(spark, log, str(tmp_path / "fresh"), CHOSEN, {"threshold": 4}, fmt="parquet")
    for s in written:
        assert sorted(map(str, spark.read.parquet(written[s]).collect())) == sorted(map(str, spark.read.parquet(fresh[s]).collect()))


def test_unreadable_files_of_a_pattern(spark, tmp_path):
    write_lines(tmp_path, "a.log.gz", rendered(some_log(spark, ips=5)))
    cut = write_lines(tmp_path, "b.log.gz", rendered(some_log(spark)))
    with open(cut, "r+b") as f:
        f.truncate(400)
    out = run_report(spark, str(tmp_path), str(tmp_path / "r"), ("top_ips", "quality"), pattern="*.log.gz", fmt="parquet")
    assert set(out) == {"_top_ips", "_parse_quality", "_skipped_files"}
    (gone,) = spark.read.parquet(out["_skipped_files"]).collect()
    assert gone.file.endswith("b.log.gz") and gone.reason
    total = spark.read.parquet(out["_top_ips"]).agg(F.sum("total_requests")).first()[0]
    quality = spark.read.parquet(out["_parse_quality"]).first()
    assert quality.parsed_lines == quality.total_lines == total == some_log(spark, ips=5).count()
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        run_report(spark, str(tmp_path), str(tmp_path / "s"), ("top_ips",), pattern="*.log.gz", skip_unreadable=False)
    with pytest.raises(ValueError, match="quality"):
        run_report(spark, str(tmp_path / "x.csv"), str(tmp_path / "s"), ("quality",))


def test_input_fingerprint(spark, tmp_path):
    write_lines(tmp_path, "a.log", ["x"])
    one = input_fingerprint(spark, str(tmp_path), "*.log")
    write_lines(tmp_path, "b.txt", ["x"])
    assert input_fingerprint(spark, str(tmp_path), "*.log") == one != input_fingerprint(spark, str(tmp_path), None)
    write_lines(tmp_path, "c.log", ["x"])
    assert input_fingerprint(spark, str(tmp_path), "*.log") != one
    with pytest.raises(FileNotFoundError):
        input_fingerprint(spark, str(tmp_path / "none"), None)


# --- fitted forest ----------------------------------------------------------

def test_a_stored_model_scores_as_the_job_that_fitted_it(spark, tmp_path):
    log = add_features(some_log(spark))
    model = forest.fit_model(log, contamination=0.1, n_estimators=30)
    forest.save_model(spark, model, str(tmp_path / "m"))
    loaded = forest.load_model(spark, str(tmp_path / "m"))
    expected = list(map(tuple, forest.isolation_forest(log, contamination=0.1, n_estimators=30).collect()))
    assert list(map(tuple, forest.score_log(log, loaded).collect())) == expected
    assert list(map(tuple, forest.score_log(log, model).collect())) == expected and any(r[-1] for r in expected)
    later = add_features(some_log(spark, ips=40, days=3))
    found = {r.ip: r for r in forest.score_log(later, loaded).collect()}
    assert len(found) == 40 and found["10.0.0.3"].is_anomaly
    assert forest.score_log(later.limit(0), loaded).count() == 0


def test_model_limits(spark, tmp_path):
    with pytest.raises(ValueError, match="10 rows"):
        forest.fit_model(add_features(make_log(spark, [{}] * 4)))
    model = forest.fit_model(add_features(some_log(spark, ips=8)), n_estimators=3)
    nodes, params = forest.model_tables(spark, model)
    assert nodes.groupBy("tree").count().count() == 3 and nodes.where("feature >= 0 AND left_child = 0").count() == 0
    with pytest.raises(ValueError, match="fitted on"):
        forest.model_from(nodes, params.withColumn("features", F.array(F.lit("other"))))


# --- rollup -----------------------------------------------------------------

def test_rollup_of_any_span_is_the_summary_of_its_rows(spark):
    log = add_features(some_log(spark, days=5).unionByName(make_log(spark, [{"ip": None, "status": None}])))
    daily = rollup.daily_rollup(log).cache()
    for first, last in (("2024-01-01", "2024-02-01"), ("2024-01-16", "2024-01-18"), ("2030-01-01", "2030-01-02")):
        span = F.col("date").between(first, last)
        got = rollup.summarize_rollup(daily.where(span)).first().asDict()
        want = summary.summary_stats(log.where(span)).first().asDict()
        assert got == want  # so few IPs are counted exactly
    by_day = {r.day: r.total_requests for r in rollup.summarize_rollup(daily, {"day": F.col("date")}).collect()}
    assert by_day == {r.date: r["count"] for r in log.groupBy("date").count().collect()}
    daily.unpersist()


def test_per_ip_rollup_answers_for_any_span(spark, tmp_path):
    from logtide.operators.clients import top_ips
    from logtide.operators.detectors import iqr_outliers
    log = add_features(some_log(spark, days=4).unionByName(make_log(spark, [{"ip": None}])))
    folder = str(tmp_path / "days")
    daily = rollup.daily_ip_rollup(log)
    rollup.store_days(daily.withColumn("total_requests", F.lit(1).cast("long")), folder)
    rollup.store_days(daily.where("date >= '2024-01-16'"), folder)
    rollup.store_days(daily.where("date < '2024-01-17'"), folder)
    stored = spark.read.parquet(folder)
    for span in ("date >= '2024-01-01'", "date BETWEEN '2024-01-16' AND '2024-01-17'", "date > '2030-01-01'"):
        assert rollup.rollup_top_ips(stored.where(span), 7).collect() == top_ips(log.where(span), 7).collect()
        assert rollup.rollup_iqr_outliers(stored.where(span)).collect() == iqr_outliers(log.where(span)).collect()


def test_rollup_estimates_many_ips_and_grows_by_days(spark):
    log = spark.range(60_000).selectExpr("concat('ip-', id % 50000) AS ip", "cast(null as string) user_agent", "cast(200 as smallint) status",
                                         "timestamp'2024-01-01' + make_interval(0, 0, 0, id % 4) AS timestamp", "id AS bytes")
    log = add_features(log)
    parts = [rollup.daily_rollup(log.where(F.col("date") == f"2024-01-0{d}")) for d in range(1, 5)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    row = rollup.summarize_rollup(whole).first()
    assert row.total_requests == 60_000 and abs(row.unique_ips - 50_000) < 0.03 * 50_000
