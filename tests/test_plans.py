"""Physical-plan checks: the properties the operators rely on at scale."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


def executed_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def q():
    if not os.path.exists(f"{SF}/events.parquet"):
        pytest.skip("test data not present")
    return entry.queries()


def test_top_ips_prunes_scan_and_aggregates_partially(spark, q):
    p = executed_plan(q["top_ips"](spark, SF))
    assert "partial_count" in p and "TakeOrderedAndProject" in p
    assert "props" not in p.split("FileScan")[1].split("]")[0]  # unused column not read


def test_zscore_broadcasts_hourly_stats_and_reuses_counts(spark, q):
    p = executed_plan(q["zscore_anomalies"](spark, SF))
    assert "BroadcastHashJoin" in p and "ReusedExchange" in p


def test_brute_force_window_split_by_ip_and_bucket(spark, q):
    p = executed_plan(q["brute_force"](spark, SF))
    assert "hashpartitioning(ip" in p and any("bucket" in part[:400] for part in p.split("Window")[1:])


def test_ip_features_read_the_source_once(spark, q, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    plans, plain = [], DataFrame.checkpoint

    def kept(self, *args):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return plain(self, *args)

    monkeypatch.setattr(DataFrame, "checkpoint", kept)
    final = executed_plan(q["ip_features"](spark, SF))
    assert sum(p.count("FileScan") for p in plans) == 1 and "FileScan" not in final
    # requests are combined map-side per (ip, time) and (ip, path) before the only shuffle of raw rows
    assert "partial_sum(one" in plans[0] and "percentile" not in final


def test_summary_is_one_scan_without_per_ip_maps(spark, q):
    for name in ("summary_stats", "summary_report"):
        p = executed_plan(q[name](spark, SF))
        assert "ObjectHashAggregate" not in p and "partial_count(1)" in p


def test_brute_force_aggregates_by_hash(spark, q):
    p = executed_plan(q["brute_force"](spark, SF))
    assert "SortAggregate" not in p and "HashAggregate" in p


def test_auth_timeline_counts_once(spark, q):
    p = executed_plan(q["auth_failure_timeline"](spark, SF)).split("== Initial Plan ==")[0]
    assert p.count("FileScan") == 1 and "Join" not in p


def test_csv_cells_are_parsed_once(spark, q):
    plan = q["csv_alias_ingest"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("yyyy/MM/dd HH:mm:ss") == 1


def test_iqr_uses_scalar_subquery_not_join(spark, q):
    p = executed_plan(q["iqr_outliers"](spark, SF))
    assert "Subquery" in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_parquet_source_pushes_filter_and_prunes_columns(spark, tmp_path):
    from conftest import make_log

    from logtide.operators import errors
    from logtide.sinks.writers import write_parquet
    from logtide.sources.load import load_access_log
    path = str(tmp_path / "log.parquet")
    write_parquet(make_log(spark, [{"status": 404, "path": "/x"}, {}]), path)
    p = executed_plan(errors.top_404_paths(load_access_log(spark, path)))
    scan = [line for line in p.splitlines() if "FileScan parquet" in line][0]
    assert "EqualTo(status,404)" in scan
    assert "ReadSchema: struct<path:string,status:smallint>" in scan


def test_brute_force_pre_aggregates_per_ip_second_before_shuffling(spark, q):
    import re
    p = executed_plan(q["brute_force"](spark, SF)).split("== Initial Plan ==")[0]
    # the map side combines failures per (ip, second) before the first exchange
    assert re.search(r"Aggregate\(keys?=\[ip#\d+, ts_epoch#\d+L?\], functions=\[partial_count\(1\)", p)
    assert re.search(r"Exchange hashpartitioning\(ip#\d+, ts_epoch#\d+L?, ", p)
