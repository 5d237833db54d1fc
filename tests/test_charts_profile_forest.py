import datetime as dt

import numpy as np
import pytest
from conftest import BASE_TS, make_log

from logtide.functions.features import add_features
from logtide.functions.quantile import exact_quantile
from logtide.operators import chart_data, detectors, profile
from logtide.operators.isolation_forest import average_path_length, isolation_forest


def test_error_heatmap_fills_zero(spark):
    rows = [{"timestamp": dt.datetime(2024, 1, 15, 8), "status": 500},   # Monday 8h
            {"timestamp": dt.datetime(2024, 1, 15, 8, 1)},              # Monday 8h
            {"timestamp": dt.datetime(2024, 1, 17, 10)}]                # Wednesday 10h
    cells = [(r.day_of_week, r.day_index, r.hour, r.error_rate)
             for r in chart_data.error_heatmap(add_features(make_log(spark, rows))).collect()]
    assert cells == [("Monday", 1, 8, 0.5), ("Monday", 1, 10, 0.0),
                     ("Wednesday", 3, 8, 0.0), ("Wednesday", 3, 10, 0.0)]


def test_bot_vs_human_always_two_rows(spark):
    rows = chart_data.bot_vs_human(add_features(make_log(spark, [{}, {}]))).collect()
    assert [(r.label, r["count"]) for r in rows] == [("Human Traffic", 2), ("Bot Traffic", 0)]


def test_auth_failure_timeline_top5(spark):
    rows = []
    for i in range(7):
        rows += [{"ip": f"ip{i}", "status": 401}] * (i + 1)
    out = chart_data.auth_failure_timeline(add_features(make_log(spark, rows))).collect()
    assert {r.ip for r in out} == {f"ip{i}" for i in range(2, 7)}
    assert sum(r.failures for r in out) == sum(range(3, 8))


def test_anomaly_points_timestamp(spark):
    rows = [{"ip": f"n{i}"} for i in range(12)] + [{"ip": "hot"}] * 40
    a = detectors.traffic_anomalies(add_features(make_log(spark, rows)), 3.0)
    (p,) = chart_data.anomaly_points(a).collect()
    assert p.ts == dt.datetime(2024, 1, 15, 8, 0)


def test_column_profile(spark):
    df = make_log(spark, [{"user": "bob"}, {}, {}])
    prof = {r.column: r for r in profile.column_profile(df).collect()}
    assert prof["user"].non_null == 1 and prof["user"].null_pct == 66.7 and prof["user"].sample == "bob"
    assert prof["status"].dtype == "smallint" and prof["ip"].null_pct == 0.0


def test_exact_quantile_matches_numpy(spark):
    rng = np.random.default_rng(1)
    vals = rng.normal(size=5000)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    for q in (0.05, 0.5, 0.999):
        assert exact_quantile(df, "v", q) == pytest.approx(np.percentile(vals, 100 * q), abs=1e-12)


def test_average_path_length():
    assert list(average_path_length(np.array([0, 1, 2]))) == [0, 0, 1]
    assert average_path_length(np.array([256.0]))[0] == pytest.approx(2 * (np.log(255) + 0.5772156649) - 2 * 255 / 256)


def forest_log(spark, n_normal=60):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n_normal):
        for k in range(int(rng.integers(8, 14))):
            rows.append({"ip": f"10.1.0.{i}", "timestamp": BASE_TS + dt.timedelta(seconds=int(rng.integers(0, 7200))),
                         "status": int(rng.choice([200, 200, 200, 404])), "path": f"/p{int(rng.integers(0, 4))}"})
    for k in range(400):   # one scanner: huge volume, all errors, many paths, bot agent
        rows.append({"ip": "6.6.6.6", "timestamp": BASE_TS + dt.timedelta(seconds=k), "status": 404,
                     "path": f"/scan{k}", "user_agent": "Scrapy/2.0"})
    return add_features(make_log(spark, rows))


def test_isolation_forest_properties(spark):
    df = forest_log(spark)
    out = isolation_forest(df, contamination=0.05, n_estimators=50).toPandas()
    assert len(out) == 61
    assert out.iloc[0].ip == "6.6.6.6" and out.iloc[0].is_anomaly
    assert abs(int(out.is_anomaly.sum()) - round(0.05 * 61)) <= 2
    assert set(out.raw_score) <= {-1, 1}
    assert (out.is_anomaly == (out.raw_score == -1)).all()
    again = isolation_forest(df.repartition(5), contamination=0.05, n_estimators=50).toPandas()
    assert out.reset_index(drop=True).equals(again.reset_index(drop=True))


def test_isolation_forest_too_few_rows(spark):
    out = isolation_forest(add_features(make_log(spark, [{}] * 5)))
    assert out.count() == 0 and "decision_score" in out.columns


@pytest.mark.parametrize("q", [0.0, 0.05, 0.2, 0.5, 0.93, 1.0])
@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_exact_quantile_with_ties_at_the_rank(spark, monkeypatch, q, bins):
    """Most values tie, at the rank itself for the middle quantiles, whatever the bins."""
    import logtide.functions.quantile as quantile_mod
    monkeypatch.setattr(quantile_mod.value_at_rank, "__defaults__", (bins,))
    rng = np.random.default_rng(11)
    vals = np.concatenate([rng.exponential(size=200), np.full(2500, 0.25), [-1e300, 1e300, 5e-324, -0.0]])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "v double").repartition(6)
    got = quantile_mod.exact_quantile(df, "v", q)
    assert got == pytest.approx(np.percentile(vals, 100 * q), abs=1e-12, rel=1e-12)


def test_exact_quantile_empty_and_neighbours(spark):
    assert exact_quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.5) is None
    low, high = 1.0, float(np.nextafter(1.0, 2.0))
    df = spark.createDataFrame([(low,), (high,), (high,)], "v double")
    assert exact_quantile(df, "v", 0.0) == low and exact_quantile(df, "v", 1.0) == high


def test_forest_scores_lie_in_unit_interval(spark):
    from pyspark.sql import types as T

    from logtide.operators import isolation_forest as forest
    from logtide.operators.ip_features import FEATURE_NAMES, ip_feature_matrix
    feats = ip_feature_matrix(forest_log(spark))
    model = forest.fit_forest(feats, n_estimators=30, max_samples=32, seed=7)
    bc = spark.sparkContext.broadcast(model)
    schema = T.StructType(feats.schema.fields + [T.StructField("anomaly_score", T.DoubleType())])
    scores = [r.anomaly_score for r in feats.mapInPandas(forest._scorer(bc, FEATURE_NAMES), schema).collect()]
    assert len(scores) == 61 and all(0.0 < s < 1.0 for s in scores)
    assert model["psi"] == 32 and model["max_depth"] == 5


def test_isolation_forest_without_ips_is_empty(spark):
    out = isolation_forest(add_features(make_log(spark, [{"ip": None}] * 12)), n_estimators=5)
    assert out.count() == 0 and "is_anomaly" in out.columns
