"""Every operator on an empty log: no error, columns kept, no rows (or the
documented single row)."""

from conftest import make_log

from logtide.functions.features import add_features
from logtide.operators import chart_data, clients, detectors, errors, ip_features, profile, summary, traffic


def test_operators_on_empty_log(spark):
    empty = add_features(make_log(spark, [{}]).limit(0))
    zero_row = {
        "status_distribution": errors.status_distribution(empty),
        "error_summary": errors.error_summary(empty),
        "top_404_paths": errors.top_404_paths(empty),
        "hourly_traffic": traffic.hourly_traffic(empty),
        "daily_traffic": traffic.daily_traffic(empty),
        "peak_hours": traffic.peak_hours(empty),
        "top_ips": clients.top_ips(empty),
        "user_agent_split": clients.user_agent_split(empty),
        "top_user_agents": clients.top_user_agents(empty),
        "top_endpoints": clients.top_endpoints(empty),
        "bandwidth_usage": clients.bandwidth_usage(empty),
        "traffic_anomalies": detectors.traffic_anomalies(empty),
        "brute_force": detectors.brute_force(empty),
        "iqr_outliers": detectors.iqr_outliers(empty),
        "ip_feature_matrix": ip_features.ip_feature_matrix(empty),
        "error_heatmap": chart_data.error_heatmap(empty),
        "auth_failure_timeline": chart_data.auth_failure_timeline(empty),
    }
    for name, df in zero_row.items():
        assert df.collect() == [], name
        assert df.columns, name
    (s,) = summary.summary_stats(empty).collect()
    assert s.total_requests == 0 and s.unique_ips == 0
    assert [r["count"] for r in chart_data.bot_vs_human(empty).collect()] == [0, 0]
    prof = profile.column_profile(empty).collect()
    assert len(prof) == len(empty.columns) and all(r.non_null == 0 for r in prof)
