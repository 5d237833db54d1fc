"""Task-level skew evidence from Spark's event log (no UI, no server).

Builds a log where one IP holds a third of all rows, runs brute-force
detection and the per-IP features with the event log written to a scratch
folder, then prints, per stage, the total shuffle records read and the share
read by the busiest task. With per-(ip, second) pre-aggregation and
(ip, bucket) windows no stage should hand the hot IP's rows to one task.

Usage: python scripts/skew_report.py [rows]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from logtide.functions.features import add_features  # noqa: E402
from logtide.operators import detectors, ip_features  # noqa: E402
from logtide.session import build_session, ensure_checkpoint_dir  # noqa: E402


def hot_log(spark, n):
    i = F.col("id")
    hot = i % 3 == 0
    t0 = 1_705_305_600
    ts = F.when(hot, F.lit(t0) + F.floor((i / 3).cast("bigint") / 4)).otherwise(F.lit(t0) + (i * 7919) % 86400)
    return add_features(spark.range(n).select(
        F.when(hot, F.lit("6.6.6.6")).otherwise(F.concat(F.lit("10.0."), (i % 1000).cast("string"))).alias("ip"),
        F.lit(None).cast("string").alias("user"), F.timestamp_seconds(ts).alias("timestamp"),
        F.lit("GET").alias("method"), F.concat(F.lit("/p"), (i % 13).cast("string")).alias("path"),
        F.lit("HTTP/1.1").alias("protocol"),
        F.when(hot, F.lit(401)).otherwise(F.lit(200)).cast("smallint").alias("status"),
        (i % 5000).alias("bytes"), F.lit(None).cast("string").alias("referrer"),
        F.lit("Mozilla/5.0").alias("user_agent")))


def main() -> None:
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 3_000_000
    log_dir = tempfile.mkdtemp(prefix="run-skew-")
    spark = build_session("local[8]", shuffle_partitions=32, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir, "spark.eventLog.compress": "false",
        "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    ensure_checkpoint_dir(spark)
    df = hot_log(spark, n)
    for name, q in (("brute_force", detectors.brute_force(df, window_minutes=5, threshold=100)),
                    ("ip_features", ip_features.ip_feature_matrix(df))):
        spark.sparkContext.setJobDescription(name)
        q.write.format("noop").mode("overwrite").save()
    spark.stop()
    per_stage = defaultdict(list)
    paths = [p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(p)]
    for path in paths:
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                if ev.get("Event") == "SparkListenerTaskEnd":
                    m = ev.get("Task Metrics") or {}
                    read = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                    per_stage[ev["Stage ID"]].append(read)
    print(f"rows={n}, hot IP rows={n // 3}")
    for stage, reads in sorted(per_stage.items()):
        total = sum(reads)
        if total:
            print(f"stage {stage:3d}: tasks={len(reads):3d} shuffle records={total:9d} "
                  f"busiest task={max(reads):8d} ({100 * max(reads) / total:5.1f}%)")


if __name__ == "__main__":
    main()
