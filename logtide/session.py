"""SparkSession helpers.

Library functions never create a session; they take the caller's. These
helpers are for tests, the bench and the report job.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "logtide", extra: dict | None = None) -> SparkSession:
    """Session with UTC time zone, AQE on and the web UI off."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def require_utc(spark: SparkSession) -> None:
    """Access-log time parts (hour, date, weekday) and zone-less CSV times are
    defined in UTC. The caller's session is not changed: one with another time
    zone is refused."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone.upper() not in ("UTC", "ETC/UTC", "GMT", "Z", "UCT", "ETC/GMT", "+00:00"):
        raise ValueError(f"the session's time zone is {zone}; set spark.sql.session.timeZone to UTC")


def cluster_conf(total_cores: int = 8000, input_tb: float = 100.0) -> dict[str, str]:
    """Settings sized for a large cluster (pass to ``SparkSession.builder.config``).

    Shuffle partitions start high (about 3 per core) and AQE coalesces them
    to ~256 MB each at run time; files are split at 512 MB so a 100 TB scan
    is ~200k tasks; skewed shuffle partitions are split by AQE; broadcasts
    stay on AQE's runtime size check (explicit hints are used only for sides
    with a proven bound). The checkpoint folder must be shared storage and
    is set by the cluster, not here.
    """
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(max(200, 3 * total_cores)),
        "spark.sql.files.maxPartitionBytes": str(512 * 1024 * 1024),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
        "spark.sql.parquet.compression.codec": "snappy",
        "spark.task.maxFailures": "8",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is (unset on a cluster is an error). Only in local mode, when it is
    unset, a scratch folder is created.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder (HDFS/object store) "
                           "that all executors can reach")
    # Local runs only: a scratch folder, registered on the SparkContext (the
    # spark.checkpoint.dir setting itself cannot change at run time).
    local = tempfile.mkdtemp(prefix="logtide-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local
