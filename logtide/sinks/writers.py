"""Parquet and CSV sinks.

Writes are distributed (one file per task); nothing passes through the
driver. Overwrite replaces the target directory, which also makes a retried
job idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.csv_text import CSV_TEXT


def write_parquet(df: DataFrame, path: str, partition_by: str | list[str] | None = None,
                  mode: str = "overwrite", days_only: bool = False) -> None:
    """Snappy Parquet; ``partition_by='date'`` enables partition pruning on reload.
    ``days_only`` replaces the partitions that ``df`` has rows for and keeps the others.

    A partitioned write is first rebalanced on the partition columns: rows of
    a value meet in few tasks (AQE splits large values and joins small ones by
    its advisory size), so a value gets few files of that size instead of one
    per task."""
    if partition_by:
        names = [partition_by] if isinstance(partition_by, str) else partition_by
        df = df.hint("rebalance", *names)
    w = df.write.mode(mode).option("compression", "snappy").option("partitionOverwriteMode", "dynamic" if days_only else "static")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)


def _csv_safe(df: DataFrame) -> DataFrame:
    """CSV cannot hold arrays/maps/structs; render those as JSON text."""
    from pyspark.sql import functions as F
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """RFC 4180 CSV with a header row, one directory per result; nulls and
    empty strings are both empty cells."""
    _csv_safe(df).write.mode(mode).options(**CSV_TEXT).option("header", "true").csv(path)


def _in_store(spark: SparkSession, path: str):
    """(file system, path) in whatever store the path names."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def folder_exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _in_store(spark, path)
    return fs.exists(folder)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that a job wrote for its own use."""
    fs, folder = _in_store(spark, path)
    fs.delete(folder, True)


def move_folder(spark: SparkSession, path: str, to: str) -> None:
    """Put a finished result in its place, instead of an earlier one."""
    fs, folder = _in_store(spark, path)
    target = _in_store(spark, to)[1]
    fs.delete(target, True)
    if not fs.rename(folder, target):
        raise OSError(f"'{path}' could not be moved to '{to}'")


def result_path(prefix: str, suffix: str) -> str:
    """``out/report`` + ``_top_ips`` -> ``out/report_top_ips`` (a directory)."""
    prefix = prefix.rstrip("/")
    if prefix.endswith(".csv"):
        prefix = prefix[:-4]
    return f"{prefix}{suffix}"
