"""Format dispatch and Parquet reload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.features import add_features
from .csv_log import read_csv_log
from .raw_log import ParseMetrics, batch_parse, batch_parse_readable, parse_log_file


def read_parquet_log(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Reload a table written by ``write_parquet`` (partition columns included)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def format_of(path: str, pattern: str | None = None) -> str:
    """``csv`` or ``parquet`` by suffix; anything else, and a pattern, is a raw log."""
    suffix = path.lower().rstrip("/").rpartition(".")[2]
    return suffix if suffix in ("csv", "parquet") and not pattern else "log"


def load_access_log(spark: SparkSession, path: str, fmt: str | None = None,
                    pattern: str | None = None, features: bool = True,
                    repartition: int | None = None, multi_line: bool | str = True,
                    skipped: list[tuple[str, str]] | None = None, metrics: ParseMetrics | None = None) -> DataFrame:
    """Load ``path`` as an access-log table and add the derived columns.

    ``fmt`` is ``csv``, ``parquet`` or ``log``; when omitted it follows the
    suffix (``.csv``, ``.parquet``, anything else is a raw log). A ``pattern``
    reads every matching file of the directory ``path`` as raw logs.
    ``repartition`` spreads the parse of raw logs over that many tasks (useful
    for a few large gzip files, which Spark cannot split); ``multi_line`` is
    how CSV files are split (see ``read_csv_log``). With a list ``skipped``,
    files of a pattern that cannot be read to their end are left out and
    appended to it as (file, reason); else they fail the query. ``metrics``
    counts the lines of raw logs.
    """
    fmt = fmt or format_of(path, pattern)
    if fmt == "csv":
        df = read_csv_log(spark, path, multi_line=multi_line)
    elif fmt == "parquet":
        df = read_parquet_log(spark, path)
    elif pattern and skipped is not None:
        df, found = batch_parse_readable(spark, path, pattern, repartition=repartition, metrics=metrics)
        skipped += found
    elif pattern:
        df = batch_parse(spark, path, pattern, repartition=repartition, metrics=metrics)
    else:
        df = parse_log_file(spark, path, repartition=repartition, metrics=metrics)
    return add_features(df) if features else df
