"""Status and error aggregates (status distribution, error summary, top 404s)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import ensure_features, status_category


def status_distribution(df: DataFrame) -> DataFrame:
    """Requests per status code with its category label, by status code.

    Rows with a null status are not counted (no null group). A single
    hash aggregate; the partial aggregate runs map-side, so one hot status
    code costs nothing extra.
    """
    return (df.where(F.col("status").isNotNull())
            .groupBy(F.col("status").alias("status_code"))
            .agg(F.count(F.lit(1)).alias("count"))
            .withColumn("category", status_category(F.col("status_code")))
            .orderBy("status_code"))


def error_summary(df: DataFrame) -> DataFrame:
    """(status, path, count) over responses with status >= 400, count descending.

    Rows whose status or path is null form no group. Ties are broken by
    status and path ascending.
    """
    df = ensure_features(df)
    return (df.where(F.col("is_error") & F.col("path").isNotNull())
            .groupBy("status", "path")
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("status"), F.asc("path")))


def top_404_paths(df: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` paths answered most often with 404 (path, count).

    Over a stored table the ``status = 404`` predicate reaches the Parquet scan
    (not where status is itself computed, as in the registered query's view);
    the top-n is a TakeOrderedAndProject, so no global sort happens.
    """
    return (df.where((F.col("status") == 404) & F.col("path").isNotNull())
            .groupBy("path")
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("path"))
            .limit(n))
