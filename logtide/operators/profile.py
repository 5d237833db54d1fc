"""Column profile of a table (one row per column)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import half_even


def column_profile(df: DataFrame) -> DataFrame:
    """column, dtype, non_null, null_pct (1 dp, half-even) and a sample value.

    One global aggregate computes ``count(c)`` and ``min(c)`` of every
    column in a single pass; a generator turns the one wide row into one
    row per column. The sample is the smallest value rendered as text
    (the reference shows the first row, which has no meaning in Spark).
    """
    fields = [f for f in df.schema.fields]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        aggs.append(F.count(F.col(f"`{f.name}`")).alias(f"__n{i}"))
        aggs.append(F.min(F.col(f"`{f.name}`")).cast("string").alias(f"__s{i}"))
    wide = df.agg(*aggs)
    entries = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                        F.lit(f.dataType.simpleString()).alias("dtype"),
                        F.col(f"__n{i}").alias("non_null"), F.col(f"__s{i}").alias("sample"))
               for i, f in enumerate(fields)]
    return (wide.select("__rows", F.inline(F.array(*entries)))
            .withColumn("null_pct", half_even(F.try_divide(F.col("__rows") - F.col("non_null"), F.col("__rows")) * 100, 1))
            .select("position", "column", "dtype", "non_null", "null_pct", "sample")
            .orderBy("position"))


def column_mapping(raw: DataFrame) -> DataFrame:
    """Mapping report of a raw CSV frame: each standard column, whether it
    was detected (and from which header) or defaulted, and a sample value
    (the smallest non-null value of the source column, as text).

    The plan comes from the header only; the samples are one aggregate.
    """
    from ..sources.csv_log import column_mapping_report
    rows = column_mapping_report(raw.columns)
    samples = raw.agg(*[F.min(F.col(f"`{r['source_column']}`")).cast("string").alias(f"__s{i}")
                        if r["source_column"] else F.lit(None).cast("string").alias(f"__s{i}")
                        for i, r in enumerate(rows)])
    entries = [F.struct(F.lit(i).alias("position"), F.lit(r["standard_name"]).alias("standard_name"),
                        F.lit(r["status"]).alias("status"),
                        F.lit(r["source_column"]).cast("string").alias("source_column"),
                        F.col(f"__s{i}").alias("sample"))
               for i, r in enumerate(rows)]
    return samples.select(F.inline(F.array(*entries))).orderBy("position")
