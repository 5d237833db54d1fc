"""Exact quantile of a column without gathering the column in one task.

The value at a rank is found by narrowing: the range of the values still in
question is cut into BINS equal parts, one aggregate counts each part and
takes its least and greatest value, and the part that holds the rank is the
next range. Parts get narrower BINS-fold each pass, so a few passes end at a
single value, however many rows share it; no more than BINS + 1 rows ever
reach the driver. The result equals linear interpolation between the two
order statistics around ``q * (n - 1)``, as ``percentile`` and
``numpy.percentile`` have it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1024


def value_at_rank(values: DataFrame, rank: int, bins: int = BINS) -> float:
    """The ``rank``-th smallest (from 0) of the double column ``v``, which has
    neither nulls nor NaN."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    while low < high:
        # Halves keep the width finite for any two doubles.
        width = high / 2 - low / 2
        part = F.least(F.lit(bins - 1), F.floor((F.col("v") / 2 - F.lit(low / 2)) / F.lit(width) * bins)).cast("int")
        if width == 0:  # neighbours: telling the two values apart is all that is left
            part = (F.col("v") > F.lit(low)).cast("int")
        rows = (values.where(F.col("v").between(low, high)).groupBy(part.alias("part"))
                .agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect())
        for row in sorted(rows, key=lambda r: r["part"]):
            if rank < row["n"]:
                low, high = row["low"], row["high"]
                break
            rank -= row["n"]
    return low


def exact_quantile(df: DataFrame, col: str, q: float, n: int | None = None) -> float | None:
    """Linear-interpolated ``q`` quantile of the non-null values of ``col``.

    ``n`` is the number of non-null values when the caller already knows it
    (saves one pass over ``df``). Give a column that is cheap to read, such as
    a checkpoint: each of the two ranks takes a handful of passes.
    """
    values = df.select(F.col(col).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    n = values.count() if n is None else n
    if n == 0:
        return None
    at = q * (n - 1)
    below = value_at_rank(values, math.floor(at))
    if at == math.floor(at):
        return below
    return below + (value_at_rank(values, math.ceil(at)) - below) * (at - math.floor(at))
