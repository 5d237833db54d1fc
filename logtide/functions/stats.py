"""Aggregate expressions whose result does not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_stddev_samp(c: Column, wide: bool = False) -> Column:
    """Sample standard deviation of an integer column from exact sums.

    ``stddev_samp`` merges floating-point partial moments, so its last bits
    depend on how rows are partitioned. Here count, sum and sum of squares
    are exact integers (order-independent) and the variance numerator
    n*S2 - S1^2 is formed exactly before one floating division, so every
    partitioning gives the same double. ``wide`` keeps the sum of squares
    as decimal(38,0) for integers whose squares may exceed 64 bits; without
    it the sum is a bigint (fine for 3-digit codes: overflow would need more
    than 9e12 rows in one group, and ANSI mode raises rather than wraps).
    Null for fewer than two values, like ``stddev_samp``.
    """
    x = c.cast("bigint")
    s2 = F.sum((x.cast("decimal(38,0)") * x.cast("decimal(38,0)")) if wide else x * x)
    return stddev_from_sums(F.count(x), F.sum(x), s2)


def stddev_from_sums(n: Column, s1: Column, s2: Column) -> Column:
    """The same from a count, a sum and a sum of squares."""
    dec = lambda e: e.cast("decimal(38,0)")
    numerator = dec(n) * dec(s2) - dec(s1) * dec(s1)
    var = numerator.cast("double") / (n.cast("double") * (n - 1).cast("double"))
    return F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0))))
