"""Per-IP behaviour features (input of the isolation forest)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import ensure_features
from ..functions.stats import stddev_from_sums
from ..session import ensure_checkpoint_dir

FEATURE_NAMES = ("total_requests", "error_rate", "avg_bytes", "bot_rate",
                 "unique_paths", "status_std", "p95_request_gap")


#: Gap bins per doubling of the gap: bin edges about 1% apart.
BINS_PER_OCTAVE = 64
P95 = 0.95


def ip_feature_matrix(df: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """One row per IP: total_requests, error_rate, avg_bytes, bot_rate,
    unique_paths (nulls not counted), status_std (sample) and the 95th
    percentile (linear) of the seconds between consecutive requests of the
    IP; missing values become 0.

    Scale (a hot IP may hold a large share of all rows):
    * one scan: each row gives a (ip, timestamp) and a (ip, path) record, which
      are combined map-side in one hash aggregate; its result is checkpointed
      and everything below reads that. Requests of the same IP at the same
      time, or for the same path, are then one row each.
    * the order-free features are integer sums over the (ip, timestamp) rows.
    * gaps: sorted distinct timestamps give one gap each, inside (ip, time
      bucket) windows; the first of a bucket takes its gap from the last of the
      IP's previous bucket through a ``lag`` over the small per-bucket table.
      Repeats add zero gaps: requests less distinct timestamps.
    * the percentile comes from cumulative frequencies, per (ip, bin) first
      (some thousand logarithmic bins at most) and then over the distinct gaps
      of the one or two bins that hold the ranks. A bin near g microseconds is
      0.011 g wide, and a log of S microseconds has at most S / g such gaps, so
      the last window sees under sqrt(0.011 S) rows per IP (600,000 for a
      year), whatever the traffic.
    """
    df = ensure_features(df)
    ensure_checkpoint_dir(df.sparkSession)
    record = lambda kind, **given: F.struct(F.lit(kind).alias("kind"), *[
        given.get(name, F.lit(None)).cast(kind_of).alias(name) for name, kind_of in (
            ("ts", "timestamp"), ("page", "string"), ("one", "bigint"), ("error", "bigint"), ("size", "bigint"),
            ("bot", "bigint"), ("code", "bigint"))])
    kinds = F.array(record(0, ts=F.col("timestamp"), one=F.lit(1), error=F.col("is_error"), size=F.col("bytes"),
                           bot=F.col("is_bot"), code=F.col("status")),
                    record(1, page=F.col("path")))
    facts = (df.where(F.col("ip").isNotNull()).select("ip", F.inline(kinds)).groupBy("ip", "kind", "ts", "page")
             .agg(F.sum("one").alias("n"), F.sum("error").alias("error"), F.count("error").alias("n_error"),
                  F.sum("size").alias("size"), F.count("size").alias("n_size"), F.sum("bot").alias("bot"),
                  F.count("bot").alias("n_bot"), F.sum("code").alias("code"), F.count("code").alias("n_code"),
                  F.sum(F.col("code") * F.col("code")).alias("code2"))).checkpoint()
    at = facts.where("kind = 0")
    mean = lambda c: F.sum(c).cast("double") / F.sum("n_" + c).cast("double")
    guarded = lambda c: F.when(F.sum("n_" + c) > 0, mean(c))
    stats = at.groupBy("ip").agg(
        F.sum("n").alias("total_requests"), guarded("error").alias("error_rate"), guarded("size").alias("avg_bytes"),
        guarded("bot").alias("bot_rate"),
        stddev_from_sums(F.sum("n_code"), F.sum("code"), F.sum("code2")).alias("status_std"))
    paths = facts.where("kind = 1 AND page IS NOT NULL").groupBy("ip").agg(F.count(F.lit(1)).alias("unique_paths"))
    gaps = _percentile_gap(at.where("ts IS NOT NULL").select("ip", "ts", "n"), int(bucket_seconds))
    return (stats.join(paths, "ip", "left").join(gaps, "ip", "left")
            .select("ip", *FEATURE_NAMES)
            .fillna(0, subset=list(FEATURE_NAMES)))


def _percentile_gap(at: DataFrame, bucket_seconds: int) -> DataFrame:
    """(ip, p95_request_gap) in seconds from (ip, ts, n), for IPs with two
    requests or more."""
    at = at.withColumn("bucket", F.floor(F.unix_seconds("ts") / F.lit(bucket_seconds)))
    micros = lambda a, b: F.unix_micros(a) - F.unix_micros(b)
    inside = Window.partitionBy("ip", "bucket").orderBy("ts")
    local = at.select("ip", micros(F.col("ts"), F.lag("ts").over(inside)).alias("gap"))
    buckets = at.groupBy("ip", "bucket").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    across = Window.partitionBy("ip").orderBy("bucket")
    edges = buckets.select("ip", micros(F.col("first"), F.lag("last").over(across)).alias("gap"))
    zero = (at.groupBy("ip").agg((F.sum("n") - F.count(F.lit(1))).alias("freq"))
            .where("freq > 0").select("ip", F.lit(0).cast("bigint").alias("gap"), "freq"))
    gaps = (local.unionByName(edges).where("gap IS NOT NULL").groupBy("ip", "gap").agg(F.count(F.lit(1)).alias("freq"))
            .unionByName(zero))
    slot = F.floor(F.log2(F.col("gap") + 1) * F.lit(BINS_PER_OCTAVE))
    gaps = gaps.withColumn("slot", slot).checkpoint()  # read twice: for the bins, then inside the chosen ones
    before = (Window.partitionBy("ip").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    bins = (gaps.groupBy("ip", "slot").agg(F.sum("freq").alias("freq"))
            .withColumn("before", F.coalesce(F.sum("freq").over(before), F.lit(0)))
            .withColumn("total", F.sum("freq").over(Window.partitionBy("ip"))))
    rank = F.lit(P95) * (F.col("total") - 1)
    low, high = F.floor(rank), F.ceil(rank)
    holds = lambda r, n: (F.col("before") <= r) & (r < F.col("before") + F.col(n))
    chosen = bins.where(holds(low, "freq") | holds(high, "freq")).select("ip", "slot", "before", "total")
    within = (Window.partitionBy("ip", "slot").orderBy("gap").rowsBetween(Window.unboundedPreceding, -1))
    ranked = (gaps.join(chosen, ["ip", "slot"])
              .withColumn("before", F.col("before") + F.coalesce(F.sum("freq").over(within), F.lit(0))))
    value = lambda r: F.max(F.when(holds(r, "freq"), F.col("gap"))) / F.lit(1e6)
    ends = ranked.groupBy("ip", "total").agg(value(low).alias("a"), value(high).alias("b"))
    share = rank - low
    return ends.select("ip", (F.col("a") + (F.col("b") - F.col("a")) * share).alias("p95_request_gap"))
