"""Helpers shared by the training-data operators: table access, reliable
checkpoints, written stages and a gapless rank that needs no single task."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Character class of a word: everything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that ``spark.checkpoint.dir`` names."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame, name: str, bucket: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and reread it.

    For wide intermediates that later steps read column-wise; the written
    files cut the lineage and survive lost executors. With ``bucket``, the files are
    an external table bucketed by that column, as many buckets as the session has
    shuffle partitions; each task writes a file per bucket that it has rows of."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    unique = uuid.uuid4().hex
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{unique}"
    if bucket is None:
        df.write.parquet(path)
        return spark.read.parquet(path)
    stage = f"{name}_{unique}".replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, bucket).option("path", path).saveAsTable(stage)
    return spark.table(stage)


def gapless_rank(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within each ``group`` in ``order``.

    Rows are range-partitioned over (group, order, random tie breaker) and
    sorted, so one group, or one key that holds a third of all rows, spreads
    over many tasks. The run of a group inside one partition is contiguous;
    the runs' offsets come from a table with at most
    (partitions + groups) rows, which is what is broadcast. Rows equal in
    group and order are interchangeable, so the numbering of the result's
    rows is the same whatever the tie breaker. Null keys form a group.
    """
    tie, pos, part = f"{name}__tie", f"{name}__pos", f"{name}__part"
    rows = (df.withColumn(tie, F.rand(17))
            .repartitionByRange(*group, *order, tie)
            .sortWithinPartitions(*group, *order)
            .drop(tie)
            .withColumn(pos, F.monotonically_increasing_id()))
    rows = checkpointed(rows).withColumn(part, F.shiftright(pos, 33))
    runs = rows.groupBy(*group, part).agg(F.min(pos).alias("first"), F.count("*").alias("n"))
    before = (Window.partitionBy(*group).orderBy(part)
              .rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*[F.col(g).alias(f"{name}__{i}") for i, g in enumerate(group)],
                       F.col(part).alias(f"{name}__run"), "first",
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    on = F.col(part) == F.col(f"{name}__run")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"{name}__{i}"))
    joined = rows.join(F.broadcast(runs), on, "left")
    return joined.select(*df.columns, (F.col("before") + F.col(pos) - F.col("first")).alias(name))
