"""Which files of a log folder can be read to their end: one row a file.

The listing, the reading and the verdicts stay on the executors. Gzip files
are decompressed from their bytes, a file's blocks one after another; of plain
files the bytes that Spark's reader gave are counted against the length. A
store that refuses access or misses blocks fails the query, as that says
nothing about the file. Empty files, which hold nothing, have no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compressed bytes up to which a gzip file is read as one value; larger ones are told apart by jobs of their own.
MOST_GZIP = 1 << 28
#: Bytes that decompression holds at once.
STEP = 1 << 20
OTHER_CODECS = (".bz2", ".deflate", ".lz4", ".snappy", ".zst")


def gzip_fault(body) -> str | None:
    """Why gzip data (one member or several) can't be read to its end, or None."""
    left = memoryview(body)
    while len(left):
        member = zlib.decompressobj(wbits=31)
        try:
            at = 0
            while at < len(left) and not member.eof:
                part = bytes(left[at:at + STEP])
                at += len(part)
                while part and not member.eof:
                    member.decompress(part, STEP)
                    part = member.unconsumed_tail
        except zlib.error as exc:
            return str(exc)
        if not member.eof:
            return "the gzip data ends before its end mark"
        left = left[at - len(member.unused_data):]
    return None


def _gzip_reasons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        reasons = [gzip_fault(body.as_buffer()) for body in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(reasons, pa.string())], names=["file", "reason"])


def file_status(spark: SparkSession, load) -> DataFrame:
    """(file, length, kind, reason): kind is gzip, plain or other. A readable
    file has no reason; ``other`` ones are not judged. ``load`` loads the files
    with a given reader."""
    path = F.col("_metadata.file_path")
    size = F.col("_metadata.file_size")
    lower = F.lower(path)
    other = F.lit(False)
    for suffix in OTHER_CODECS:
        other = other | lower.endswith(suffix)
    kind = F.when(lower.endswith(".gz") & (size <= MOST_GZIP), "gzip").when(lower.endswith(".gz") | other, "other").otherwise("plain")
    files = load(spark.read.format("binaryFile")).select(path.alias("file"), size.alias("length"), kind.alias("kind"), "content")
    gzip = files.where("kind = 'gzip'").select("file", "content").mapInArrow(_gzip_reasons, "file string, reason string")
    lines = load(spark.read.format("text").option("lineSep", "\n").option("ignoreCorruptFiles", "true"))
    read = (lines.where(kind == "plain").groupBy(path.alias("file"))
            .agg(F.sum(F.octet_length("value") + F.lit(1).cast("long")).alias("bytes")))
    # The last line may lack its line end, and the reader takes off a byte order mark.
    over = F.coalesce("bytes", F.lit(0)) - F.col("length")
    short = F.when((F.col("kind") == "plain") & (F.col("length") > 0) & ~over.isin(0, 1, -3, -2),
                   F.format_string("only %d of %d bytes can be read", F.coalesce("bytes", F.lit(0)), "length"))
    return (files.drop("content").join(gzip, "file", "left").join(read, "file", "left")
            .select("file", "length", "kind", F.coalesce("reason", short).alias("reason")))
