"""CSV records whose quoted cells may hold line breaks, assembled by many tasks.

Files are read as lines in blocks. A line break ends a record only where the
number of quotes before it in the file is even, so a block can be cut into
records once the parity at its start is known: the quotes of each block are
counted in a first pass, and their prefix sums per file give one bit a block.
In the second pass every task cuts its own blocks. What a record leaves in
each of several blocks (its tail, whole blocks, its head) meets in a small
shuffle of these fragments.

The rule holds for RFC 4180 text. A quote inside an unquoted cell, a quoted
cell that doesn't end its cell, a file whose last quote stays open, a file
with bare CR line ends, and files with different headers are errors; reading
whole files (``multi_line=True``) takes those as Spark's own reader does.

Defined results
    * blank lines (nothing between two line ends) are no records; the first
      record of each file is its header.
    * where a file's first line ends in CR LF, CR LF counts as one line break,
      also in cells, which hold LF then; else CR is an ordinary character.
    * null, short and long records: as Spark's reader does (missing cells are
      null, surplus ones are dropped).
    * empty files give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.csv_text import CSV_TEXT
from ..session import ensure_checkpoint_dir

#: Blocks whose parities are broadcast (about 150 bytes each); beyond it, lines are joined by a shuffle.
MOST_BROADCAST = 1 << 18
WHOLE, HEAD, INNER, TAIL = range(4)
MARK = "\u0001"


def file_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line, file, block, length, place): ``place`` ascends within a block."""
    meta = [F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start", "file_block_length")]
    return (spark.read.format("text").option("lineSep", "\n").load(path)
            .select(F.col("value").alias("line"), *[c.alias(n) for c, n in zip(meta, ("file", "block", "length"), strict=True)],
                    F.monotonically_increasing_id().alias("place")))


def quote_count(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))


def block_states(lines: DataFrame) -> DataFrame:
    """(file, block, length, inside, crlf, unclosed, first): whether a block
    starts inside a cell; the file's line ends and first line with text."""
    ends_in_cr = F.endswith("line", F.lit("\r"))
    blank = F.rtrim("line", F.lit("\r")) == ""
    blocks = lines.groupBy("file", "block", "length").agg(
        (F.sum(quote_count(F.col("line"))) % 2).alias("odd"), F.min_by(ends_in_cr, "place").alias("cr"),
        F.min_by(F.when(~blank, F.rtrim("line", F.lit("\r"))), F.when(~blank, F.col("place"))).alias("text"))
    in_file = Window.partitionBy("file").orderBy("block")  # a row a block, whatever its size
    before = F.sum("odd").over(in_file.rowsBetween(Window.unboundedPreceding, -1))
    whole = in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return blocks.select("file", "block", "length", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"),
                         F.first("cr").over(whole).alias("crlf"), (F.sum("odd").over(whole) % 2 == 1).alias("unclosed"),
                         F.first("text", ignorenulls=True).over(whole).alias("first"))


class _Block:
    """What is open in the block that is being read."""

    def __init__(self, key: tuple, inside: bool, crlf: bool):
        self.key, self.crlf, self.odd = key, crlf, int(inside)
        self.pending: list[pa.Array] = []
        self.began = not inside  # whether the open record began in this block
        self.header = key[1] != 0  # whether the header has been seen


def _joined(parts: list[pa.Array]) -> str:
    return "\n".join(x for part in parts for x in part.to_pylist())


def cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, kind, header, crlf, text) of lines in the order of their blocks."""
    now: _Block | None = None

    def rows(texts: pa.Array, kind: int) -> Iterator[pa.RecordBatch]:
        n = len(texts)
        header = np.zeros(n, dtype=bool)
        if not now.header and kind in (WHOLE, TAIL):
            text = pc.not_equal(pc.utf8_rtrim(texts, "\r"), "").to_numpy(zero_copy_only=False)
            if text.any():
                header[np.argmax(text)] = now.header = True
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(now.key[0], n), pa.repeat(now.key[1], n), pa.array(np.full(n, kind, dtype=np.int32)), pa.array(header),
                 pa.array(np.full(n, now.crlf)), texts], names=["file", "block", "kind", "header", "crlf", "text"])

    def finish() -> Iterator[pa.RecordBatch]:
        if now and now.pending:
            yield from rows(pa.array([_joined(now.pending)], pa.string()), TAIL if now.began else INNER)

    for batch in batches:
        lines, files, blocks = (batch.column(i) for i in range(3))
        starts = blocks.to_numpy(zero_copy_only=False)
        names = files.dictionary_encode()
        edges = np.flatnonzero(np.diff(starts, prepend=-1) | np.diff(names.indices.to_numpy(zero_copy_only=False), prepend=-1))
        for lo, hi in zip(edges, [*edges[1:], len(starts)], strict=True):
            key = (files[lo].as_py(), int(starts[lo]))
            if now is None or now.key != key:
                yield from finish()
                now = _Block(key, batch.column(3)[lo].as_py(), batch.column(4)[lo].as_py())
            part = lines.slice(lo, hi - lo)
            quotes = pc.count_substring(part, '"').to_numpy(zero_copy_only=False)
            ends = (now.odd + np.cumsum(quotes)) % 2
            opens = np.flatnonzero(np.concatenate([[now.odd], ends[:-1]]) == 0)  # lines that begin a record
            now.odd = int(ends[-1])
            if not len(opens):
                now.pending.append(part)
                continue
            if opens[0] or now.pending:
                now.pending.append(part.slice(0, opens[0]))
                yield from rows(pa.array([_joined(now.pending)], pa.string()), WHOLE if now.began else HEAD)
                now.pending = []
            now.began = True
            done = opens if now.odd == 0 else opens[:-1]
            end = len(part) if now.odd == 0 else opens[-1]
            if now.odd:
                now.pending = [part.slice(end)]
            if len(done):
                body = part.slice(done[0], end - done[0])
                if len(done) < len(body):
                    offsets = pa.array(np.append(done, end) - done[0], pa.int32())
                    body = pc.binary_join(pa.ListArray.from_arrays(offsets, body), "\n")
                yield from rows(body, WHOLE)
    yield from finish()


def with_fragments(cut: DataFrame) -> DataFrame:
    """Whole records, and those put together from their fragments."""
    names = ["file", "header", "crlf", "text"]
    in_file = Window.partitionBy("file").orderBy("block", "kind")  # two rows a block at most
    fragments = (cut.where(F.col("kind") != WHOLE)
                 .withColumn("record", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(in_file)))
    met = fragments.groupBy("file", "record").agg(
        F.max("header").alias("header"), F.max("crlf").alias("crlf"),
        F.sort_array(F.collect_list(F.struct("block", "kind", "text"))).alias("parts"))  # one record's text
    joined = met.withColumn("text", F.concat_ws("\n", F.transform("parts", lambda p: p["text"])))
    return cut.where(F.col("kind") == WHOLE).select(*names).unionByName(joined.select(*names))


def stray_quotes(record: Column) -> Column:
    """Whether a quote stands elsewhere than around whole cells or doubled in them."""
    cells = F.regexp_replace(F.translate(record, MARK, "x"), '"[^"]*"', MARK)
    return record.contains('"') & (cells.rlike(f'[^,{MARK}]{MARK}|{MARK}[^,{MARK}]') | cells.contains('"'))


def split_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, header, text): the records of CSV files. Reads the files once at
    once, to count quotes, and again where the result is used."""
    lines = file_lines(spark, path)
    ensure_checkpoint_dir(spark)
    states = block_states(lines).checkpoint()
    odd = states.where("unclosed").select("file").limit(1).collect()
    if odd:
        raise ValueError(f"the last quote of '{odd[0].file}' is not closed")
    texts = states.where("block = 0").agg(F.min("first").alias("a"), F.max("first").alias("b")).first()
    if texts.a != texts.b:
        raise ValueError(f"the files have different headers: '{texts.a}' and '{texts.b}'")
    if texts.a is not None and "\r" in texts.a:
        raise ValueError("a line break by CR alone is not supported here; read the files whole (multi_line=True)")
    states = states.select("file", "block", "length", "inside", "crlf")
    key = ["file", "block", "length"]
    if states.count() <= MOST_BROADCAST:  # the lines stay where and as they were read
        marked = lines.join(F.broadcast(states), key, "left")
    else:
        marked = lines.join(states, key, "left").repartition("file", "block").sortWithinPartitions("file", "block", "place")
    changed = F.raise_error(F.lit("the files, or how Spark splits them, changed between two passes; read them again"))
    marked = marked.select("line", "file", "block", F.coalesce("inside", changed.cast("boolean")).alias("inside"), "crlf")
    cut = marked.mapInArrow(cut_records, "file string, block long, kind int, header boolean, crlf boolean, text string")
    text = F.when(F.col("crlf"), F.replace(F.regexp_replace("text", "\r\\z", ""), F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text"))
    return with_fragments(cut).select("file", "header", text.alias("text")).where("text <> ''")


def read_split_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All cells as strings under the names that Spark's reader gives them."""
    reader = spark.read.options(**CSV_TEXT).options(header="true", inferSchema="false", multiLine="true")
    names = reader.csv(path).columns  # reads the first record only
    records = split_records(spark, path).where(~F.col("header"))
    wrong = F.raise_error(F.concat(F.lit("a quote inside an unquoted cell, or text after a quoted one, in '"), F.col("file"), F.lit(
        "'; read the files whole (multi_line=True)")))
    text = F.when(stray_quotes(F.col("text")), wrong.cast("string")).otherwise(F.col("text"))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    row = F.from_csv(text, schema, {**CSV_TEXT, "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
    return records.select(row.alias("row")).select("row.*").toDF(*names)
