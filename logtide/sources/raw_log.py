"""Raw Apache Combined log ingest: text files (plain or gzip) to the typed table.

All parsing is JVM-side: one ``regexp_replace`` per line rewrites a matching
line to its twelve groups, ``split`` turns them into an array, and ``try_*``
casts type them, all inside one whole-stage-codegen projection; there is no
Python per line. Lines are read with ``spark.read.text``; plain files split by
block, gzip files are read whole per task (pass ``repartition`` to spread the
regex work of a few huge gzip files).
"""

from __future__ import annotations

import logging
from fnmatch import fnmatchcase

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import ACCESS_LINE_PATTERN, ACCESS_TIME_FORMATS
from .access_view import BASE_COLUMNS
from .file_status import file_status

# Characters Python's ``str.strip()`` removes (derived by rule, not listed).
PY_WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# One regex pass per line: a match is rewritten to its twelve groups joined
# by U+0000 (an unmatched optional group contributes ""), so one evaluation
# replaces twelve ``regexp_extract`` calls. Lines that already contain U+0000
# take the exact per-group path instead, so the delimiter cannot collide.
def python_classes(pattern: str) -> str:
    """The pattern with Python ``str``-regex class semantics in Java syntax.

    Python's ``\\s``, ``\\S`` and ``\\d`` are Unicode-aware, Java's only under
    ``(?U)``; Python's ``\\s`` also covers U+001C..U+001F (``str.isspace``),
    which Java's Unicode ``\\s`` does not, so those are added explicitly.
    """
    ws = r"\s\x1c-\x1f"
    return "(?U)" + (pattern.replace(r"\S", "\u0001").replace(r"\s", f"[{ws}]")
                     .replace("\u0001", f"[^{ws}]"))


LINE_PATTERN = python_classes(ACCESS_LINE_PATTERN)

_SEP = "\u0000"
_WHOLE_LINE = "(?s)" + LINE_PATTERN + ".*$"
_GROUPS_JOINED = _SEP.join(f"${i}" for i in range(1, 13))


def _null_if(c: Column, value: str) -> Column:
    return F.when(c == F.lit(value), F.lit(None).cast("string")).otherwise(c)


def to_long_or_zero(text: Column) -> Column:
    """Integer text to bigint; decimal or exponent text truncates; junk is 0."""
    return F.coalesce(text.try_cast("bigint"),
                      text.try_cast("double").try_cast("bigint"),
                      F.lit(0).cast("bigint"))


def parse_access_time(text: Column) -> Column:
    """``10/Oct/2000:13:55:36 -0700`` style text to a UTC timestamp (null if bad).

    strptime's ``%d`` also takes a space-padded day (`` 5/Jan/...``); that one
    leading space is dropped before the Spark patterns are tried.
    """
    text = F.regexp_replace(text, r"^ ([1-9]/)", "$1")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(fmt)) for fmt in ACCESS_TIME_FORMATS])


def joined_groups(line: Column) -> Column:
    """Fast path: the line rewritten to its groups and split (12 parts iff it matched)."""
    return F.split(F.regexp_replace(line, _WHOLE_LINE, _GROUPS_JOINED), _SEP, -1)


def line_groups(line: Column, joined: Column) -> Column:
    """array<string> of the twelve groups of a matching line, else null."""
    exact = F.array(*[F.regexp_extract(line, LINE_PATTERN, i) for i in range(1, 13)])
    return (F.when(line.contains(_SEP), F.when(line.rlike(LINE_PATTERN), exact))
            .otherwise(F.when(F.size(joined) == 12, joined)))


def split_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Add ``line`` (valid UTF-8, stripped), ``groups``, ``is_blank`` and ``matched``.

    Each step is its own projection so the optimizer keeps one evaluation of
    the expensive expressions (it does not inline an expensive expression
    that is referenced more than once).
    """
    clean = F.btrim(F.make_valid_utf8(F.col(value_col)), F.lit(PY_WHITESPACE))
    return (lines.withColumn("line", clean)
            .withColumn("_joined", joined_groups(F.col("line")))
            .withColumn("groups", F.when(F.col("line") != F.lit(""),
                                         line_groups(F.col("line"), F.col("_joined"))))
            .drop("_joined")
            .withColumn("is_blank", F.col("line") == F.lit(""))
            .withColumn("matched", F.col("groups").isNotNull()))


def typed_columns(groups: Column) -> list[Column]:
    """The ten typed columns from the twelve groups (casts of the survey's S2)."""
    g = {i: groups.getItem(i - 1) for i in range(1, 13)}
    empty_to_null = lambda c: F.when(c == F.lit(""), F.lit(None).cast("string")).otherwise(c)
    bytes_text = _null_if(g[8], "-")
    optional = lambda outer, inner: F.when(outer == F.lit(""), F.lit(None).cast("string")).otherwise(inner)
    return [
        g[1].alias("ip"),
        _null_if(g[2], "-").alias("user"),
        parse_access_time(g[3]).alias("timestamp"),
        _null_if(empty_to_null(g[4]), "-").alias("method"),
        empty_to_null(g[5]).alias("path"),
        empty_to_null(g[6]).alias("protocol"),
        g[7].try_cast("smallint").alias("status"),
        F.when(bytes_text.isNull(), F.lit(0).cast("bigint")).otherwise(to_long_or_zero(bytes_text)).alias("bytes"),
        _null_if(optional(g[9], g[10]), "-").alias("referrer"),
        _null_if(optional(g[11], g[12]), "-").alias("user_agent"),
    ]


class ParseMetrics:
    """Parse-quality counts of one log, taken by the action that parses it.

    Give it to ``parse_lines``; ``get`` waits for the first action on the
    result and returns ``parse_quality``'s figures without a scan of their
    own. For a stream use its name: every micro-batch reports under it.
    """

    LINES = ("total_lines", "parsed_lines", "failed_lines", "blank_lines")

    def __init__(self, name: str = "parse_quality", streaming: bool = False):
        self.name, self.streaming = name, streaming
        names = (f"{name}_lines", f"{name}_rows")
        self.lines, self.rows = names if streaming else map(Observation, names)

    def of_lines(self, marked: DataFrame) -> DataFrame:
        counts = (F.count(F.lit(1)), F.count_if(F.col("matched")), F.count_if(~F.col("matched") & ~F.col("is_blank")),
                  F.count_if(F.col("is_blank")))
        return marked.observe(self.lines, *[c.alias(n) for n, c in zip(self.LINES, counts, strict=True)])

    def of_rows(self, typed: DataFrame) -> DataFrame:
        return typed.observe(self.rows, F.count(F.lit(1)).alias("rows"))

    @staticmethod
    def figures(lines: dict, rows: dict) -> dict:
        total = lines["total_lines"]
        return {**{n: lines[n] for n in ParseMetrics.LINES}, "bad_timestamps": lines["parsed_lines"] - rows["rows"],
                "parse_pct": lines["parsed_lines"] / total * 100.0 if total else None}

    def get(self) -> dict:
        return self.figures(self.lines.get, self.rows.get)


def parse_lines(lines: DataFrame, value_col: str = "value", keep: tuple[str, ...] = (),
                metrics: ParseMetrics | None = None) -> DataFrame:
    """Parse a DataFrame of log lines into the typed access-log table.

    Blank and non-matching lines give no row; rows whose timestamp cannot
    be parsed are dropped. ``keep`` names input columns to carry along;
    ``metrics`` counts all of these on the way.
    """
    marked = split_lines(lines, value_col)
    if metrics:
        marked = metrics.of_lines(marked)
    # Rows leave through a generator (one struct for a matching line, none
    # otherwise): a filter on ``matched`` would be pushed below the
    # projections and evaluate the regex a second time.
    row = F.struct(*typed_columns(F.col("groups")))
    typed = marked.select(*[F.col(k) for k in keep],
                          F.inline(F.when(F.col("matched"), F.array(row))))
    typed = typed.where(F.col("timestamp").isNotNull())
    return metrics.of_rows(typed) if metrics else typed


def parse_quality(lines: DataFrame, source_col: str = "source", value_col: str = "value") -> DataFrame:
    """Per source: total lines (blanks included), parsed (regex match), failed
    (non-blank, no match), bad timestamps (matched, then dropped) and parse %.

    One conditional-count aggregate; the source column has few values, so
    the partial aggregate makes the shuffle negligible.
    """
    marked = split_lines(lines, value_col)
    bad_ts = F.col("matched") & parse_access_time(F.col("groups").getItem(2)).isNull()
    return (marked.groupBy(source_col)
            .agg(F.count(F.lit(1)).alias("total_lines"),
                 F.count_if(F.col("matched")).alias("parsed_lines"),
                 F.count_if(~F.col("matched") & ~F.col("is_blank")).alias("failed_lines"),
                 F.count_if(F.col("is_blank")).alias("blank_lines"),
                 F.count_if(bad_ts).alias("bad_timestamps"))
            .withColumn("parse_pct", F.col("parsed_lines") / F.col("total_lines") * F.lit(100.0))
            .orderBy(source_col))


def _matching(spark: SparkSession, glob: str) -> list[str]:
    """Paths that a Hadoop glob matches, hidden ones included."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().toString() for f in found or []]


def _refuse_hidden(spark: SparkSession, paths: list[str], pattern: str | None) -> None:
    """Spark's readers pass over names that begin with ``_`` or ``.`` without a
    word; a log that would be lost that way is an error instead."""
    if pattern is None:  # a file's own name, and what lies in a folder (but for Spark's markers and checksums)
        hidden = [p for p in paths if p.rstrip("/").rsplit("/", 1)[-1][:1] in ("_", ".")]
        hidden += [x for p in paths for x in _matching(spark, p.rstrip("/") + "/[_.]*")
                   if not x.endswith(("/_SUCCESS", ".crc"))]
    else:
        *folders, name = pattern.split("/")
        hidden = []
        for p in paths:
            base = p.rstrip("/")
            for depth in range(len(folders)):  # folders that the pattern names or matches
                found = _matching(spark, "/".join([base, *folders[:depth], "[_.]*"]))
                hidden += [x for x in found if fnmatchcase(x.rsplit("/", 1)[-1], folders[depth])]
            found = _matching(spark, "/".join([base, *folders, "[_.]*"]))
            hidden += [x for x in found if fnmatchcase(x.rsplit("/", 1)[-1], name)]
    if hidden:
        raise ValueError(f"Spark does not read files or folders whose name begins with '_' or '.': {sorted(hidden)[:20]}. "
                         "Rename them, or give a pattern that leaves them out (such as '[!_.]*.log').")


def _load(reader: DataFrameReader, spark: SparkSession, path: str | list[str], pattern: str | None) -> DataFrame:
    """The files that ``path`` and ``pattern`` name, by any reader."""
    paths = [path] if isinstance(path, str) else list(path)
    if pattern and "**" in pattern.split("/"):
        raise ValueError(f"'**' is not supported in a pattern ('{pattern}'): name the folders, as in '*/*.log'")
    _refuse_hidden(spark, paths, pattern)
    if pattern and "/" in pattern:
        folder, pattern = pattern.rsplit("/", 1)
        paths = [f"{p.rstrip('/')}/{folder}" for p in paths]
    if pattern:
        reader = reader.option("pathGlobFilter", pattern.replace("[!", "[^"))
    try:
        return reader.load(paths)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise FileNotFoundError(f"no such log: {', '.join(paths)}") from exc
        raise


def read_log_lines(spark: SparkSession, path: str | list[str], pattern: str | None = None,
                   repartition: int | None = None) -> DataFrame:
    """Raw lines (``value``) with their file (``source``); gzip by extension.

    ``pattern`` names files inside the folder ``path``; it may hold folders
    (``2024-*/*.log``) but not ``**``. A file that cannot be read to its end
    fails the query; a name that Spark would pass over is refused.
    """
    df = _load(spark.read.format("text"), spark, path, pattern).select("value", F.col("_metadata.file_path").alias("source"))
    if repartition:
        df = df.repartition(repartition)
    return df


def unreadable_files(spark: SparkSession, files: list[str]) -> list[tuple[str, str]]:
    """(file, reason) of the files that cannot be read to their end.

    All files are read in one job; only where that fails are they halved, so
    k faulty files among n take about k log2(n) jobs, on the executors.
    """
    if not files:
        return []
    try:
        spark.read.text(files).agg(F.sum(F.length("value"))).collect()
        return []
    except Exception as exc:  # noqa: BLE001 - told apart below
        text = str(exc)
        if "FAILED_READ_FILE" not in text:
            raise
        if len(files) == 1:
            cause = [x.strip() for x in text.splitlines() if x.startswith("Caused by:") or "Exception:" in x]
            return [(files[0], (cause or text.splitlines())[-1][:300])]
    half = len(files) // 2
    return unreadable_files(spark, files[:half]) + unreadable_files(spark, files[half:])


def _typed(raw: DataFrame, check: bool, nothing: str, repartition: int | None, metrics: ParseMetrics | None = None) -> DataFrame:
    """The typed table. ``check`` raises if no line matches: a ``limit 1``
    probe on the unshuffled read. A log whose lines match but whose times are
    all bad is an empty table."""
    if check and split_lines(raw).where("matched").isEmpty():
        raise ValueError(nothing)
    lines = raw.repartition(repartition) if repartition else raw
    return parse_lines(lines, metrics=metrics).select(*BASE_COLUMNS)


def parse_log_file(spark: SparkSession, path: str, check: bool = True,
                   repartition: int | None = None, metrics: ParseMetrics | None = None) -> DataFrame:
    """Typed table of one log file (plain or ``.gz``).

    Raises FileNotFoundError for a missing path and, when ``check``, a
    ValueError if no line matches.
    """
    return _typed(read_log_lines(spark, path), check,
                  f"No valid Apache log lines found in '{path}': no line has the Combined layout", repartition, metrics)


def batch_parse(spark: SparkSession, log_dir: str, pattern: str = "*.log",
                check: bool = True, repartition: int | None = None, metrics: ParseMetrics | None = None) -> DataFrame:
    """All files of ``log_dir`` matching ``pattern`` in one scan.

    A file without valid lines adds no rows; an unreadable file fails the
    query (see ``batch_parse_readable``). Raises FileNotFoundError if no file
    matches and, when ``check``, ValueError if no line of any file matches.
    The file list is consulted only when nothing was read, so a folder of
    millions of files is never copied into Python.
    """
    raw = read_log_lines(spark, log_dir, pattern)
    if raw.isEmpty() and not raw.inputFiles():
        raise FileNotFoundError(f"'{log_dir}' has no file like '{pattern}'")
    return _typed(raw, check, f"No valid Apache log lines found in the files '{pattern}' of '{log_dir}'", repartition, metrics)


def log_file_status(spark: SparkSession, log_dir: str, pattern: str | None = "*.log") -> DataFrame:
    """(file, length, kind, reason) of every file; see ``file_status``."""
    return file_status(spark, lambda reader: _load(reader, spark, log_dir, pattern))


def readable_lines(spark: SparkSession, log_dir: str, pattern: str | None = "*.log") -> tuple[DataFrame, list[tuple[str, str]]]:
    """The lines of the readable files, and (file, reason) of the others.

    Two scans: one judges the files, the next reads them. Only faulty files,
    and those that ``file_status`` leaves open (other codecs, very large gzip
    files), come to the driver by name. Faulty ones are pruned from the second
    scan's file list, so a file that fails it all the same fails the query.
    """
    status = log_file_status(spark, log_dir, pattern)
    found = status.where("reason IS NOT NULL OR kind = 'other'").collect()
    open_ones = sorted(r.file for r in found if r.reason is None)
    skipped = sorted([(r.file, r.reason) for r in found if r.reason is not None] + unreadable_files(spark, open_ones))
    for name, reason in skipped:
        logging.getLogger(__name__).warning("left out %s: %s", name, reason)
    raw = read_log_lines(spark, log_dir, pattern)
    if skipped:
        raw = raw.where(~F.col("source").isin([name for name, _ in skipped]))
    return raw, skipped


def batch_parse_readable(spark: SparkSession, log_dir: str, pattern: str = "*.log", check: bool = True, repartition: int | None = None,
                         metrics: ParseMetrics | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``batch_parse`` of the readable files, and (file, reason) of the others.

    A faulty file is left out whole, none of its lines are used.
    """
    raw, skipped = readable_lines(spark, log_dir, pattern)
    if raw.isEmpty():
        files = raw.inputFiles()
        if not files:
            raise FileNotFoundError(f"'{log_dir}' has no file like '{pattern}'")
        if len(files) == len(skipped):
            raise ValueError(f"none of the files '{pattern}' of '{log_dir}' can be read: {skipped[:5]}")
    nothing = f"No valid Apache log lines found in the files '{pattern}' of '{log_dir}'"
    return _typed(raw, check, nothing, repartition, metrics), skipped
