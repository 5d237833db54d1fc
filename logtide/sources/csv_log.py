"""CSV access logs with arbitrary header names.

The header is mapped to the standard column names on the driver (metadata
only: the rename plan is computed from ``df.columns``), then a single
``select`` renames, casts and fills defaults, so the CSV scan is still pruned
and every cast runs JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.csv_text import CSV_TEXT
from ..functions.features import FEATURE_COLUMNS
from ..functions.fixed_values import (CSV_BYTES_AS_ZERO, CSV_COLUMN_ALIASES, CSV_DEFAULTS,
                                      CSV_NULL_TOKENS, CSV_REQUIRED_COLUMNS)
from ..session import require_utc
from .access_view import BASE_COLUMNS
from .csv_records import read_split_csv
from .raw_log import to_long_or_zero

# Timestamp layouts tried, in order, after the ISO-8601 cast (a [decision]:
# the reference lets pandas infer one layout; bare integers are rejected).
DEFAULT_TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss.SSSSSSXXX",
    "d/MMM/yyyy:HH:mm:ss Z",
    "d/MMM/yyyy:HH:mm:ss XXX",
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
    "dd-MM-yyyy HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSZ",
)


def rename_plan(columns: list[str]) -> dict[str, str]:
    """Raw column -> standard name.

    Headers are compared without case and outer blanks (of equal ones the last
    counts). A standard name that is there as such stays; any other standard
    column takes the header that stands first in its alias list, unless that
    header is itself a standard name or already taken.
    """
    free = {c.strip().lower(): c for c in columns}
    free = {header: c for header, c in free.items() if c not in CSV_COLUMN_ALIASES}
    plan = {}
    for std in (x for x in CSV_COLUMN_ALIASES if x not in columns):
        header = next((a.lower() for a in CSV_COLUMN_ALIASES[std] if a.lower() in free), None)
        if header is not None:
            plan[free.pop(header)] = std
    return plan


def other_names(columns: list[str], taken: tuple[str, ...]) -> dict[str, str]:
    """Names for the columns that pass through: their own, or with ``_raw``
    added as often as it takes to differ, whatever the case, from the standard
    and derived columns and from one another."""
    used = {x.lower() for x in taken}
    names = {}
    for c in columns:
        name = c
        while name.lower() in used:
            name += "_raw"
        used.add(name.lower())
        names[c] = name
    return names


def _nullify_tokens(c: Column) -> Column:
    return F.when(c.isin(*CSV_NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)


def parse_csv_timestamp(text: Column, formats: tuple[str, ...] = DEFAULT_TIMESTAMP_FORMATS) -> Column:
    """ISO-8601 text (with or without zone; no zone means UTC) or one of
    ``formats``; bare integers and anything else give null."""
    t = F.trim(text)
    parsed = F.coalesce(t.try_cast("timestamp"),
                        *[F.try_to_timestamp(t, F.lit(f)) for f in formats])
    return F.when(t.rlike(r"^[+-]?\d+$"), F.lit(None).cast("timestamp")).otherwise(parsed)


def map_and_cast(raw: DataFrame, timestamp_formats: tuple[str, ...] = DEFAULT_TIMESTAMP_FORMATS) -> DataFrame:
    """String-typed CSV frame -> typed access-log table (plus other columns).

    Rows with an unparseable timestamp or status are dropped; status must be
    an integral number that fits smallint; bytes junk is 0; absent standard
    columns get their defaults; nulls inside present columns stay null. Other
    columns keep their name unless it clashes (see ``other_names``).
    """
    require_utc(raw.sparkSession)  # zone-less timestamps are read as UTC
    plan = rename_plan(raw.columns)
    quoted = {c: F.col("`" + c.replace("`", "``") + "`").cast("string") for c in raw.columns}
    standard = {plan.get(c, c): quoted[c] for c in raw.columns if c in plan or c in BASE_COLUMNS}
    missing = sorted(set(CSV_REQUIRED_COLUMNS) - set(standard))
    if missing:
        raise ValueError(f"no column of the CSV can serve as {' or '.join(missing)} (its header: {', '.join(raw.columns)})")
    text = {name: _nullify_tokens(c) for name, c in standard.items()}
    number = text["status"].try_cast("double")
    small = number.try_cast("smallint")
    typed = {"timestamp": parse_csv_timestamp(text["timestamp"], timestamp_formats),
             "status": F.when(small.cast("double") == number, small), "bytes": F.lit(0).cast("bigint")}
    if "bytes" in standard:
        size = standard["bytes"]
        typed["bytes"] = F.when(size.isNull() | size.isin(*CSV_BYTES_AS_ZERO), F.lit(0).cast("bigint")).otherwise(
            to_long_or_zero(size))
    row = [typed.get(name, text.get(name, F.lit(CSV_DEFAULTS.get(name)).cast("string"))).alias(name)
           for name in BASE_COLUMNS]
    others = other_names([c for c in raw.columns if plan.get(c, c) not in BASE_COLUMNS], BASE_COLUMNS + FEATURE_COLUMNS)
    row += [_nullify_tokens(quoted[c]).alias(name) for c, name in others.items()]
    # Through a generator, so that the filter is not pushed below the parse,
    # which would evaluate it twice a row.
    return (raw.select(F.inline(F.array(F.struct(*row))))
            .where(F.col("timestamp").isNotNull() & F.col("status").isNotNull()))


def read_csv_log(spark: SparkSession, path: str | list[str],
                 timestamp_formats: tuple[str, ...] = DEFAULT_TIMESTAMP_FORMATS,
                 multi_line: bool | str = True) -> DataFrame:
    """CSV file(s) with a header row, all cells read as strings, then mapped.

    ``multi_line`` allows line breaks inside quoted cells; Spark then reads
    each file in one task. ``multi_line="split"`` gives the same table for RFC
    4180 text and reads large files in many tasks (see ``csv_records``).
    Without such cells, ``multi_line=False`` lets Spark itself split files.
    """
    if multi_line == "split":
        return map_and_cast(read_split_csv(spark, path), timestamp_formats)
    if not isinstance(multi_line, bool):
        raise ValueError(f"multi_line is True, False or 'split', not {multi_line!r}")
    raw = (spark.read.options(**CSV_TEXT).option("header", "true").option("inferSchema", "false")
           .option("multiLine", str(multi_line).lower()).option("mode", "PERMISSIVE").csv(path))
    return map_and_cast(raw, timestamp_formats)


def column_mapping_report(columns: list[str]) -> list[dict]:
    """Driver-side report of the rename plan: standard name, detected or
    default, and the raw header it came from."""
    plan = rename_plan(columns)
    inverse = {v: k for k, v in plan.items()}
    rows = []
    for std in CSV_COLUMN_ALIASES:
        if std in columns:
            rows.append({"standard_name": std, "status": "detected", "source_column": std})
        elif std in inverse:
            rows.append({"standard_name": std, "status": "detected", "source_column": inverse[std]})
        else:
            rows.append({"standard_name": std, "status": "default", "source_column": None})
    return rows
