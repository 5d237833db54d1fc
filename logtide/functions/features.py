"""Derived columns of the access-log table (time parts, status flags, bot flag)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed_values import (BOT_SIGNATURES, CATEGORY_CLIENT_ERROR, CATEGORY_REDIRECT,
                           CATEGORY_SERVER_ERROR, CATEGORY_SUCCESS)

FEATURE_COLUMNS = ("hour", "day_of_week", "date", "is_success", "is_redirect",
                   "is_client_error", "is_server_error", "is_error", "is_bot")

# Unicode-aware case folding, as a case-insensitive Python search does.
BOT_REGEX = "(?iu)(" + "|".join(BOT_SIGNATURES) + ")"


def bot_flag(user_agent: Column) -> Column:
    """Case-insensitive signature search; a null agent is not a bot."""
    return F.coalesce(user_agent.rlike(BOT_REGEX), F.lit(False))


def status_category(status: Column) -> Column:
    """Label of a status code; 1xx falls in the first bucket, 6xx+ in the last."""
    return (F.when(status < 300, F.lit(CATEGORY_SUCCESS))
            .when(status < 400, F.lit(CATEGORY_REDIRECT))
            .when(status < 500, F.lit(CATEGORY_CLIENT_ERROR))
            .otherwise(F.lit(CATEGORY_SERVER_ERROR)))


def utc_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def utc_date(ts: Column) -> Column:
    return F.date_from_unix_date(F.floor(utc_seconds(ts) / 86400).cast("int"))


def utc_hour_start(ts: Column) -> Column:
    return F.timestamp_seconds(F.floor(utc_seconds(ts) / 3600) * 3600)


def add_features(df: DataFrame) -> DataFrame:
    """Add hour, day_of_week, date, five status flags and is_bot.

    One narrow projection: stays inside the scan's whole-stage codegen span.
    Time parts are UTC, whatever the session's time zone. A column whose name differs from
    a derived one by case only (``Date``) is kept, as ``Date_raw``.
    """
    taken, names = {c.lower() for c in df.columns}, []
    for c in df.columns:
        name = c
        while c not in FEATURE_COLUMNS and name.lower() in FEATURE_COLUMNS or name != c and name.lower() in taken:
            name += "_raw"
        taken.add(name.lower())
        names.append(name)
    if names != df.columns:
        df = df.toDF(*names)
    ts = F.col("timestamp")
    status = F.col("status")
    return df.withColumns({
        "hour": F.pmod(F.floor(utc_seconds(ts) / 3600), F.lit(24)).cast("int"),
        "day_of_week": F.date_format(utc_date(ts), "EEEE"),
        "date": utc_date(ts),
        "is_success": status.between(200, 299),
        "is_redirect": status.between(300, 399),
        "is_client_error": status.between(400, 499),
        "is_server_error": status >= 500,
        "is_error": status >= 400,
        "is_bot": bot_flag(F.col("user_agent")),
    })


def ensure_features(df: DataFrame) -> DataFrame:
    """Add the derived columns unless they are already present."""
    if all(c in df.columns for c in FEATURE_COLUMNS):
        return df
    return add_features(df.drop(*[c for c in FEATURE_COLUMNS if c in df.columns]))


def half_even(col: Column, digits: int) -> Column:
    """Round as pandas/numpy ``round`` does: scale by 10**digits, round the
    scaled double half to even (``rint``), scale back. ``bround`` rounds the
    decimal expansion instead and differs near ties (0.00015 -> 0.0002,
    where numpy gives 0.0001)."""
    scale = F.lit(float(10 ** digits))
    return F.rint(col.cast("double") * scale) / scale
