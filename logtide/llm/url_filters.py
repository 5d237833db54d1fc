"""URL filters: allow and block rules on host suffixes and path prefixes.

Each distinct URL is expanded into its (host suffix, directory prefix)
expressions; rules are keyed by their own (host, directory) expression. The
two are equi-joined on the first four bytes of the expression's SHA-256; a
match is confirmed by the whole digest and by the part of the rule's path
after its last slash. DataFrame functions only.

Defined results
    * null URL, or one without ``://``: empty host and path, default verdict.
    * a rule fits a URL whose host is the rule's or a subdomain of it and
      whose path starts with the rule's path (character by character).
    * precedence: the longest rule (host + path), then the longest host, then
      ``block`` before any other verdict, then the smallest verdict.
    * repeated rows stay, each judged alike; an empty page or rule table is fine.
    * columns of the input that are not asked for do not matter, whatever
      their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

RULE_SCHEMA = "host string, path string, verdict string"
HASH_PREFIX_HEX = 8


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows as a literal relation, whose size Spark knows."""
    if not rules:
        return spark.createDataFrame([], RULE_SCHEMA)
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict"))
                     for h, p, v in rules])
    return spark.range(1).select(F.inline(rows))


def url_host(url: Column) -> Column:
    rest = _after_scheme(url)
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    rest = _after_scheme(url)
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def _digest(host: Column, directory: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\u0000"), directory), 256)


def _keyed_rules(rules: DataFrame) -> DataFrame:
    host = ascii_lower(F.coalesce("host", F.lit("")))
    path = F.coalesce("path", F.lit(""))
    directory = F.regexp_extract(path, "(?s)^(.*/)?", 0)
    return rules.select(
        F.substring(_digest(host, directory), 1, HASH_PREFIX_HEX).alias("rule_key"),
        _digest(host, directory).alias("rule_digest"),
        path.alias("rule_path"), F.concat(host, path).alias("rule"), "verdict",
        F.length(host).alias("host_chars"),
        F.size(F.split(host, r"\.")).alias("labels"),
        (F.size(F.split(directory, "/")) - 1).alias("slashes"))


def url_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict) of each distinct value of the one column of
    ``urls`` that some rule fits."""
    keyed = _keyed_rules(rules)
    # No rule is deeper than these two numbers, so neither need an expression be.
    labels, slashes = keyed.agg(F.coalesce(F.max("labels"), F.lit(0)),
                                F.coalesce(F.max("slashes"), F.lit(0))).first()
    seen = urls.toDF("url").where("url IS NOT NULL").distinct()
    seen = seen.select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    parts = seen.select("url", "path", F.split("host", r"\.").alias("parts"), F.split("path", "/").alias("steps"))
    suffixes = F.when(F.lit(labels) > 0, F.transform(
        F.sequence(F.lit(1), F.least(F.size("parts"), F.greatest(F.lit(labels), F.lit(1)))),
        lambda k: F.array_join(F.slice("parts", -k, k), ".")))
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size("steps") - 1, F.lit(slashes))),
        lambda k: F.when(k == 0, F.lit("")).otherwise(
            F.concat(F.array_join(F.slice("steps", 1, F.greatest(k, F.lit(1))), "/"), F.lit("/"))))
    expressions = (parts.select("url", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
                   .select("url", "path", "suffix", F.explode("prefixes").alias("prefix"))
                   .select("url", "path", _digest(F.col("suffix"), F.col("prefix")).alias("digest"))
                   .withColumn("key", F.substring("digest", 1, HASH_PREFIX_HEX)))
    fitting = (expressions.join(keyed, F.col("key") == F.col("rule_key"))
               .where((F.col("digest") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path"))))
    best = F.struct((-F.length("rule")).alias("a"), (-F.col("host_chars")).alias("b"),
                    (F.col("verdict") != "block").alias("c"), F.col("verdict").alias("d"), F.col("rule").alias("e"))
    return (fitting.groupBy("url").agg(F.min(best).alias("best"))
            .select("url", F.col("best.e").alias("rule"), F.col("best.d").alias("verdict")))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", keys: tuple[str, ...] = ("page_id",),
                default: str = "allow") -> DataFrame:
    """``keys``, host, path, rule (null: none fits) and verdict of every row.

    Only URLs that a rule fits are joined back; a URL that holds a third of
    all rows is one row of the distinct set, and its rows are split by AQE's
    skew join when the verdicts are too large to broadcast.
    """
    rows = pages.select(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], F.col(url_col).alias("url"))
    verdicts = url_verdicts(rows.select("url"), rules)
    judged = rows.join(verdicts, "url", "left")
    return judged.select(*[F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)],
                         url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
                         "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
