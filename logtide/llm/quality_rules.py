"""Quality rules as a short-circuit cascade.

Each rule rejects a text by one expression. Rules are timed and their
rejection rates measured on a bounded sample; the cascade then tests them in
the order of rejection per cost and stops at the first that rejects. The
order changes the time only: a text is kept if no rule rejects it.
DataFrame functions only.

Defined results
    * null text: as an empty one (no words), which ``few_words`` rejects.
    * words are runs of characters other than space and U+0009 to U+000D.
    * ``n_repeat_words`` compares 8-word windows by 64-bit hashes; it sorts
      (hash, position) pairs, so a very long text costs n log n.
    * repeated rows are judged alike; empty tables give no rows; columns that
      are not asked for do not matter, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh_name

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Documented bounds of the sample that orders the rules (never decides them):
#: so many rows of at most so many characters reach the driver.
SAMPLE_ROWS = 500
SAMPLE_SHARE = 0.1
SAMPLE_CHARS = 50_000


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, and only when needed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def without(text: Column, characters: str) -> Column:
    for ch in characters:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def n_symbols(text: Column) -> Column:
    return F.length(text) - F.length(without(text, SYMBOLS))


def full_lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    return bound(full_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def n_repeat_words(words: Column) -> Column:
    """Words inside windows of eight that occur twice or more in the text."""
    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bound(pairs, lambda p: bound(
            F.sort_array(F.transform(
                F.filter(p, lambda x, k: (x["h"].eqNullSafe(F.get(p, k - 1)["h"]))
                         | (x["h"].eqNullSafe(F.get(p, k + 1)["h"]))),
                lambda x: x["i"])),
            lambda starts: F.aggregate(
                starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                lambda acc, i: F.struct(
                    (acc["n"] + F.lit(WINDOW) - F.greatest(F.lit(0), acc["end"] - i)).alias("n"),
                    (i + F.lit(WINDOW)).alias("end")))["n"]))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
                          lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) > WINDOW, bound(windows, lambda hashes: F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes), covered(hashes)).otherwise(F.lit(0)))).otherwise(F.lit(0))


def adjacent_repeats(words: Column) -> Column:
    """Words equal to the one before them."""
    return F.size(F.filter(words, lambda w, i: (i > 0) & w.eqNullSafe(F.get(words, i - 1))))


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Column, Column], Column]  # of (text, words)


def letters(text: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(text, rf"\P{{{kind}}}+", ""))


#: The base rules of the contract, then the method's own thresholds.
RULES = (
    Rule("few_words", lambda text, words: F.size(words) < 20),
    Rule("repeated_windows", lambda text, words: 100 * n_repeat_words(words) > 30 * F.size(words)),
    Rule("symbols", lambda text, words: 10 * n_symbols(text) > F.size(words)),
    Rule("capitals", lambda text, words: 2 * letters(text, "Lu") > letters(text, "L")),
    Rule("repeated_lines", lambda text, words: bound(
        full_lines(text), lambda x: 2 * (F.size(x) - F.size(F.array_distinct(x))) > F.size(x))),
    Rule("stutter", lambda text, words: 5 * adjacent_repeats(words) > F.size(words)),
    Rule("no_letters", lambda text, words: 10 * F.size(F.filter(words, lambda w: w.rlike(r"\p{L}")))
         < 6 * F.size(words)),
)


def estimate(sample: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, float, float]]:
    """(rule, seconds on the sample beyond a bare count, share rejected)."""
    def timed(expr: Column) -> tuple[float, float]:
        began = time.perf_counter()
        share = sample.agg(F.avg(expr.cast("double"))).first()[0]
        return time.perf_counter() - began, share or 0.0

    idle = min(timed(F.size("words") < 0)[0] for _ in range(2))
    out = []
    for rule in rules:
        seconds, share = timed(rule.rejects(F.col("text"), F.col("words")))
        out.append((rule.name, max(seconds - idle, 1e-4), share))
    return out


def ordered(rules: tuple[Rule, ...], estimates: list[tuple[str, float, float]]) -> tuple[Rule, ...]:
    """Highest rejection per second first; ties by the given order."""
    gain = {name: share / seconds for name, seconds, share in estimates}
    return tuple(sorted(rules, key=lambda r: -gain.get(r.name, 0.0)))


def cascade(text: Column, words: Column, rules: tuple[Rule, ...]) -> Column:
    """Name of the first rule, in this order, that rejects; null: kept."""
    verdict = None
    for rule in rules:
        test = rule.rejects(text, words)
        verdict = F.when(test, rule.name) if verdict is None else verdict.when(test, rule.name)
    return F.lit(None).cast("string") if verdict is None else verdict


def _prepared(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumn("words", words_of(F.col("text")))


def plan_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """``rules`` in the order that a sample suggests; ``take`` reads no more
    partitions than it needs for it."""
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    sample = docs.sparkSession.createDataFrame(texts.sample(SAMPLE_SHARE, 7).take(SAMPLE_ROWS), "text string")
    return ordered(rules, estimate(_prepared(sample, "text", []), rules))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text",
            rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept of every row."""
    plan = plan_rules(docs, text, rules)
    rows = _prepared(docs, text, [F.col(key).alias("key")])
    body, words = F.col("text"), F.col("words")
    figures = rows.select(
        "key", F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        n_symbols(body).cast("long").alias("n_symbols"), n_dup_lines(body).cast("long").alias("n_dup_lines"),
        n_repeat_words(words).cast("long").alias("n_repeat_words"),
        cascade(body, words, tuple(r for r in plan if r.name not in ("few_words", "repeated_windows"))).alias("by"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return figures.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                          "n_repeat_words", failed.alias("base_failed"),
                          (~failed & F.col("by").isNull()).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects."""
    plan = plan_rules(docs, text, rules)
    body = F.coalesce(F.col(text), F.lit(""))
    mark = fresh_name(docs, "rejected_by")
    return (docs.withColumn(mark, bound(words_of(body), lambda words: cascade(body, words, plan)))
            .where(F.col(mark).isNull()).drop(mark))
