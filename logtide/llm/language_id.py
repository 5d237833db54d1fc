"""Language identification by word-first backoff.

Per language, log relative frequencies of lower-case words and of character
n-grams (with a blank on either side of the word) are learned from labelled
texts. A word that the model knows is scored by its word frequencies; any
other by the longest n-grams of it that the model knows, one size shorter at
a time; what a language has not seen costs PENALTY. A text's score per
language is the mean over its words; the smallest cost wins.

The classifier is fitted on a bounded sample of the labelled rows: all rows of a
language that has at most SAMPLE_CHARS characters, else each whole row with the
probability that makes about so many, by a hash of its key and text (and always the
row of the least hash). Every word and n-gram of the sampled rows is kept with its
exact counts there, so what is collected and broadcast is bounded per language by
the sample alone. Predictions read every row and the whole text.

Defined results
    * null text, or one without a letter: ``und``, score 0; so is every text if
      nothing was learned.
    * equal costs: the language with more training words, then by name.
    * a null key is never held out; rows with null language or text, and those
      whose key is null or held out, teach nothing.
    * repeated rows count as often as they occur; empty tables give no rows;
      columns that are not asked for do not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, staged

SIZES = (4, 3, 2, 1)
#: Characters of the labelled rows of a language that the classifier is fitted on, about.
SAMPLE_CHARS = 4_000_000
#: Cost (negative log10) of what a language hasn't seen.
PENALTY = 7.0
FOLDS, HELD = 3, 1
UNKNOWN = "und"
#: Partial counts of a task are handed on once it holds this many.
FLUSH = 400_000
#: Scores of unseen words that a worker remembers.
REMEMBERED = 200_000
WORD = re.compile(r"[^\W\d_]+")


def is_held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def ngrams(word: str, size: int) -> list[str]:
    padded = f" {word} "
    return [padded[i:i + size] for i in range(len(padded) - size + 1)]


class Model(NamedTuple):
    languages: list[str]  # most training words first
    words: dict[str, int]  # row of ``costs``
    grams: dict[str, int]
    costs: np.ndarray  # row, language


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on the sampled rows among those that are not held out.

    Tasks count words in Python and hand on partial counts; n-gram counts
    follow from the summed word counts, so each distinct word is cut once.
    """
    known = docs.where(F.col(key).isNotNull() & ~is_held_out(F.col(key))
                       & F.col(lang).isNotNull() & F.col(text).isNotNull())
    draw = F.xxhash64(F.col(key).cast("string"), F.col(text)) / F.lit(2.0 ** 64) + F.lit(0.5)
    known = known.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), draw.alias("draw"))
    rates = known.groupBy("lang").agg((F.lit(float(sample_chars)) / F.sum(F.length("text") + 1)).alias("rate"),
                                      F.min("draw").alias("least"))
    # one row per language
    known = (known.join(F.broadcast(checkpointed(rates)), "lang").where("rate >= 1 OR draw < rate OR draw = least")
             .select("lang", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            rows = [(x, w, n) for x, c in seen.items() for w, n in c.items()]
            seen.clear()
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()),
                                               pa.array(columns[2], pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for language, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen[language].update(words_of(value.as_py()))
            if sum(map(len, seen.values())) > FLUSH:
                yield out()
        yield out()

    words = staged(known.mapInArrow(count, "lang string, word string, n long")
                   .groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    totals = dict(words.groupBy("lang").agg(F.sum("n")).collect())
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    grams = words.select("lang", "n", F.explode(F.concat(*[_cut(padded, size) for size in SIZES])).alias("item"))
    grams = checkpointed(grams.groupBy("lang", "item").agg(F.sum("n").alias("n")))
    languages = sorted(totals, key=lambda x: (-totals[x], x))
    found = [words.select("lang", F.col("word").alias("item"), F.lit(0).alias("size"), "n").toPandas(),
             grams.select("lang", "item", F.length("item").alias("size"), "n").toPandas()]
    maps, costs = zip(*(_costs(x, languages) for x in found), strict=True)
    start = len(maps[0])
    return Model(languages, maps[0], {g: start + row for g, row in maps[1].items()}, np.concatenate(costs))


def _costs(counts: pd.DataFrame, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """(row of each item, costs by row and language) from its counts per language."""
    total = counts.groupby(["lang", "size"])["n"].transform("sum")
    row, items = pd.factorize(counts["item"])
    place = counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64)
    costs = np.full((len(items), len(languages)), PENALTY)
    costs[row, place] = np.minimum(PENALTY, -np.log10((counts["n"] / total).to_numpy(dtype=float)))
    return {item: i for i, item in enumerate(items)}, costs


def _cut(padded: Column, size: int) -> Column:
    """The n-grams of that size; none if the word is shorter."""
    starts = F.sequence(F.lit(1), F.length(padded) - size + 1)
    return F.when(F.length(padded) < size, F.array().cast("array<string>")).otherwise(
        F.transform(starts, lambda i: F.substring(padded, i, F.lit(size))))


def word_cost(model: Model, word: str) -> np.ndarray | None:
    """Cost per language; null if not even a letter of it is known."""
    row = model.words.get(word)
    if row is not None:
        return model.costs[row]
    for size in SIZES:
        rows = [r for g in ngrams(word, size) if (r := model.grams.get(g)) is not None]
        if rows:
            return model.costs[rows].mean(axis=0)
    return None


def classify(model: Model, text: str | None, memory: dict[str, np.ndarray | None]) -> tuple[str, float]:
    """(language, score): the score is the softmax of the mean log likelihoods."""
    words = Counter(words_of(text or ""))
    if not words or not model.languages:
        return UNKNOWN, 0.0
    if not any(map(str.isalpha, words)) and not any(map(str.isalpha, text)):  # signs such as superscripts
        return UNKNOWN, 0.0
    rows, weights, costs, unseen = [], [], np.zeros(len(model.languages)), 0
    for word, n in words.items():
        row = model.words.get(word)
        if row is not None:
            rows.append(row)
            weights.append(n)
            continue
        if word not in memory:
            memory[word] = word_cost(model, word)
        cost = memory[word]
        if cost is None:
            unseen += n
        else:
            costs = costs + n * cost
    if rows:
        costs = costs + np.asarray(weights, dtype=float) @ model.costs[rows]
    mean = (costs + unseen * PENALTY) / sum(words.values())
    best = int(mean.argmin())
    return model.languages[best], float(1 / np.exp((mean[best] - mean) * math.log(10)).sum())


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, lang_pred, score of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("key"), is_held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    key_type = rows.schema["key"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, np.ndarray | None] = {}
        for batch in batches:
            found = []
            for value in batch.column(2):
                found.append(classify(shared.value, value.as_py(), memory))
                if len(memory) > REMEMBERED:
                    memory.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()),
                 pa.array([x for _, x in found], pa.float64())], names=[key, "held_out", "lang_pred", "score"])

    return rows.mapInArrow(predict, f"`{key}` {key_type}, held_out boolean, lang_pred string, score double")
