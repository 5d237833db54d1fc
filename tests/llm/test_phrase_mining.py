import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from logtide.llm import oracle, phrase_mining
from logtide.llm.phrase_mining import ShardIndex, hash_longs, mine, number_words

from .conftest import rows_of


def brute(rows, least=10, top=2000, longest=3, cover=50):
    """The contract in plain Python, for phrases of any length."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i:i + m])] += 1
    found = []
    common = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, p), a in common.items():
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        hidden = any(o == lang and len(q) > len(p) and 100 * b >= cover * a
                     and any(q[i:i + len(p)] == p for i in range(len(q))) for (o, q), b in common.items())
        if not hidden:
            found.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out = []
    for lang in n:
        mine = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(x[0], i, *x[1:]) for i, x in enumerate(mine[:top], 1)]
    return sorted(out)


def corpus(seed=3, n=300):
    rng = random.Random(seed)
    words = ["the", "New", "york", "é", "don't", "a-b", "x", "日本", "\x00", "of", "#"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "\x0b", " ! ", " \r\n"]
    rows = []
    for _ in range(n):
        body = "".join(rng.choice(words[:rng.choice([3, 11])]) + rng.choice(ends[:rng.choice([1, 1, 9])])
                       for _ in range(rng.choice([0, 1, 5, 60])))
        rows.append((rng.choice(["en", "fr", None, "und"]), body))
    return rows + [("en", None), ("en", ""), ("xx", "only one. word"), *[("de", "new york city hall " * 40)] * 7]


@pytest.fixture(scope="module")
def table_of(spark):
    def build(rows):
        extra = ", ".join(f"`{c}` string" for c in ("ids", "word", "WORD_", "shard", "a", "n", "phrase", "f"))
        return spark.createDataFrame([(t, g, *["z"] * 8) for g, t in rows], f"text string, lang string, {extra}")
    return build


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_against_brute_force_and_sql(table_of, duck):
    rows = corpus()
    got = mine(table_of(rows))
    expected = brute(rows)
    assert len(expected) > 100 and result(got) == expected
    assert rows_of(got.toPandas()) == duck(oracle.OP11, documents=pd.DataFrame(rows, columns=["lang", "text"]))


def test_longer_phrases_and_other_limits(table_of):
    rows = corpus(seed=8, n=120)
    options = {"longest": 4, "least": 4, "top": 25, "cover": 80}
    assert result(mine(table_of(rows), **options)) == brute(rows, **options)


def test_small_shards_and_saturated_filters_change_nothing(table_of, monkeypatch):
    rows = corpus(seed=5, n=150)
    expected = result(mine(table_of(rows)))
    monkeypatch.setattr(phrase_mining, "MOST_BITS", 64)
    assert result(mine(table_of(rows).repartition(3))) == expected == brute(rows)


def test_blobs_cut_between_pieces_and_keep_every_word(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(phrase_mining, "SHARD_BYTES", 40)
    texts = ["a b. c", "x" * 200, "one two three four five six seven eight nine ten", "p, " * 60, ""] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "fr"] * 7 + ["en"]), pa.array(texts)], names=["lang", "text"])
    parts = list(phrase_mining.blobs(iter([batch, batch])))
    for lang in ("en", "fr"):
        whole = [w for g, t in zip(batch.column(0).to_pylist(), texts, strict=True) if g == lang
                 for w in re.findall(r"[^\s.,]+", t)] * 2
        assert Counter(w for g, b in parts if g == lang for w in b.decode().split()) == Counter(whole)
    assert max(len(b) for _, b in parts) < 300 and len(parts) > 10


def test_index_intervals_give_the_counts_of_every_phrase():
    rng = np.random.default_rng(1)
    for size, sigma, depth in ((0, 3, 3), (1, 2, 3), (400, 4, 4), (2000, 30, 3), (300, 2, 5)):
        tokens = rng.integers(0, sigma, size)
        index = ShardIndex(tokens, depth)
        right = left = index.words()
        for m in range(2, depth + 1):
            right, left = index.right(right), index.left(left)
            true = Counter(tuple(tokens[i:i + m]) for i in range(len(tokens) - m + 1) if (tokens[i:i + m] > 0).all())
            for found in (right, left):
                assert dict(zip(map(tuple, found.words), found.count, strict=True)) == true


def test_number_words():
    tokens, words, counts = number_words(b" ab  c\nab\n\n \nd c c")
    assert tokens.tolist() == [1, 2, 0, 1, 0, 3, 2, 2] and words.to_pylist() == [b"ab", b"c", b"d"] and counts.tolist() == [2, 3, 1]
    assert number_words(b"")[0].tolist() == number_words(b" \n\n ")[0].tolist() == []


def test_hashes_are_sparks(spark):
    rng = np.random.default_rng(2)
    rows = rng.integers(-(1 << 62), 1 << 62, (50, 3))
    frame = spark.createDataFrame(rows.tolist(), "a long, b long, c long")
    spark_side = [r[0] for r in frame.select(F.xxhash64("a", "b", "c")).collect()]
    assert hash_longs(list(rows.T)).view(np.int64).tolist() == spark_side
    words = spark.createDataFrame([("en", "é x"), ("", "y")], "lang string, word string")
    for r in words.select("*", F.xxhash64("lang", "word").alias("h")).collect():
        assert xxhash.xxh64_intdigest(r.word.encode(), xxhash.xxh64_intdigest(r.lang.encode(), 42)) == r.h % (1 << 64)


def test_score_passes_64_bits(spark):
    a, l, r = 999_999_999_999, 1_000_000_000_000, 999_999_999_998  # noqa: E741
    got = spark.sql(f"SELECT {phrase_mining.score_of(f'{a}L', f'{l}L', f'{r}L')} AS s").first().s
    assert got == 10**6 * a * a // (l * r)


def test_empty_tables_and_nothing_frequent(table_of):
    assert mine(table_of([])).count() == 0
    assert mine(table_of([("en", "a b c"), (None, None)])).count() == 0
