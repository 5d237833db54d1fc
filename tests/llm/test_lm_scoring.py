import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from logtide.llm import lm_scoring, oracle

from .conftest import rows_of


def corpus():
    rng = random.Random(12)
    words = ["the", "of", "a", "cat", "Dog", "sat", "é", "MAT", "x"] + [f"rare{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(words, weights=[9, 8, 7, 5, 5, 4, 4, 3, 3] + [1] * 30, k=rng.choice([0, 1, 2, 3, 9, 40]))))
            for i in range(40)]
    return rows + [(3, "the cat sat"), (3, "the cat sat"), (None, "the \t\n\x0b cat"), (90, None), (91, ""), (92, " \n "),
                   (93, "once upon"), (94, "same " * 500)]


@pytest.mark.parametrize(("block_words", "bucket_grams"), [(2_000_000, 2_000_000), (25, 7)])
def test_against_sql(spark, docs_of, duck, block_words, bucket_grams):
    df = docs_of(corpus())
    got = lm_scoring.score(df, block_words=block_words, bucket_grams=bucket_grams).toPandas()
    assert rows_of(got) == duck(oracle.OP7, documents=df.select("doc_id", "text").toPandas())


@pytest.mark.parametrize("order", [1, 2, 4])
def test_other_orders_against_brute_force(spark, docs_of, order):
    rows = [(i, t) for i, t in enumerate(x for _, x in corpus())]
    docs = {i: ["".join(c.lower() if c.isascii() else c for c in w) for w in (t or "").split()] for i, t in rows}
    grams = {i: Counter(tuple(w[k:k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1))
             for i, w in docs.items()}
    total = sum(grams.values(), Counter())
    size = sum(map(len, docs.values()))
    got = {r.doc_id: r for r in lm_scoring.score(docs_of(rows), order=order, block_words=60, bucket_grams=50).collect()}
    for i, w in docs.items():
        c = lambda g: total[g] - grams[i][g]  # noqa: B023, E731
        want = 0
        for k in range(len(w)):
            most, given_up = min(k + 1, order), 0
            for n in range(most, 0, -1):
                g = tuple(w[k - n + 1:k + 1])
                if c(g) > 0:
                    p = c(g) / (c(g[:-1]) if n > 1 else size - len(w))
                    break
                given_up += n > 1
            else:
                p = 1 / (size - len(w) + 1)
            want += round(1e6 * math.log(p * 0.4 ** given_up))
        assert got[i].log_micro == want and got[i].n_words == len(w)
        assert got[i].mean_log is None if not w else abs(got[i].mean_log * len(w) * 1e6 - want) < 1e-3


def test_empty(spark, docs_of):
    assert lm_scoring.score(docs_of([])).count() == 0
    assert [r.log_micro for r in lm_scoring.score(docs_of([(1, None), (2, "")])).collect()] == [0, 0]


def test_memory_to_score_a_block():
    """Bytes a word: 52, and 93 when a block's n-grams were held against their totals all at once."""
    rng = np.random.default_rng(7)
    size, lengths = 500_000, np.full(1000, 500)
    words = rng.zipf(1.3, size).astype("<u8") * np.uint64(0x9E3779B97F4A7C15)
    totals = {n: [lm_scoring._planes(np.unique(h[inside], return_counts=True)[1].astype("<u8"))]
              for n, inside, h in lm_scoring.ngram_hashes(words, lengths, 3)}
    tracemalloc.start()
    try:
        _, by_order = lm_scoring.block_scores(words, lengths, totals, size, 3)
        assert tracemalloc.get_traced_memory()[1] < 70 * size
    finally:
        tracemalloc.stop()
    assert by_order.sum() == size
