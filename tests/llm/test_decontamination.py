import pickle
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from logtide.llm import decontamination as D

SMALL = "/root/testdata/sf0.001"


def naive(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=20), st.integers(0, 12))
def test_least_edits_is_exact(pattern, text, most):
    assert D.least_edits(pattern, text, most) == min(naive(pattern, text), most + 1)


def bench_of(spark, items):
    return spark.createDataFrame([(i, t, "k", "x") for i, t in items], "item_id long, text string, key string, passage string")


def words_of(text):
    return [w for w in map(D.normal, (text or "").split()) if w]


def brute(docs, items):
    found = set()
    for d, text in docs:
        whole = " ".join(words_of(text))
        for i, item in items:
            w = words_of(item)
            if len(w) < D.WINDOW:
                continue
            for part in D.passages(w):
                body = " ".join(part)
                allowed = int(D.MOST_EDITS * len(body))
                if D.least_edits(body, whole, allowed) <= allowed:
                    found.add((d, i))
    return found


def test_given_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 6000")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, bench).collect()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    leaked = {d for d, _ in got}
    checked = [r for k, r in enumerate(rows) if r[0] in leaked or k % 12 == 0]
    assert got == brute(checked, items) and got


def test_edited_passages_reach_the_recall(spark, docs_of):
    """One word in twenty replaced, dropped, doubled or misspelt; markers between words."""
    rng = random.Random(11)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    noise = [f"noise{k}" for k in range(500)]
    rows, planted = [], set()
    for i, text in items * 3:
        out = []
        for w in text.split():
            x = rng.random()
            out += [w.upper() + "%%%"] if x > 0.05 else rng.choice([[], [w, w], [rng.choice(noise)], [w[1:] + "q"]])
        rows.append((len(rows), " ".join(rng.choices(noise, k=50)) + " " + " | ".join(out) + " " + " ".join(noise[:30])))
        planted.add((len(rows) - 1, i))
    clean = [(10_000 + k, " ".join(rng.choices(noise, k=200))) for k in range(20)]
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(docs_of(rows + clean), bench_of(spark, items)).collect()}
    assert len(got & planted) >= 0.95 * len(planted)
    assert got <= brute(rows + clean, items)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


def test_defined_results(spark, docs_of):
    long_item = " ".join(f"long{k}" for k in range(300))
    items = [(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "too short an item"), (5, long_item), (None, "n" + ITEM * 2)]
    some = " ".join(f"long{k}" for k in range(120, 200))  # holds one whole passage
    rows = [(1, f"x {ITEM} y"), (1, f"x {ITEM} y"), (2, None), (3, ""), (None, ITEM), (4, "too short an item"), (5, some),
            (6, "word " * 100_000 + ITEM), (7, "alpha beta gamma")]
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.item_id) for r in
                 D.find_leaks(docs_of(rows), bench_of(spark, items)).collect() if r.item_id is not None)
    assert got == [((False, 1), 1), ((False, 4), 4), ((False, 5), 5), ((False, 6), 1), ((True, 0), 1)]
    kept = D.drop_leaks(docs_of(rows), bench_of(spark, items))
    assert kept.columns == docs_of(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 7]


def test_short_items_match_verbatim_and_word_for_word(spark, docs_of):
    """Every length below a window, inside long texts and at both ends, also without blanks."""
    items = [(n, " ".join(f"s{n}w{k}" for k in range(n))) for n in range(1, D.WINDOW)]
    items += [(50, "床前明月光,疑是地霜"), (51, "短句"), (52, "ひらがな")]
    noise = " ".join(f"noise{k}" for k in range(300))
    rows, want = [], set()
    for i, text in items:
        for doc in (text, f"{noise} {text.upper()}", f"{text}! {noise}", f"{noise}, «{text}» {noise}"):
            want.add((len(rows), i))
            rows.append((len(rows), doc))
        changed = text[:-1] + ("x" if i < 50 else "你")
        rows.append((len(rows), f"{noise} {changed} {noise}"))
        rows.append((len(rows), f"{noise} {text}x {noise}" if i < 50 else noise))
    rows.append((len(rows), "床前明月光疑是地"))
    got = {(r.doc_id, r.item_id): (r.edits, r.similarity) for r in D.find_leaks(docs_of(rows), bench_of(spark, items)).collect()}
    assert set(got) == want and set(got.values()) == {(0, 1.0)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abc é", max_size=14), st.text("abc é", max_size=24), st.integers(0, 14)), max_size=5))
def test_many_pairs_at_once_have_the_edits_of_each(pairs):
    got = D.edits_within(*[[p[k] for p in pairs] for k in range(3)])
    assert got.tolist() == [D.least_edits(*p) for p in pairs]


def test_long_patterns_in_pieces_have_the_edits_of_the_whole():
    rng = random.Random(8)
    pairs = []
    for _ in range(150):
        p = "".join(rng.choices("abcde ", k=rng.randrange(60, 300)))
        t = list(p)
        for _ in range(rng.randrange(0, 70)):
            at = rng.randrange(len(t))
            t[at:at + 1] = rng.choice([[], ["x"], [t[at], "b"]])
        pairs.append((p, "abc" * 9 + "".join(t) + "ed a" * rng.randrange(30), len(p) // 5))
    bound = D.fewest_edits([p for p, _, _ in pairs], [t for _, t, _ in pairs])
    want = [D.least_edits(p, t, len(p)) for p, t, _ in pairs]
    assert all(b <= w for b, w in zip(bound.tolist(), want, strict=True))
    got = D.edits_within(*[[p[k] for p in pairs] for k in range(3)]).tolist()
    assert got == [min(w, k + 1) for w, (_, _, k) in zip(want, pairs, strict=True)] and min(want) < 5 < max(want)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aB. _\t\n\u0130\u03a3\u3042-")), max_size=60), st.integers(1, 40))
def test_words_by_arrays_are_the_words_one_by_one(text, size):
    want = [w for w in map(D.normal, D.split_words(text)) if w]
    whole, held = D.normal_words(text), D.CHARS_AT_ONCE
    D.CHARS_AT_ONCE = size
    try:
        parts = D.normal_words(text)
    finally:
        D.CHARS_AT_ONCE = held
    for got in (whole, parts):
        assert got.between(0, len(text) + 1) == want and len(got.hashes) == len(want)
        assert got.between(1, 3) == want[1:3]
        assert got.hashes.tolist() == [D.normal_words(w).hashes[0] for w in want]


def test_windows_that_do_not_walk_have_no_key_of_five_distinct_words():
    """The filter of triples loses no key whose sampled steps read different words."""
    rng = random.Random(4)
    h = D.WordHashes()
    for _ in range(60):
        window = h([f"w{k}" for k in range(D.WINDOW)])
        other = h([f"x{k}" for k in range(D.WINDOW)])
        same = sorted(rng.sample(range(D.WINDOW), 5))
        for at in same:
            other[at] = window[at]
        triples = {k for _, keys in D.triple_keys(window) for k in keys.tolist()}
        assert triples & {k for _, keys in D.triple_keys(other) for k in keys.tolist()}, same


def test_chosen_windows_have_the_keys_of_all_windows():
    words = D.WordHashes()([f"w{k % 37}" for k in range(400)])
    chosen = np.array([0, 3, 4, 77, 390, 399])
    for every, some in zip(D.window_keys(words, 400), D.window_keys(words, 400, chosen), strict=True):
        inside = chosen <= 400 - D.WINDOW
        assert (every[chosen][inside] == some[inside]).all()


def test_empty(spark, docs_of):
    none, one = bench_of(spark, []), bench_of(spark, [(1, ITEM)])
    assert D.find_leaks(docs_of([(1, ITEM)]), none).count() == 0
    assert D.find_leaks(docs_of([]), one).count() == 0
    assert D.drop_leaks(docs_of([(1, ITEM)]), none).count() == 1


def test_keys_depend_on_their_window_alone():
    h = D.WordHashes()
    words = ITEM.split()
    a = list(D.window_keys(h(words), len(words)))
    b = list(D.window_keys(h(["x", *words[2:2 + D.WINDOW], "y", "z"]), D.WINDOW))
    assert len(a) == D.TABLES and all(x[2] == y[1] for x, y in zip(a, b, strict=True))


def test_filter_goes_through_the_driver_packed(spark):
    keys = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 3000)
    for some in (keys[:0], keys[:1], keys):
        got = D.key_filter(spark.createDataFrame([(int(k),) for k in some], "key long").repartition(3))
        size = 1 << max(6, (D.BITS_A_KEY * len(some) - 1).bit_length())
        want = np.zeros(size, dtype=np.uint8)
        for i in range(D.PROBES):
            want[(some.view(np.uint64) >> np.uint64(12 * i)) & np.uint64(size - 1)] = 1
        assert len(pickle.dumps(got)) < 500 + size / 8 / 4
        assert (np.unpackbits(got.bits, bitorder="little") == want).all()
