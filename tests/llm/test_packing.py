import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logtide.llm import packing

from .conftest import SMALL


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODER = packing.Encoder()


def reference_ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab Z9.,'\n\té日%<|>s😀\x0b\x85  "), max_size=30) | st.text(max_size=40))
def test_ids_are_those_of_the_json_tokenizer(text):
    assert ENCODER(text) == np.asarray(reference_ids(text)[:-1], dtype="<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", " ", "  ", "\n", "a", "é", "<|", "endoftext|>", "'s", "1"]), max_size=12))
def test_special_tokens_are_those_of_the_json_tokenizer(parts):
    text = "".join(parts)
    assert ENCODER(text) == np.asarray(reference_ids(text)[:-1], dtype="<u4").tobytes()


def test_very_long_white_space():
    for text in (" " * 1_000_000 + "x", "a" + "\n " * 400_000 + "<|endoftext|>" + " " * 20_000 + "<|endoftext|>b"):
        ids = np.frombuffer(ENCODER(text), dtype="<u4").tolist()
        pieces = [ENCODER.encoding.decode_bytes([i]) if i != 50256 else b"<|endoftext|>" for i in ids]
        assert b"".join(pieces) == text.encode()
    run = " " * 20_000
    assert ENCODER(f"{run}<|endoftext|>{run}b") == np.asarray(reference_ids(f"{run}<|endoftext|>{run}b")[:-1], dtype="<u4").tobytes()


def check(rows, got, window):
    """Every id in one piece, pieces as cut, sequences gapless and not over-full."""
    ids = [(i, reference_ids(t)) for i, t in rows]
    want = sorted((i is None, i or 0, s, len(x[s:s + window]),
                   zlib.crc32(np.asarray(x[s:s + window], dtype="<u4").tobytes()), len(x))
                  for i, x in ids for s in range(0, len(x), window))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return by


def test_pieces_and_sequences(spark, docs_of):
    rng = random.Random(6)
    words = ["alpha", "Beta", "gamma,", "x", "42", "é", "<|endoftext|>", " ", "\n"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 300])))) for i in range(80)]
    rows += [(None, None), (None, ""), (5, "same"), (5, "same"), (200, "long " * 9000)]
    by = check(rows, packing.pack(docs_of(rows), window=64).collect(), 64)
    assert sorted(by) == list(range(len(by)))


def test_production_window_leaves_little_padding(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    by = check(rows, packing.pack(docs).collect(), 2048)
    total = sum(length for parts in by.values() for _, length in parts)
    assert len(by) <= total / 2048 * 1.02 + 2


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), max_size=5), st.integers(0, 25))
def test_least_slack_is_the_best_subset(counts, room):
    got = packing.least_slack(counts, room)
    assert all(0 < n <= counts[x] for x, n in got.items())
    items = [x for x, n in counts.items() for _ in range(n)]
    best = max((sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room))
    assert sum(x * n for x, n in got.items()) == best


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 5000), max_size=12))
def test_plan_places_every_piece_once(counts):
    plan = packing.plan_windows(counts, 32)
    for length, n in counts.items():
        spans = sorted((first, k) for x, first, k, *_ in plan if x == length)
        at = 0
        for first, k in spans:
            assert first == at
            at += k
        assert at == n
    fill = {}
    for length, _, k, per, window, offset in plan:
        assert k % per == 0
        fill.setdefault((window, k // per), []).append((offset, per * length))
    for parts in fill.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 32


def test_empty(spark, docs_of):
    assert packing.pack(docs_of([])).count() == 0
