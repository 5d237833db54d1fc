import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logtide.llm import bpe_codec
from logtide.llm.bpe_codec import SPACE, decode, digests, encode, encoding, ids_of, segments

TRICKY = ["don't", "I'LL", "a  b", "\n\n x", " \t", " ", "　x", "é", "日本語", "\U0001f600", "1 2", "<|endoftext|>", "\x1c", "\x85", "'s", "#$", "\r\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(TRICKY), st.text(max_size=8), st.sampled_from([" ", "  ", "\n", "a", "1", "'"])), max_size=40),
       st.integers(1, 12), st.integers(2, 5))
def test_segments_change_nothing(parts, segment, long_run):
    text = "".join(parts)
    assert "".join(p for p, _ in segments(text, segment, long_run)) == text
    known = encoding()
    assert ids_of(text, None, segment, long_run) == known.encode_ordinary(text)
    assert known.decode_bytes(ids_of(text)) == text.encode()


def test_space_is_what_the_pattern_calls_space():
    import re

    import regex
    for c in map(chr, [*range(0x3100), 0xFEFF, 0x180E]):
        assert bool(re.match(SPACE, c)) == bool(regex.match(r"\p{White_Space}", c)), hex(ord(c))


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "\n " * 500_000, "x" + "\t" * 1_000_000, "^" * 1_000_000, "word " * 200_000,
                                  "a" * 1_000_000, " \n" * 300_000 + " end"])
def test_very_long_texts_are_encoded_whole(text):
    ids = ids_of(text)
    assert encoding().decode_bytes(ids) == text.encode()
    # Runs that the library can still take by itself agree with it.
    short = text[:50_000] + text[-5:]
    assert ids_of(short, None, 1000, 100) == encoding().encode_ordinary(short)


def test_query_columns(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "Hello world"), (3, "Hello world"), (None, "x\x00y <|endoftext|>"), (4, "é " * 300_000)]
    got = sorted(map(tuple, digests(docs_of(rows)).collect()), key=str)
    known, expected = encoding(), []
    for i, t in rows:
        ids = known.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(expected, key=str)
    assert digests(docs_of([])).count() == 0


def test_operator_gives_ids_and_bytes(spark, docs_of, monkeypatch):
    monkeypatch.setattr(bpe_codec, "BATCH_IDS", 4)
    coded = encode(docs_of([(1, "one two"), (2, None), (3, "é")]), keep=("doc_id", "n"), ids="tokens")
    assert coded.columns == ["doc_id", "n", "tokens"] and [r.n for r in coded.collect()] == ["x-n"] * 3
    back = {r.doc_id: bytes(r.raw) for r in decode(coded, "tokens", ("doc_id",), "raw").collect()}
    assert back == {1: b"one two", 2: b"", 3: "é".encode()}
    half = spark.createDataFrame([(1, [encoding().encode_ordinary("日")[0]]), (2, None)], "doc_id long, ids array<int>")
    found = {r.doc_id: r.decoded for r in decode(half, keep=("doc_id",)).collect()}
    assert "日".encode().startswith(bytes(found[1])) and found[2] is None


def test_unknown_ids_fail(spark):
    with pytest.raises(Exception, match="KeyError"):
        decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>"), keep=("doc_id",)).collect()
