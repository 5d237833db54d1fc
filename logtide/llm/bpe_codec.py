"""Byte-level BPE encoding and decoding with the tiktoken library.

A text's ids are those that tiktoken gives for the whole text: every match of
the pattern is encoded by itself, special tokens are ordinary text. tiktoken's
pattern engine backtracks over runs of white space and overflows its stack on
very long ones, so long texts reach it in segments. A segment begins only
where a match begins whatever stands before it:

* at a white-space character that follows any other character: no match goes
  on from such a character into white space, and none looks behind;
* at the last character of a white-space run that another character follows:
  the pattern leaves exactly that one to the next match. What stands before it
  in a very long run is one match, and is encoded as one piece without the
  pattern.

Decoding joins the tokens' bytes; nothing is read as text, so ids that cut a
character are no obstacle.

Defined results
    * null or empty text: no ids; they decode to no bytes.
    * null ids decode to null; an id that the rank file lacks fails the task.
    * very long texts, with or without white space, give the same ids as
      short ones would: a segment ends at the first boundary after SEGMENT
      characters, and there is no limit where none comes.
    * ties don't arise; repeated rows are encoded one by one; empty tables
      give no rows.
    * other columns, whatever their names, do not matter unless kept by name.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters from which on a text is cut, and of a white-space run that is encoded without the pattern.
SEGMENT = 1 << 16
LONG_RUN = 1 << 12
#: Ids in one Arrow batch, but for a single longer text.
BATCH_IDS = 1 << 21
#: What Unicode calls white space, as the pattern's ``\s`` does (``str.isspace`` adds U+001C to U+001F).
SPACE = "[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f") + "]"
_BOUNDARY = re.compile(f"(?<!{SPACE}){SPACE}")


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str | None = None):
    """tiktoken's encoding of a local rank file, once per Python worker."""
    import public_tokenizers
    import tiktoken
    with open(ranks_path or public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def token_bytes(ranks_path: str | None = None) -> dict[int, bytes]:
    known = encoding(ranks_path)
    return {i: known.decode_single_token_bytes(i) for i in known._mergeable_ranks.values()}


def segments(text: str, segment: int = SEGMENT, long_run: int = LONG_RUN) -> Iterator[tuple[str, bool]]:
    """(part, whether it is one match by itself) of a text, in order."""
    if len(text) <= min(segment, long_run):
        yield text, False
        return
    at = 0
    for run in re.finditer(f"{SPACE}{{{long_run},}}", text):
        yield from _cut(text, at, run.start(), segment)
        at = run.end() - (run.end() < len(text))
        if at > run.start():
            yield text[run.start():at], True
    yield from _cut(text, at, len(text), segment)


def _cut(text: str, at: int, end: int, segment: int) -> Iterator[tuple[str, bool]]:
    while at < end:
        found = _BOUNDARY.search(text, at + segment, end) if end - at > segment else None
        to = found.start() if found else end
        yield text[at:to], False
        at = to


def ids_of(text: str, ranks_path: str | None = None, segment: int = SEGMENT, long_run: int = LONG_RUN) -> list[int]:
    known, ids = encoding(ranks_path), []
    for part, single in segments(text, segment, long_run):
        ids += known._encode_single_piece(part) if single else known.encode_ordinary(part)
    return ids


def _with_column(df: DataFrame, source: str, keep: tuple[str, ...], name: str, kind: str, convert) -> DataFrame:
    """``keep`` and ``name``: what ``convert`` makes of a list of ``source``'s
    values, as Arrow arrays of consecutive values."""
    rows = df.select(*[F.col(k) for k in keep], F.col(source).alias("__source"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), f"`{name}` {kind}"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for made in convert(batch.column(len(keep))):
                kept = [batch.column(i).slice(at, len(made)) for i in range(len(keep))]
                at += len(made)
                yield pa.RecordBatch.from_arrays([*kept, made], names=[*keep, name])

    return rows.mapInArrow(work, schema)


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids",
           ranks_path: str | None = None) -> DataFrame:
    """``keep`` and the text's ids as an array of int."""
    def convert(texts: pa.Array) -> Iterator[pa.Array]:
        found, ends = [], [0]
        for value in texts:
            own = value.as_py()
            found.append(np.array(ids_of(own, ranks_path) if own else [], dtype=np.int32))
            ends.append(ends[-1] + len(found[-1]))
            if ends[-1] >= BATCH_IDS:
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))
                found, ends = [], [0]
        if found:
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))

    return _with_column(df, text, keep, ids, "array<int>", convert)


def decode(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id", "ids"), decoded: str = "decoded",
           ranks_path: str | None = None) -> DataFrame:
    """``keep`` and the bytes that the ids stand for."""
    def convert(arrays: pa.Array) -> Iterator[pa.Array]:
        known, found, size = token_bytes(ranks_path), [], 0
        for value in arrays:
            own = value.as_py()
            found.append(None if own is None else b"".join(map(known.__getitem__, own)))
            size += len(found[-1] or b"")
            if size >= 8 * BATCH_IDS:
                yield pa.array(found, pa.binary())
                found, size = [], 0
        if found:
            yield pa.array(found, pa.binary())

    return _with_column(df, ids, keep, decoded, "binary", convert)


def digests(df: DataFrame, text: str = "text", key: str = "doc_id", ranks_path: str | None = None) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every row's text: its ids
    by ``encode`` and what ``decode`` makes of them."""
    ids, decoded = "__ids", "__decoded"
    both = decode(encode(df, text, (key,), ids, ranks_path), ids, (key, ids), decoded, ranks_path)
    return both.select(key, F.size(ids).cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", F.col(ids).cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2(decoded, 256).alias("decoded_sha256"))
