"""Packing token sequences by minimum bin slack.

Texts are tokenised, an end id is appended, and each document is cut into
full windows and one remainder. How many remainders there are of each length
is all the planner sees: at most ``window`` counts, whatever the data's size.
It takes the longest remaining length, finds by a bitset subset-sum over the
remaining lengths (with their counts) the multiset that leaves the least
slack, and uses it as often as the counts allow. Pieces are then numbered
within their length, and the numbers looked up in the plan.

Defined results
    * null text: as an empty one; its document is the end id alone.
    * repeated rows are packed separately; a null key stays null.
    * the literal of a special token of the vocabulary has that token's id
      (``<|endoftext|>``: 50256), wherever it stands in a text.
    * very long texts are encoded whole, in segments that change no id (see
      ``bpe_codec``); equal pieces are placed in any order.
    * every id lies in exactly one piece; empty tables give no rows.
    * columns that are not asked for do not matter, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import encoding, segments
from .common import checkpointed, gapless_rank

WINDOW = 2048
END_ID = 1
RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"


class Encoder:
    """Ids of whole texts, as little-endian 32-bit bytes.

    The ids are those that ``tokenizers`` gives with ``byte_bpe_50k.json`` and
    ``add_special_tokens=False``; tiktoken reads the same vocabulary as ranks
    and is several times faster. Special tokens are the JSON file's.
    """

    def __init__(self, ranks_path: str | None = None, tokenizer_path: str | None = None):
        import public_tokenizers
        self.encoding = encoding(ranks_path or public_tokenizers.path(RANKS))
        with open(tokenizer_path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.between = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")

    def ids(self, text: str) -> list[int]:
        found = []
        for part, single in segments(text):
            found += self.encoding._encode_single_piece(part) if single else self.encoding.encode_ordinary(part)
        return found

    def __call__(self, text: str) -> bytes:
        found, at = [], 0
        for m in self.between.finditer(text):
            found += self.ids(text[at:m.start()])
            found.append(self.special[m.group()])
            at = m.end()
        return np.asarray(found + self.ids(text[at:]), dtype="<u4").tobytes()


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                 end_id: int = END_ID, ranks_path: str | None = None) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens: full windows, then the rest."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key_type = rows.schema["key"].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(ranks_path)
        for batch in batches:
            at, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                for s in range(0, n, window):
                    part = ids[4 * s:4 * (s + window)]
                    at.append(i)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())),
                 *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]],
                names=["key", "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(cut, f"key {key_type}, start long, length long, ids_crc32 long, doc_tokens long")


def least_slack(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths whose sum comes closest to ``room``
    from below, as {length: how many}; longer lengths are preferred."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, unit = min(counts[length], room // length), 1
        while left:  # 1, 2, 4, ... copies and the rest: any number up to the count
            k = min(unit, left)
            steps.append((reach, length, k))
            reach |= (reach << (length * k)) & mask
            left, unit = left - k, unit * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, k in reversed(steps):
        if not before >> total & 1:
            total -= length * k
            chosen[length] = chosen.get(length, 0) + k
    return chosen


def plan_windows(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, per window, first window, offset).

    Piece number r of a length, ``first <= r < first + ranks``, goes to window
    ``first_window + (r - first) // per``, at
    ``offset + (r - first) % per * length``. Each round exhausts a length or
    takes it below a pattern's need, so the plan stays small.
    """
    left = {length: n for length, n in counts.items() if n}
    used, rows, windows = dict.fromkeys(left, 0), [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = least_slack(left, window - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        copies = min(left[length] // k for length, k in pattern.items())
        offset = 0
        for length in sorted(pattern, reverse=True):
            k = pattern[length]
            rows.append((length, used[length], copies * k, k, windows, offset))
            used[length] += copies * k
            left[length] -= copies * k
            offset += k * length
            if not left[length]:
                del left[length]
        windows += copies
    return rows


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID,
         ranks_path: str | None = None) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    pieces = checkpointed(token_pieces(docs, key, text, window, end_id, ranks_path))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = np.array(sorted(plan_windows(counts, window)), dtype=np.int64).reshape(-1, 6)
    ranked = gapless_rank(pieces, ["length"], ["key", "start", "ids_crc32", "doc_tokens"], "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.int64(1) << 48  # more than the pieces of any one length
        firsts = plan[:, 0] * wide + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            row = plan[np.searchsorted(firsts, length * wide + rank, side="right") - 1]
            within = rank - row[:, 1]
            columns = [batch.column(x) for x in ("key", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(row[:, 4] + within // row[:, 3]),
                 pa.array(row[:, 5] + within % row[:, 3] * length)],
                names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    key_type = pieces.schema["key"].dataType.simpleString()
    return ranked.mapInArrow(place, f"`{key}` {key_type}, start long, length long, ids_crc32 long, "
                                    "doc_tokens long, sequence_id long, offset long")
