"""Benchmark decontamination by embedded edit distance.

Texts become sequences of normalised words. The CGK embedding (Chakraborty,
Goldenberg, Koucky) walks along a window, reading the same word again or
stepping on as a random bit of the word says; windows at a small edit distance
agree in most steps of the walk. Bit sampling LSH keeps a few steps as a key;
TABLES keys, each of a walk of its own, reach the target recall for passages of
any length up to 7% edited characters (README has the figures beyond). Items are
cut into passages; those and the documents into the windows of WINDOW words at
every word. Two windows of equal keys share several words at like distances, so
only those windows of a document walk that hold three words of the benchmark at
the distances they have there, the last at most SPAN words behind the first. A
document's windows whose key occurs in the benchmark are joined to it on the key,
and the aligned stretch of text is verified exactly: the passage's least edit
distance (characters, Myers' bit-parallel search) to any part of the stretch must
be at most MOST_EDITS of its length (with one blank between words). Items of fewer than WINDOW words, which
random words come near to by chance, must occur verbatim, word for word; their
keys are hashes of all their words.

Defined results
    * null text or an item without words: matches nothing.
    * words are lower-cased and lose everything but letters and digits; markers
      and punctuation between words do not matter. In scripts that are written
      without blanks, each character is a word.
    * very long texts are read whole, many words at a time.
    * ties (passages of one item as close): the row has their common figures.
    * one row per distinct (keys, item); repeated rows and items collapse.
    * empty tables give no rows; columns that are not asked for do not matter.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh_name, staged

WINDOW = 10
STEPS = 2 * WINDOW
PASSAGE_WORDS = 64
MOST_EDITS = 0.2
SAMPLED = 5
#: Tables of one walk miss together, so each has its own. So many find TARGET_RECALL
#: of the given items of 15 to 31 words with 7% of their characters edited, and of
#: longer ones with 10% (measured; README).
TARGET_RECALL = 0.95
TABLES = WALKS = 48
#: Bits of the filter of benchmark keys that every task holds: so many a key,
#: and 2^27 (16 MB) at most, whatever the benchmark's size; fewer bits a key
#: only let more windows through to the join.
BITS_A_KEY, MOST_BITS = 1024, 1 << 27
PROBES = 3
#: 64-bit words of a filter that are packed together.
PAGE_WORDS = 1 << 13
#: A window walks if it holds three benchmark words whose last is at most so many
#: words behind the first; bits of the filter of such triples, so many a triple.
SPAN = 4
BITS_A_TRIPLE = 64
#: Pairs of texts whose pieces are compared side by side.
PAIRS_AT_ONCE = 512
SEED = 6
CHARS_AT_ONCE = 1 << 20
WORDS_AT_ONCE = 1 << 17

_NOT_WORD = re.compile(r"[\W_]+")
#: Thai to Myanmar, Khmer, kana, CJK ideographs: written without blanks.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff])")
_BLANK = re.compile(r"\s")
_END = np.uint64(0x9E3779B97F4A7C15)


def normal(word: str) -> str:
    lower = word.lower()
    return lower if lower.isalnum() else _NOT_WORD.sub("", lower)


def split_words(text: str) -> list[str]:
    """Words between blanks; characters of scripts without blanks one by one."""
    return (text if text.isascii() else _UNSPACED.sub(r" \1 ", text)).split()


@lru_cache(1)
def _parameters() -> tuple[np.ndarray, list[list[int]]]:
    """Odd multipliers, one a walk and one for keys; the steps of each table.

    Sampled steps lie at least three apart: a walk stays on a word half of the
    time, and steps that read one word twice make keys of few words."""
    rng = np.random.default_rng(SEED)
    odd = rng.integers(1 << 62, 1 << 63, WALKS + 1, dtype=np.uint64) | np.uint64(1)
    width = STEPS // SAMPLED
    tables: list[list[int]] = []
    while len(tables) < TABLES:
        shift = int(rng.integers(0, width // 2 + 1))
        steps = [width * k + shift + int(x) for k, x in enumerate(rng.integers(0, 2, SAMPLED))]
        if steps not in tables[len(tables) % WALKS::WALKS]:  # new among the tables of its walk
            tables.append([min(x, STEPS - 1) for x in steps])
    return odd, tables


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 1 for letters and digits, 2 for blanks, else 0; and a random number."""
    every = map(chr, range(sys.maxunicode + 1))
    kinds = np.fromiter((1 if c.isalnum() else 2 * c.isspace() for c in every), dtype=np.uint8, count=sys.maxunicode + 1)
    return kinds, np.random.default_rng(SEED).integers(1, 1 << 63, len(kinds), dtype=np.uint64)


class Words(NamedTuple):
    """The normalised words of a text: its letters, digits and blanks in lower
    case, where each word begins and ends there, and a 64-bit hash of each."""

    chars: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray

    def between(self, low: int, high: int) -> list[str]:
        high = min(high, len(self.begin))
        return self.chars[self.begin[low]:self.end[high - 1]].tobytes().decode("utf-32-le").split() if low < high else []


def normal_words(text: str) -> Words:
    """The words of ``split_words`` and ``normal`` that are left, by whole arrays;
    a very long text in parts that end at a blank."""
    parts, at, held = [], 0, 0
    while at < len(text):
        blank = _BLANK.search(text, at + CHARS_AT_ONCE)
        stop = blank.start() if blank else len(text)
        part = _part_words(text[at:stop])
        parts.append(part._replace(begin=part.begin + held, end=part.end + held))
        at, held = stop, held + len(part.chars)
    return parts[0] if len(parts) == 1 else Words(*map(np.concatenate, zip(*parts or [_part_words("")], strict=True)))


def _part_words(text: str) -> Words:
    lower = text.lower()
    if not lower.isascii():
        lower = _UNSPACED.sub(r" \1 ", lower)
    codes = np.frombuffer(lower.encode("utf-32-le", "replace"), dtype="<u4")
    kinds, numbers = _letters()
    kind = kinds[codes]
    chars, blank = codes[kind > 0], kind[kind > 0] == 2
    edge = np.concatenate([[True], blank, [True]])
    begin = np.flatnonzero(edge[:-2] & ~blank)
    end = np.flatnonzero(edge[2:] & ~blank) + 1
    if not len(begin):
        return Words(chars, begin, end, np.zeros(0, dtype=np.uint64))
    size = end - begin
    first = np.cumsum(size) - size  # among the letters and digits
    odd = _parameters()[0]
    powers = np.cumprod(np.full(size.max(), odd[-1], dtype=np.uint64))
    hashes = np.add.reduceat(numbers[chars[~blank]] * powers[np.arange(size.sum()) - np.repeat(first, size)], first)
    hashes ^= hashes >> np.uint64(31)
    hashes *= odd[0]
    hashes ^= hashes >> np.uint64(29)
    hashes[hashes == 0] = 1
    return Words(chars, begin, end, hashes)


class WordHashes:
    """64-bit hashes of words, as ``normal_words`` has them."""

    def __call__(self, words: list[str]) -> np.ndarray:
        return normal_words(" ".join(words)).hashes


def window_keys(words: np.ndarray, count: int, chosen: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """For each table, the keys of the windows that start at 0 .. count - 1, or
    of the ``chosen`` ones among them.

    A step at or past the window's end reads an end mark, so a key depends
    on nothing outside its window."""
    odd, tables = _parameters()
    starts = np.arange(count)
    padded = np.concatenate([words, np.zeros(STEPS + 1, dtype=np.uint64)])
    if chosen is not None:  # those windows one behind the other
        count, starts = len(chosen), np.arange(len(chosen)) * WINDOW
        padded = np.append(padded[chosen[:, None] + np.arange(WINDOW)], np.zeros(STEPS + 1, dtype=np.uint64))
    for walk in range(WALKS):
        own = range(walk, TABLES, WALKS)
        keys = {t: np.full(count, t + 1, dtype=np.uint64) for t in own}
        mixed = padded * odd[walk]
        mixed ^= mixed >> np.uint64(29)
        at = starts.copy()
        last = max(max(tables[t]) for t in own)
        for step in range(last + 1):
            read = mixed[at]
            mine = [t for t in own if step in tables[t]]
            if mine:  # before step WINDOW no walk can have left its window
                symbol = read if step < WINDOW else np.where(at - starts < WINDOW, read, _END)
                for t in mine:
                    key = keys[t]
                    key ^= symbol
                    key *= odd[-1]
                    key ^= key >> np.uint64(31)
            if step < last:
                at += ((read >> np.uint64(63 - step)) & np.uint64(1)).view(np.int64)
        yield from (keys[t] for t in own)


def run_keys(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of ``length`` words, by its first word."""
    odd, _ = _parameters()
    count = max(0, len(words) - length + 1)
    keys = np.full(count, TABLES + length, dtype=np.uint64)
    for i in range(length):
        keys ^= words[i:i + count]
        keys *= odd[-1]
        keys ^= keys >> np.uint64(31)
    return keys


def triple_keys(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(last, keys): for each pair of distances up to SPAN, a hash of every word
    with the two so far behind it, by its first word."""
    odd, _ = _parameters()
    first = words * odd[0]
    for middle in range(1, SPAN):
        pair = (first[:max(0, len(words) - middle)] ^ words[middle:]) * odd[1 + middle]
        for last in range(middle + 1, SPAN + 1):
            count = max(0, len(words) - last)
            keys = (pair[:count] ^ words[last:last + count]) * odd[1 + SPAN + last]
            keys ^= keys >> np.uint64(31)
            yield last, keys


def _passing(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the keys that may be in the filter."""
    left = None
    for i in range(PROBES):
        bit = ((keys if left is None else keys[left]) >> np.uint64(12 * i)) & np.uint64(8 * len(bits) - 1)
        there = np.flatnonzero(bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
        left = there if left is None else left[there]
    return left


def walking_windows(words: np.ndarray, count: int, triples: np.ndarray) -> np.ndarray:
    """Starts of the windows, of 0 .. count - 1, that hold a triple of the filter."""
    walks = np.zeros(len(words) + WINDOW, dtype=bool)  # by start + WINDOW
    for last, keys in triple_keys(words):
        at = _passing(keys, triples) + WINDOW
        for back in range(WINDOW - last):
            walks[at - back] = True
    return np.flatnonzero(walks[WINDOW:WINDOW + count])


def passages(words: list[str]) -> list[list[str]]:
    """Even cuts of at most PASSAGE_WORDS words."""
    n = math.ceil(len(words) / PASSAGE_WORDS)
    return [words[len(words) * i // n:len(words) * (i + 1) // n] for i in range(n)]


def benchmark_passages(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(passage, item, n, body): the passages of every item and their ids."""
    rows = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    item_type = rows.schema["item"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, value in zip(batch["item"], batch["text"], strict=True):
                words = [w for w in map(normal, split_words(value)) if w]
                out += [(name, len(part), " ".join(part)) for part in passages(words)]
            yield pd.DataFrame(out, columns=["item", "n", "body"])

    cuts = rows.mapInPandas(cut, f"item {item_type}, n int, body string").distinct()
    return cuts.select(F.xxhash64("item", "body").alias("passage"), "item", "n", "body")


def benchmark_index(parts: DataFrame) -> DataFrame:
    """(key, passage, offset, n): the keys of the windows at every word of the
    passages; passages shorter than a window have the one key of all their words."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for passage, n, body in zip(batch["passage"], batch["n"], batch["body"], strict=True):
                if n < WINDOW:
                    keys = run_keys(hashes(body.split(" ")), n).view(np.int64)
                    yield pd.DataFrame({"key": keys, "passage": passage, "offset": np.zeros(1, dtype=np.int64), "n": n})
                    continue
                count = n - WINDOW + 1
                keys = np.concatenate(list(window_keys(hashes(body.split(" ")), count))).view(np.int64)
                yield pd.DataFrame({"key": keys, "passage": passage, "offset": np.tile(np.arange(count), TABLES), "n": n})

    return parts.mapInPandas(cut, "key long, passage long, offset int, n int")


def benchmark_triples(parts: DataFrame) -> DataFrame:
    """(key): the keys of the word triples of all passages as long as a window."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for body in batch["body"]:
                keys = np.concatenate([k for _, k in triple_keys(hashes(body.split(" ")))])
                yield pd.DataFrame({"key": keys.view(np.int64)})

    return parts.where(F.col("n") >= WINDOW).select("body").mapInPandas(cut, "key long").distinct()


class KeyFilter:
    """A Bloom filter of so many bits. It goes through the driver as compressed
    pages (few bits are set), and is laid out once by each task's process."""

    def __init__(self, size: int, pages: list[tuple[int, bytes]]):
        self.size, self.pages = size, pages

    @cached_property
    def bits(self) -> np.ndarray:
        out = np.zeros(self.size // 8, dtype=np.uint8)
        for page, body in self.pages:
            raw = np.frombuffer(zlib.decompress(body), dtype=np.uint8)
            out[8 * PAGE_WORDS * page:][:len(raw)] = raw
        return out


def key_filter(index: DataFrame, bits_a_key: int = BITS_A_KEY) -> KeyFilter:
    """Filter of the index's keys, at most MOST_BITS; its pages are made by tasks."""
    size = min(MOST_BITS, 1 << max(6, (bits_a_key * index.count() - 1).bit_length()))
    words = min(PAGE_WORDS, size // 64)

    def pack(page: pd.DataFrame) -> pd.DataFrame:
        body = np.zeros(words, dtype="<i8")
        body[page["word"].to_numpy() % words] = page["mask"].to_numpy()
        return pd.DataFrame({"page": page["page"].iloc[:1], "body": [zlib.compress(body.tobytes(), 1)]})

    probes = F.array(*[F.shiftrightunsigned("key", 12 * i).bitwiseAND(F.lit(size - 1)) for i in range(PROBES)])
    bits = (index.select(F.explode(probes).alias("bit"))
            .select(F.shiftright("bit", 6).alias("word"),
                    F.call_function("shiftleft", F.lit(1).cast("long"),
                                    F.col("bit").bitwiseAND(F.lit(63)).cast("int")).alias("mask"))
            .groupBy("word").agg(F.bit_or("mask").alias("mask")))
    pages = (bits.withColumn("page", F.shiftright("word", words.bit_length() - 1))
             .groupBy("page").applyInPandas(pack, "page long, body binary").collect())
    return KeyFilter(size, [(p.page, bytes(p.body)) for p in pages])


def _hits(words: np.ndarray, count: int, bits: np.ndarray, triples: np.ndarray,
          lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(start, key) of the windows, and of the runs of the given lengths, whose
    key may be in the filter."""
    chosen = walking_windows(words, count, triples)
    starts, found = [], []
    for keys in window_keys(words, count, chosen):
        left = _passing(keys, bits)
        starts.append(chosen[left])
        found.append(keys[left])
    for length in lengths:
        keys = run_keys(words, length)
        left = _passing(keys, bits)
        starts.append(left)
        found.append(keys[left])
    return np.concatenate(starts), np.concatenate(found)


def candidate_windows(docs: DataFrame, keys: list[str], text: str, index: KeyFilter, triples: KeyFilter,
                      lengths: list[int]) -> DataFrame:
    """(key_0.., at, words, hits): stretches of documents, at most
    4 * PASSAGE_WORDS words plus a margin, and their hits (key, place); ``lengths``
    are those of the benchmark's passages shorter than a window."""
    rows = docs.select(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], F.col(text).alias("text"))
    rows = rows.where("text IS NOT NULL")
    shared = rows.sparkSession.sparkContext.broadcast((index, triples))
    types = [rows.schema[f"key_{i}"].dataType.simpleString() for i in range(len(keys))]
    margin = math.ceil(PASSAGE_WORDS * (1 + MOST_EDITS)) + WINDOW

    def stretches(words: Words, at: list[int], found: list[int]) -> Iterator[tuple[list[str], list[dict]]]:
        i = 0
        while i < len(at):
            j = i
            while j < len(at) and at[j] - at[i] <= 2 * PASSAGE_WORDS:
                j += 1
            low = max(0, at[i] - margin)
            yield (words.between(low, at[j - 1] + margin),
                   [{"key": k, "place": a - low} for a, k in sorted(set(zip(at[i:j], found[i:j], strict=True)))])
            i = j

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [f.bits for f in shared.value]
        for batch in batches:
            texts = batch.column(len(keys))
            row, out_words, out_hits = [], [], []
            i = 0
            while i < batch.num_rows:  # texts together until there are enough words
                parts, split, first, held = [], [], i, 0
                while i < batch.num_rows and held < WORDS_AT_ONCE:
                    split.append(normal_words(texts[i].as_py()))
                    parts += [split[-1].hashes, np.zeros(WINDOW, dtype=np.uint64)]
                    held += len(parts[-2]) + WINDOW
                    i += 1
                begins = np.cumsum([0, *(len(p) for p in parts)])[:-1:2]
                at, found = _hits(np.concatenate(parts), held, *filters, lengths)
                order = np.lexsort((found, at))
                at, found = at[order], found[order].view(np.int64)
                text_of = np.searchsorted(begins, at, side="right") - 1
                own = np.searchsorted(text_of, np.arange(len(split) + 1))
                for t in np.unique(text_of).tolist():
                    mine = slice(own[t], own[t + 1])
                    for words, hits in stretches(split[t], (at[mine] - begins[t]).tolist(), found[mine].tolist()):
                        row.append(first + t)
                        out_words.append(words)
                        out_hits.append(hits)
            where = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(where) for c in batch.columns[:len(keys)]), pa.array(out_words, pa.list_(pa.string())),
                 pa.array(out_hits, pa.list_(pa.struct([("key", pa.int64()), ("place", pa.int32())])))],
                names=[*(f"key_{k}" for k in range(len(keys))), "words", "hits"])

    shape = ", ".join(f"key_{i} {t}" for i, t in enumerate(types))
    return rows.mapInArrow(search, f"{shape}, words array<string>, hits array<struct<key: long, place: int>>")


def least_edits(pattern: str, text: str, most: int) -> int:
    """Least edit distance of ``pattern`` to any substring of ``text``, or
    ``most + 1`` if that is above ``most`` (Myers 1999)."""
    m = len(pattern)
    if not m:
        return 0
    equal: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        equal[ch] = equal.get(ch, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for ch in text:
        same = equal.get(ch, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        plus = down | (full & ~(horizontal | up))
        minus = up & horizontal
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
            if score < best:
                best = score
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | (full & ~(vertical | plus))
        down = plus & vertical
    return min(best, most + 1)


def fewest_edits(patterns: list[str], texts: list[str]) -> np.ndarray:
    """For each pattern, edits that no part of its text can do without: the
    pattern's pieces of at most 64 characters, a machine word each, are searched
    side by side, and the least edits of each are added up."""
    chars = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype="<u4") for x in (*patterns, *texts)]
    letters, codes = np.unique(np.concatenate(chars), return_inverse=True)
    codes = np.split(codes, np.cumsum([len(c) for c in chars])[:-1])
    columns = np.full((max(map(len, texts)), len(texts)), len(letters))
    for i, c in enumerate(codes[len(patterns):]):
        columns[:len(c), i] = c
    pieces = [(i, p) for i, c in enumerate(codes[:len(patterns)]) for p in np.array_split(c, -(-len(c) // 64) or 1) if len(p)]
    owner = np.array([i for i, _ in pieces], dtype=np.int64)
    score = np.array([len(p) for _, p in pieces], dtype=np.int64)
    row = np.arange(len(pieces)) * (len(letters) + 1)
    equal = np.zeros(len(pieces) * (len(letters) + 1), dtype=np.uint64)
    for r, (_, p) in zip(row.tolist(), pieces, strict=True):
        np.bitwise_or.at(equal, r + p, np.uint64(1) << np.arange(len(p), dtype=np.uint64))
    one = np.uint64(1)
    last = (score - 1).astype(np.uint64)
    up, down = np.full(len(pieces), ~np.uint64(0)), np.zeros(len(pieces), dtype=np.uint64)
    best = score.copy()
    for column in columns:
        same = equal[row + column[owner]]
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        plus = down | ~(horizontal | up)
        minus = up & horizontal
        score += (plus >> last & one).view(np.int64)
        score -= (minus >> last & one).view(np.int64)
        np.minimum(best, score, out=best)
        plus <<= one
        minus <<= one
        up = minus | ~(vertical | plus)
        down = plus & vertical
    return np.bincount(owner, best, len(patterns)).astype(np.int64)


def edits_within(patterns: list[str], texts: list[str], most: list[int]) -> np.ndarray:
    """``least_edits`` of each pattern and its text; Python's long integers count
    only what is neither verbatim nor too far by ``fewest_edits``."""
    edits = np.array([0 if p in t else k + 1 for p, t, k in zip(patterns, texts, most, strict=True)], dtype=np.int64)
    open_ = [i for i in np.flatnonzero(edits).tolist() if most[i] > 0]
    open_.sort(key=lambda i: len(texts[i]))
    for at in range(0, len(open_), PAIRS_AT_ONCE):
        some = open_[at:at + PAIRS_AT_ONCE]
        bound = fewest_edits([patterns[i] for i in some], [texts[i] for i in some])
        for i, least in zip(some, bound.tolist(), strict=True):
            if least <= most[i]:
                edits[i] = least_edits(patterns[i], texts[i], most[i])
    return edits


def find_leaks(docs: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text",
               item: str = "item_id", item_text: str = "text") -> DataFrame:
    """keys, item, edits, similarity: every item of which a passage occurs in
    a document within MOST_EDITS, with its closest passage."""
    parts = checkpointed(benchmark_passages(benchmark, item, item_text))
    index = checkpointed(benchmark_index(parts))
    names = [f"key_{i}" for i in range(len(keys))]
    # Written with an id, so that only ids cross the join on the many keys of a leak.
    lengths = [r.n for r in parts.where(F.col("n") < WINDOW).select("n").distinct().collect()]  # WINDOW - 1 at most
    triples = key_filter(checkpointed(benchmark_triples(parts)), BITS_A_TRIPLE)
    stretches = staged(candidate_windows(docs, list(keys), text, key_filter(index), triples, lengths)
                       .withColumn("stretch_id", F.monotonically_increasing_id()), "stretches")
    hits = stretches.select("stretch_id", F.explode("hits").alias("hit")).select("stretch_id", "hit.key", "hit.place")
    slack = F.ceil(F.col("n") * MOST_EDITS).cast("int") + 1
    begin = F.col("place") - F.col("offset") - slack
    places = hits.join(index, "key").select(
        "stretch_id", "passage", F.greatest(begin, F.lit(0)).alias("low"),
        F.greatest(begin + F.col("n") + 2 * slack, F.lit(0)).alias("high")).distinct()
    aligned = (places.join(stretches.drop("hits"), "stretch_id")
               .select(*names, "passage", F.array_join(F.slice("words", F.col("low") + 1,
                       F.greatest(F.col("high") - F.col("low"), F.lit(0))), " ").alias("stretch"))
               .distinct().join(parts, "passage"))
    shape = ", ".join(f"{n} {aligned.schema[n].dataType.simpleString()}" for n in [*names, "item"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            short = (batch["n"] < WINDOW).to_numpy()
            fence = np.where(short, " ", "")  # short items must match word for word
            body, stretch = (fence + batch[c].to_numpy() + fence for c in ("body", "stretch"))
            size = batch["body"].str.len().to_numpy()
            allowed = np.where(short, 0, (MOST_EDITS * size).astype(np.int64))
            edits = edits_within(body.tolist(), stretch.tolist(), allowed.tolist())
            out = batch[[*names, "item"]].assign(edits=edits, similarity=1 - edits / size)
            yield out[edits <= allowed]

    leaks = aligned.mapInPandas(verify, f"{shape}, edits long, similarity double")
    best = leaks.groupBy(*names, "item").agg(F.max("similarity").alias("similarity"), F.min("edits").alias("edits"))
    return best.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], F.col("item").alias(item),
                       "edits", "similarity")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
               item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item.
    Rows are told apart by two hashes of the text, 96 bits together."""
    one, two = fresh_name(docs, "text_hash_a"), fresh_name(docs, "text_hash_b")
    marked = docs.withColumns({one: F.xxhash64(text), two: F.hash(text)})
    # Written first: with a known size, a small table is broadcast and no text is shuffled.
    leaks = staged(find_leaks(marked, benchmark, (one, two), text, item, item_text).select(one, two).distinct(), "leaks")
    return marked.join(leaks, [one, two], "left_anti").drop(one, two)
