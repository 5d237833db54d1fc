"""Language-model scores by stupid backoff over the corpus's own counts.

The score of a word given the words before it is the relative frequency of the
longest n-gram seen elsewhere, times BACKOFF per order given up; a document's
score is the sum of the logarithms. "Elsewhere" leaves the document itself
out: its own n-grams are subtracted from the corpus counts, or every n-gram
would be known.

Relations, all keyed by 64-bit n-gram hashes:
    blocks   documents, about BLOCK_WORDS words together, as word numbers (the
             frequent ones small); a table bucketed by block, so that totals
             come to the blocks and no block is shuffled
    grams    (order, hash range, block): a block's distinct n-grams and their
             counts, as sorted arrays; the shuffle on (order, hash range)
             makes the count tables, which no single task holds whole
    totals   the corpus counts joined back to each block's n-grams
Each n-gram enters the shuffle once a block, so a frequent one is no hot key.
Words and sums are combined in numpy inside the tasks; Spark partitions,
shuffles and joins the arrays. Hashes aren't confirmed by the n-grams' text: of
N distinct n-grams about N * N / 2^65 pairs share one (none expected up to 10^9,
some 30,000 among 10^12), and each such pair adds up its two counts.

Defined results
    * words: runs of characters other than space and U+0009 to U+000D, A-Z
      lower-cased. Null text, or one without words: no words, score 0, mean null.
    * a word unseen elsewhere counts as 1 in (words elsewhere + 1).
    * repeated rows are documents of their own (each is elsewhere to the
      other); empty tables give no rows; columns not asked for do not matter.
    * each word's logarithm is rounded to millionths before the sum, so sums
      don't depend on their order.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

ORDER = 3
BACKOFF = 0.4
BLOCK_WORDS = 3_000_000
#: N-grams of one order that a task counts together, on average.
BUCKET_GRAMS = 2_000_000
CACHE_WORDS = 400_000
SCORED_AT_ONCE = 1 << 18
#: A block's n-grams are held against their totals in 2^PART_BITS parts, by hash.
PART_BITS = 3
SEED = 7
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes: the high bytes of small numbers
    are zeros, and each plane has few values, which entropy coding uses."""
    from zstandard import ZstdCompressor
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).ravel().data)


def _numbers(planes: bytes, dtype: str = "<u8") -> np.ndarray:
    from zstandard import ZstdDecompressor
    raw = np.frombuffer(ZstdDecompressor().decompress(planes), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _sorted_planes(values: np.ndarray) -> bytes:
    return _planes(np.diff(values.astype("<u8"), prepend=np.uint64(0)))


def _sorted_numbers(planes: bytes) -> np.ndarray:
    return np.cumsum(_numbers(planes), dtype=np.uint64)


def _runs(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values and where each begins."""
    first = np.ones(len(ascending), dtype=bool)
    np.not_equal(ascending[1:], ascending[:-1], out=first[1:])
    begins = np.flatnonzero(first)
    return ascending[begins], begins


class WordHashes:
    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        from xxhash import xxh64_intdigest
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxh64_intdigest(w, SEED)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _mix(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> None:
    np.multiply(a, np.uint64(0x9E3779B97F4A7C15), out=out)
    out ^= b
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)


def ngram_hashes(words: np.ndarray, lengths: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, inside, hashes) of the n-grams, n = 1 .. order, by the place of their last
    word; ``inside`` is false, till the next n, where none of one document ends."""
    size, begins = len(words), np.cumsum(lengths) - lengths
    inside = np.ones(size, dtype=bool)  # places at which n words of the document have been read
    grams = words
    for n in range(1, order + 1):
        if n > 1:
            longer = np.empty_like(words)
            longer[:1] = words[:1]
            _mix(grams[:-1], words[1:], longer[1:])
            grams = longer
            inside[begins[lengths >= n - 1] + n - 2] = False
        yield n, inside, grams


def _vocabulary(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vocabulary, number of each word): frequent words get small numbers, and words
    whose counts have the same number of bits ascend, so both compress."""
    by_hash = np.argsort(words)
    vocabulary, begins = _runs(words[by_hash])
    counts = np.diff(begins, append=len(words))
    order = np.lexsort((vocabulary, -np.frexp(counts)[1]))
    place = np.empty(len(order), dtype="<u4")
    place[order] = np.arange(len(order), dtype="<u4")
    numbers = np.empty(len(words), dtype="<u4")
    numbers[by_hash] = np.repeat(place, counts)
    return vocabulary[order], numbers


def word_blocks(docs: DataFrame, key: str, text: str, block_words: int) -> DataFrame:
    """(block, keys, lengths, words, numbers, vocabulary), written and reread: a
    block's name then stands for the same documents in every later job. The table
    is bucketed by block, so joining to it needs no second copy of the blocks."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key_type = rows.schema["key"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        keys: list[pa.Scalar] = []
        parts: list[np.ndarray] = []
        kind = None

        def out() -> pa.RecordBatch:
            lengths = [len(p) for p in parts]
            words = np.concatenate(parts)
            parts.clear()
            vocabulary, numbers = _vocabulary(words)
            columns = [pa.array([uuid.uuid4().hex]), pa.array([[k.as_py() for k in keys]], pa.list_(kind)),
                       pa.array([lengths], pa.list_(pa.int64())), pa.array([len(words)], pa.int64()),
                       pa.array([_planes(numbers)], pa.binary()),
                       pa.array([_sorted_planes(vocabulary)], pa.binary())]
            keys.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        names = ["block", "keys", "lengths", "words", "numbers", "vocabulary"]
        held = 0
        for batch in batches:
            kind = batch.column(0).type
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(name)
                parts.append(hashes(value.as_py()))
                held += len(parts[-1])
                if held >= block_words:
                    held = 0
                    yield out()
        if keys:
            yield out()

    blocks = rows.mapInArrow(pack, f"block string, keys array<{key_type}>, lengths array<long>, words long, "
                                   "numbers binary, vocabulary binary")
    return staged(blocks, "word-blocks", bucket="block")


def _unpacked(row) -> tuple[np.ndarray, np.ndarray]:
    words = _sorted_numbers(row.vocabulary)[_numbers(row.numbers, "<u4")]
    return words, np.asarray(row.lengths, dtype=np.int64)


def corpus_totals(blocks: DataFrame, buckets: int, order: int) -> DataFrame:
    """(block, n, bucket, totals): for each block's distinct n-grams of a hash
    range, in order of their hashes, how often the whole corpus has them."""
    inner = np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=np.uint64)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                words, lengths = _unpacked(row)
                for n, inside, hashes in ngram_hashes(words, lengths, order):
                    hashes = hashes[inside]
                    hashes.sort()
                    edges = [0, *np.searchsorted(hashes, inner).tolist(), len(hashes)]
                    out = []
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        if a < b:
                            grams, begins = _runs(hashes[a:b])
                            counts = np.diff(begins, append=b - a).astype("<u8")
                            out.append((n, k, row.block, _sorted_planes(grams), _planes(counts)))
                    del hashes
                    yield pd.DataFrame(out, columns=["n", "bucket", "block", "grams", "counts"])

    def count(group: pd.DataFrame) -> pd.DataFrame:
        parts = [_sorted_numbers(g) for g in group["grams"]]
        _, place = np.unique(np.concatenate(parts), return_inverse=True)
        sums = np.bincount(place, weights=np.concatenate([_numbers(c) for c in group["counts"]]).astype(float))
        totals, at = [], 0
        for p in parts:
            totals.append(_planes(sums[place[at:at + len(p)]].astype("<u8")))
            at += len(p)
        return group[["block", "n", "bucket"]].assign(totals=totals)

    grams = blocks.select("block", "lengths", "numbers", "vocabulary").mapInPandas(
        cut, "n int, bucket long, block string, grams binary, counts binary")
    return grams.groupBy("n", "bucket").applyInPandas(count, "block string, n int, bucket long, totals binary")


def _elsewhere(inside: np.ndarray, hashes: np.ndarray, totals: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Per place, how often the n-gram that ends there occurs in other documents; 0
    where none ends. ``totals`` are in order of the hashes, and so are the parts."""
    out = np.zeros(len(doc), dtype=np.uint32 if totals.max(initial=0) < 1 << 32 else np.int64)
    part_of = (hashes >> np.uint64(64 - PART_BITS)).astype(np.uint8)
    done = 0
    for part in range(1 << PART_BITS):
        at = np.flatnonzero(inside & (part_of == part))
        some = hashes[at]
        order = np.argsort(some, kind="stable")  # an n-gram's places ascend, and so do its documents
        begins = _runs(some[order])[1]
        at = at[order]
        found = np.repeat(totals[done:done + len(begins)].view(np.int64), np.diff(begins, append=len(at)))
        done += len(begins)
        first = np.zeros(len(at), dtype=bool)  # of an n-gram's places in a document
        first[begins] = True
        mine = doc[at]
        first[1:] |= mine[1:] != mine[:-1]
        own = np.diff(np.flatnonzero(first), append=len(at))
        found -= np.repeat(own, own)
        out[at] = found
    return out


def block_scores(words: np.ndarray, lengths: np.ndarray, totals: dict[int, list[bytes]], corpus_words: int,
                 order: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: sum of the words' logarithms in millionths; words scored
    by each order 0 (unseen) .. order."""
    docs, size = len(lengths), len(words)
    doc = np.repeat(np.arange(docs, dtype=np.int32), lengths)
    counts = [_elsewhere(inside, h, np.concatenate([_numbers(t) for t in totals[n]]), doc) if n in totals
              else np.zeros(size, dtype=np.uint32) for n, inside, h in ngram_hashes(words, lengths, order)]
    begins = np.cumsum(lengths) - lengths
    sums = np.zeros(docs, dtype=np.int64)
    by_order = np.zeros(docs * (order + 1), dtype=np.int64)
    for a in range(0, size, SCORED_AT_ONCE):
        part = slice(a, min(a + SCORED_AT_ONCE, size))
        of = doc[part].astype(np.int64)
        place = np.arange(part.start, part.stop) - begins[of]
        rest = corpus_words - lengths[of]
        used = np.zeros(len(of), dtype=np.int64)
        share = 1.0 / (rest + 1)
        for n in range(1, order + 1):
            here = counts[n - 1][part]
            seen = here > 0
            # the word before a part's first is the last of the part before
            before = rest if n == 1 else counts[n - 2][np.maximum(np.arange(part.start, part.stop) - 1, 0)]
            share = np.where(seen, here / np.maximum(before, 1), share)
            used[seen] = n
        given_up = np.minimum(place + 1, order) - np.maximum(used, 1)
        np.add.at(sums, of, np.rint(1e6 * np.log(share * BACKOFF ** given_up)).astype(np.int64))
        np.add.at(by_order, of * (order + 1) + used, 1)
    return sums, by_order.reshape(docs, order + 1)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER,
          block_words: int = BLOCK_WORDS, bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """key, n_words, log_micro, mean_log, n_unseen, n_order1 .. of every row."""
    blocks = word_blocks(docs, key, text, block_words)
    corpus_words = blocks.agg(F.sum("words")).first()[0] or 0
    totals = corpus_totals(blocks, max(1, math.ceil(corpus_words / bucket_grams)), order)
    names = ["n_unseen", *(f"n_order{n}" for n in range(1, order + 1))]

    def merge(block: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        row = next(block.itertuples(index=False))
        words, lengths = _unpacked(row)
        counted = counted.sort_values(["n", "bucket"])
        found = {n: list(g["totals"]) for n, g in counted.groupby("n")}
        sums, by_order = block_scores(words, lengths, found, corpus_words, order)
        out = pd.DataFrame({"key": list(row.keys), "n_words": lengths, "log_micro": sums})
        return out.assign(**dict(zip(names, by_order.T, strict=True)))

    key_type = docs.schema[key].dataType.simpleString()
    shape = f"key {key_type}, n_words long, log_micro long, " + ", ".join(f"{n} long" for n in names)
    scored = blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInPandas(merge, shape)
    mean = F.when(F.col("n_words") > 0, F.col("log_micro") / F.lit(1e6) / F.col("n_words"))
    return scored.select(F.col("key").alias(key), "n_words", "log_micro", mean.alias("mean_log"), *names)
