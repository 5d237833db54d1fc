"""Phrase collocation mining with an FM-index per shard of texts.

Every task cuts its texts into shards of one group each and numbers their
words. A shard's index holds the Burrows-Wheeler transform of its word numbers
and that of their reversal, both ordered by as many words as the phrases are
long, which is all that phrases of that length can tell apart. A phrase is a
pair of intervals, one in each transform; all phrases of a length are extended
by a word at once, to the right through the reversal and to the left through
the text, with their counts. Counts are summed across shards.

A phrase can't occur more often than its parts, so lengths are taken one by
one: words too rare to matter break the text, and a shard extends a phrase
only where a Bloom filter holds it as frequent in the whole corpus. The filter
has a bounded size, and what passes it by mistake is dropped once its counts
are summed: it saves work and decides nothing.

Defined results
    * a null text is empty; a null group counts as ``und``.
    * equal scores are ranked by count, then by the phrase's UTF-8 bytes; of
      cuts that score alike the first counts.
    * repeated rows count as often as they stand; an empty table, or one
      without a frequent phrase, gives no rows.
    * long texts are cut into shards between pieces. A single piece stays in
      one shard however long it is, as phrases may lie anywhere in it.
    * columns that are not asked for do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, gapless_rank, staged

LEAST = 10
LONGEST = 3
TOP = 2000
#: A longer phrase that has this share of a phrase's occurrences, in percent, covers it.
COVER = 50
#: Bytes of text in a shard, but for a longer piece; how many of them a task holds at once over all groups.
SHARD_BYTES = 1 << 23
HELD_SHARDS = 3
#: Rows of an Arrow batch that leaves a task.
ROWS = 1 << 18
#: Bloom filter of frequent words or phrases: bits a key, bits at most (16 MB), probes.
BITS_A_KEY = 16
MOST_BITS = 1 << 27
PROBES = 3
#: Groups are ranked in so many parts first.
RANK_PARTS = 256

#: The characters that end a piece (and the two that end a word).
BREAKS = ".,;:!?\n\v\f\r"
_PLAIN = bytes.maketrans((UPPER + BREAKS + "\t").encode(), (UPPER.lower() + "\n" * len(BREAKS) + " ").encode())


# --- shards -----------------------------------------------------------------

def number_words(blob: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of lower-cased text with its pieces on lines: the word numbers from 1,
    with 0 between pieces; the words; their counts."""
    raw = np.frombuffer(blob, dtype=np.uint8)
    inside = (raw != 10) & (raw != 32)
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    flat = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    coded = flat.dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    piece = np.searchsorted(np.flatnonzero(raw == 10), starts)
    new = np.diff(piece, prepend=piece[:1]) > 0
    tokens = np.zeros(len(numbers) + int(new.sum()), dtype=np.int32)
    tokens[np.arange(len(numbers)) + np.cumsum(new)] = numbers
    words = coded.dictionary
    return tokens, words, np.bincount(numbers, minlength=len(words) + 1)[1:]


def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(group, text of one shard) of (group, text) rows, pieces on lines."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def flush(group: str) -> Iterator[tuple[str, bytes]]:
        blob = b"\n".join(held.pop(group))
        del size[group]
        at = 0
        while len(blob) - at > SHARD_BYTES:
            cut = blob.rfind(b"\n", at, at + SHARD_BYTES)
            cut = cut if cut > at else blob.find(b"\n", at + SHARD_BYTES)
            if cut < 0:
                break
            yield group, blob[at:cut]
            at = cut + 1
        yield group, blob[at:]

    for batch in batches:
        for group, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
            group, body = group.as_py(), text.as_py().translate(_PLAIN)
            held.setdefault(group, []).append(body)
            size[group] = size.get(group, 0) + len(body) + 1
            if size[group] >= SHARD_BYTES:
                yield from flush(group)
            elif sum(size.values()) >= HELD_SHARDS * SHARD_BYTES:
                yield from flush(max(size, key=size.get))
    for group in list(held):
        yield from flush(group)


def _texts(docs: DataFrame, text: str, group: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, f) over all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, blob in blobs(batches):
            _, words, n = number_words(blob)
            for at in range(0, len(n), ROWS):
                part = words[at:at + ROWS].cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(part)), part, pa.array(n[at:at + ROWS])],
                                                 names=["lang", "word", "n"])

    return (texts.mapInArrow(count, "lang string, word string, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("f")))


# --- Bloom filters ----------------------------------------------------------

def key_filter(keys: DataFrame, count: int) -> np.ndarray:
    """Bits of the column ``key``; at most MOST_BITS / 64 numbers leave Spark."""
    size = min(MOST_BITS, 1 << max(6, (BITS_A_KEY * count - 1).bit_length()))
    probes = F.array(*[F.shiftrightunsigned("key", 18 * i).bitwiseAND(F.lit(size - 1)) for i in range(PROBES)])
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))
    rows = (keys.select(F.explode(probes).alias("bit")).select(F.shiftright("bit", 6).alias("place"), one.alias("mask"))
            .groupBy("place").agg(F.bit_or("mask").alias("mask")).toPandas())
    bits = np.zeros(size // 64, dtype=np.int64)
    bits[rows["place"].to_numpy(dtype=np.int64)] = rows["mask"].to_numpy(dtype=np.int64)
    return bits.view(np.uint64)


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), dtype=bool)
    for i in range(PROBES):
        bit = (keys >> np.uint64(18 * i)) & np.uint64(64 * len(bits) - 1)
        found &= (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return found


# The odd constants of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                                 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def hash_longs(columns: list[np.ndarray]) -> np.ndarray:
    """What ``F.xxhash64`` gives for rows of longs: each value hashed with the
    hash so far as its seed."""
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = np.full(len(columns[0]), 42, dtype=np.uint64)
    for c in columns:
        h = h + _P5 + np.uint64(8)
        h ^= turn(c.astype(np.uint64) * _P2, 31) * _P1
        h = turn(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        h ^= h >> np.uint64(32)
    return h


# --- the index --------------------------------------------------------------

class Transform:
    """Burrows-Wheeler transform of a circular text whose suffixes are ordered
    by their first ``depth`` symbols. ``step[i]`` is C[c] + Occ(c, i) for the
    symbol c at i; it holds for intervals of phrases shorter than ``depth``,
    as the order inside an interval doesn't enter."""

    def __init__(self, text: np.ndarray, depth: int):
        rank = text.astype(np.int64)
        for d in range(1, depth):
            key = text * (rank.max(initial=0) + 1) + np.roll(rank, -1)
            rank = key if d + 1 == depth else np.unique(key, return_inverse=True)[1]
        self.symbols = text[np.argsort(rank) - 1]
        self.step = np.empty(len(text), dtype=np.int64)
        self.step[np.argsort(self.symbols, kind="stable")] = np.arange(len(text))


class Phrases:
    """Phrases of one length: words (a row each), the starts of their
    intervals in the text's and the reversal's transform, and their counts."""

    def __init__(self, words: np.ndarray, text: np.ndarray, reversal: np.ndarray, count: np.ndarray):
        self.words, self.text, self.reversal, self.count = words, text, reversal, count

    def where(self, keep: np.ndarray) -> Phrases:
        return Phrases(self.words[keep], self.text[keep], self.reversal[keep], self.count[keep])


class ShardIndex:
    """Bidirectional index of word numbers from 1, with 0 between pieces."""

    def __init__(self, tokens: np.ndarray, depth: int):
        text = np.concatenate([[0], tokens]).astype(np.int64)  # circular: a break joins end and start
        self.sigma = int(text.max()) + 1
        self.counts = np.bincount(text, minlength=self.sigma)
        self.text, self.reversal = Transform(text, depth), Transform(text[::-1], depth)

    def words(self) -> Phrases:
        first = np.cumsum(self.counts) - self.counts
        own = np.arange(1, self.sigma)
        return Phrases(own[:, None], first[1:], first[1:], self.counts[1:])

    def _extend(self, transform: Transform, near: np.ndarray, far: np.ndarray, count: np.ndarray):
        """Every phrase by every word before it in ``transform``: (phrase, word,
        near start, far start, count). ``far`` moves by the smaller words."""
        total = int(count.sum())
        base = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(count)), count)
        at = np.arange(total) + np.repeat(near - base, count)
        key = owner * self.sigma + transform.symbols[at]
        del owner
        order = np.argsort(key)
        key = key[order]
        runs = np.flatnonzero(np.diff(key, prepend=-1))
        if not len(runs):
            return (np.zeros(0, dtype=np.int64),) * 5
        phrase, word = np.divmod(key[runs], self.sigma)
        size = np.diff(runs, append=total)
        first = at[np.minimum.reduceat(order, runs)]  # positions ascend within a phrase
        whole = word > 0  # no phrase goes over a break
        found = (phrase, word, transform.step[first], far[phrase] + runs - base[phrase], size)
        return tuple(x[whole] for x in found)

    def right(self, p: Phrases) -> Phrases:
        phrase, word, reversal, text, count = self._extend(self.reversal, p.reversal, p.text, p.count)
        return Phrases(np.column_stack([p.words[phrase], word]), text, reversal, count)

    def left(self, p: Phrases) -> Phrases:
        phrase, word, text, reversal, count = self._extend(self.text, p.text, p.reversal, p.count)
        return Phrases(np.column_stack([word, p.words[phrase]]), text, reversal, count)


def phrases_of(tokens: np.ndarray, ids: np.ndarray, length: int, filters: list[np.ndarray]) -> Phrases:
    """The shard's phrases of ``length`` words; ``filters`` hold the frequent
    phrases of 2, 3, ... words: none is extended that they rule out, and none
    returned whose last or first words they rule out."""
    def known(words: np.ndarray) -> np.ndarray:
        return may_hold(filters[words.shape[1] - 2], hash_longs(list(ids[words - 1].T)))

    index = ShardIndex(tokens, length)
    found = index.right(index.words())
    for _ in range(length - 2):
        found = index.left(found.where(known(found.words)))
        found = found.where(known(found.words[:, :-1]))
    return found


# --- counts across shards ---------------------------------------------------

def shards(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """(shard, lang, n, tokens, words): word numbers as compressed 32-bit
    integers, and the words that may be frequent; others are breaks."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for ordinal, (lang, blob) in enumerate(blobs(batches)):
            tokens, words, counts = number_words(blob)
            seed = xxhash.xxh64_intdigest(lang.encode(), 42)
            keys = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()), dtype=np.uint64, count=len(words))
            kept = may_hold(shared.value, keys)
            number = np.concatenate([[0], np.where(kept, np.cumsum(kept), 0)])
            body = joined_breaks(number[tokens].astype("<i4"))
            words = words.filter(pa.array(kept)).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | ordinal], pa.int64()), pa.array([lang], pa.string()),
                 pa.array([int(counts.sum())], pa.int64()), pa.array([packed(body)], pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)],
                names=["shard", "lang", "n", "tokens", "words"])

    return texts.mapInArrow(build, "shard long, lang string, n long, tokens binary, words array<string>")


def joined_breaks(tokens: np.ndarray) -> np.ndarray:
    """Without words that stand alone between breaks, and with one break between pieces."""
    word = tokens != 0
    before, after = np.roll(word, 1), np.roll(word, -1)
    before[:1], after[-1:] = False, False
    tokens = np.where(word & (before | after), tokens, 0)
    word = tokens != 0
    return tokens[word | np.roll(word, 1)]


def packed(tokens: np.ndarray) -> bytes:
    return zstandard.compress(tokens.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(body), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(-1)


def numbered(built: DataFrame, frequent: DataFrame) -> DataFrame:
    """(shard, tokens, ids): the shards with the corpus's ids of their frequent
    words; words that only passed the filter break the text."""
    words = built.select("shard", "lang", F.posexplode("words").alias("pos", "word"))
    ids = (words.join(frequent.select("lang", "word", "id"), ["lang", "word"])
           .groupBy("shard").agg(F.collect_list(F.struct("pos", "id")).alias("ids")))  # no more than a shard's words

    def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, body, pairs in zip(*batch.columns, strict=True):
                pos, own = (pairs.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                tokens = unpacked(body.as_py())
                number = np.zeros(max(int(tokens.max(initial=0)), int(pos.max(initial=0)) + 1) + 1, dtype=np.int64)
                number[pos + 1] = np.arange(1, len(pos) + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.as_py()], pa.int64()), pa.array([packed(joined_breaks(number[tokens]))], pa.binary()),
                     pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own))],
                    names=["shard", "tokens", "ids"])

    return (built.select("shard", "tokens").join(ids, "shard")
            .mapInArrow(renumber, "shard long, tokens binary, ids array<long>"))


def phrase_counts(prepared: DataFrame, length: int, least: int, filters: list[np.ndarray]) -> DataFrame:
    """(w0, w1, ..., a): ids and count of the phrases of ``length`` words that
    occur ``least`` times or more over all shards."""
    names = [f"w{i}" for i in range(length)]
    shared = prepared.sparkSession.sparkContext.broadcast(filters)

    def enumerate_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, own in zip(batch.column(0), batch.column(1), strict=True):
                ids = own.values.to_numpy(zero_copy_only=False)
                found = phrases_of(unpacked(body.as_py()), ids, length, shared.value)
                for at in range(0, len(found.count), ROWS):
                    words = ids[found.words[at:at + ROWS] - 1]
                    yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in words.T],
                                                      pa.array(found.count[at:at + ROWS])], names=[*names, "n"])

    schema = ", ".join([*(f"{n} long" for n in names), "n long"])
    return (prepared.select("tokens", "ids").mapInArrow(enumerate_phrases, schema)
            .groupBy(*names).agg(F.sum("n").alias("a")).where(F.col("a") >= least))


# --- scores -----------------------------------------------------------------

def score_of(a: str, l: str, r: str) -> str:  # noqa: E741
    """floor(1000000 a a / (l r)) in decimals; exact for counts under 10**15."""
    wide = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    return f"({wide(a)} * {wide(a)} * CAST(1000000 AS DECIMAL(7, 0))) div ({wide(l)} * {wide(r)})"


def lowest_cuts(phrases: DataFrame, known: DataFrame, length: int) -> DataFrame:
    """(ids, f, phrase, lang, l, r, score) of phrases (ids, a): their cut with
    the lowest score, the first of equals. ``known`` has all shorter ones."""
    cuts = (phrases.select("ids", "a", F.explode(F.sequence(F.lit(1), F.lit(length - 1))).alias("k"))
            .select("*", F.slice("ids", F.lit(1), F.col("k")).alias("head"),
                    F.slice("ids", F.col("k") + 1, F.lit(length) - F.col("k")).alias("tail")))
    head = known.select(F.col("ids").alias("head"), F.col("f").alias("l"), F.col("phrase").alias("first"), "lang")
    tail = known.select(F.col("ids").alias("tail"), F.col("f").alias("r"), F.col("phrase").alias("rest"))
    scored = (cuts.join(head, "head").join(tail, "tail").withColumn("score", F.expr(score_of("a", "l", "r")))
              .withColumn("phrase", F.concat_ws(" ", "first", "rest")))
    best = scored.groupBy("ids").agg(F.min(F.struct("score", "k", "l", "r", "a", "phrase", "lang")).alias("cut"))
    return best.select("ids", F.col("cut.a").alias("f"), *[f"cut.{c}" for c in ("phrase", "lang", "l", "r", "score")])


def uncovered(candidates: DataFrame, cover: int) -> DataFrame:
    """Candidates without a longer one around them that has ``cover`` percent
    of their occurrences."""
    spots = F.flatten(F.transform(
        F.sequence(F.lit(2), F.size("ids") - 1), lambda n: F.transform(
            F.sequence(F.lit(1), F.size("ids") - n + 1), lambda i: F.slice("ids", i, n))))
    inside = (candidates.where(F.size("ids") > 2).select(F.explode(spots).alias("ids"), F.col("f").alias("longer"))
              .groupBy("ids").agg(F.max("longer").alias("longer")))
    return (candidates.join(inside, "ids", "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("f"))).drop("longer"))


def best_of(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language with their rank. Each language is
    ranked in parts first, so that a task gets at most RANK_PARTS * top rows."""
    order = [F.desc("score"), F.desc("f"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("ids"), F.lit(RANK_PARTS))
    some = (scored.withColumn("part", part)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
            .where(F.col("rank") <= top).drop("rank", "part"))
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
            .where(F.col("rank") <= top))


def mine(docs: DataFrame, text: str = "text", group: str = "lang", least: int = LEAST, longest: int = LONGEST,
         top: int = TOP, cover: int = COVER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the collocations of each group."""
    texts = _texts(docs, text, group)
    frequent = staged(gapless_rank(word_counts(texts).where(F.col("f") >= least), [], ["lang", "word"], "id"), "words")
    bits = key_filter(frequent.select(F.xxhash64("lang", "word").alias("key")), frequent.count())
    built = staged(shards(texts, bits), "shards")
    prepared = staged(numbered(built, frequent), "numbered-shards")

    known = frequent.select(F.array("id").alias("ids"), "f", F.col("word").alias("phrase"), "lang")
    candidates, filters = None, []
    for length in range(2, longest + 1):
        names = [f"w{i}" for i in range(length)]
        counts = staged(phrase_counts(prepared, length, least, filters), "phrases")
        cut = staged(lowest_cuts(counts.select(F.array(*names).alias("ids"), "a"), known, length), "cuts")
        known = known.unionByName(cut.select(*known.columns))
        candidates = cut if candidates is None else candidates.unionByName(cut)
        if length < longest:
            filters.append(key_filter(counts.select(F.xxhash64(*names).alias("key")), counts.count()))
    totals = built.groupBy("lang").agg(F.sum("n").alias("n"))
    ranked = best_of(uncovered(candidates, cover), top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
