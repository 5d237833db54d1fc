"""SimHash near-duplicates found by covering locality-sensitive hashing.

A 64-bit fingerprint holds the majority bit of its text's shingle hashes.
For a radius r, Pagh's covering construction gives bit i a vector m(i) of
r + 1 bits and makes one mask for each non-zero vector v: the bits i with odd
parity of m(i) & v. Any r differing bits leave r equations in r + 1 unknowns,
so some non-zero v has them all outside its mask: every pair within the
radius is equal under at least one of the 2^(r+1) - 1 masks.

Distinct fingerprints are bucketed by (mask, masked bits). Inside a bucket a
breadth-first search emits one edge per newly reached fingerprint, never all
pairs. A bucket above BUCKET_ROWS is first dealt out anew by the same
construction over the bits its mask leaves free; what remains equal then has
at most 16 free bits, so no group exceeds 2^16 fingerprints whatever the data. Edges become components by alternating large-star and small-star
rounds, each checkpointed.

Defined results
    * null text: as an empty one; no words: fingerprint zero, linked like any other.
    * component id: smallest non-null key reachable (null if there is none).
    * repeated rows and equal keys are separate rows of one component if their
      fingerprints link; a key does not link two texts.
    * empty tables give no rows; columns not asked for do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import checkpointed, fresh_name, staged

BITS = 64
SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
BUCKET_ROWS = 1024
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Fingerprint as a signed 64-bit number. ``bytes.split`` cuts at exactly
    space and U+0009 to U+000D."""
    from xxhash import xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends.tolist()]
    size = min(shingle_words, len(words))
    stops = starts[size:]
    votes = np.zeros(BITS, dtype=np.int64)
    for low in range(0, len(stops), 1 << 15):  # bounds the memory of a very long text
        part = np.fromiter((xxh64_intdigest(whole[a:b - 1], SEED) for a, b in
                            zip(starts[low:low + (1 << 15)], stops[low:low + (1 << 15)], strict=False)),
                           dtype="<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(stops), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    @pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(x, shingle_words) for x in texts], dtype="int64")
    return of(text)


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """One mask over the given bit positions per non-zero vector."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << b for i, b in enumerate(bits) if ((1 + i % vectors) & v).bit_count() % 2)
            for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def spanning_edges(fingerprints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(found from, found) for a spanning forest of the links in one bucket."""
    if len(fingerprints) == 2:
        a, b = (int(x) for x in fingerprints)
        return [(a, b)] if ((a ^ b) & ((1 << BITS) - 1)).bit_count() <= radius else []
    rest = np.unique(fingerprints.astype(np.int64))
    edges: list[tuple[int, int]] = []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            near = np.bitwise_count((rest ^ here).view(np.uint64)) <= radius
            if near.any():
                found = rest[near]
                edges += [(int(here), int(x)) for x in found]
                queue.extend(found)
                rest = rest[~near]
    return edges


def links(nodes: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): a spanning set of the links among the distinct values of ``fp``."""
    masks = covering_masks(list(range(BITS)), radius)
    finer = []  # per mask, the same construction over the bits it leaves free
    for mask in masks:
        free = [i for i in range(BITS) if not mask >> i & 1]
        finer.append([mask | m for m in covering_masks(free, radius)])
    table = F.array(*[F.lit(_signed(m)) for m in masks])
    second = F.array(*[F.array(*[F.lit(_signed(m)) for m in row]) for row in finer])

    keyed = nodes.select("fp", F.posexplode(table).alias("v", "mask"))
    keyed = keyed.select("fp", "v", F.col("mask").bitwiseAND(F.col("fp")).alias("bits"))
    sizes = keyed.groupBy("v", "bits").agg(F.count("*").alias("n")).where("n > 1")
    sizes = checkpointed(sizes)
    members = keyed.join(sizes, ["v", "bits"])
    fine = members.where(F.col("n") <= bucket_rows).groupBy("v", "bits").agg(F.collect_list("fp").alias("fps"))
    large = (members.where(F.col("n") > bucket_rows)
             .select("fp", "v", F.posexplode(F.get(second, F.col("v"))).alias("w", "mask"))
             .select("fp", "v", "w", F.col("mask").bitwiseAND(F.col("fp")).alias("bits"))
             .groupBy("v", "w", "bits").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            edges = [e for fps in batch["fps"] for e in spanning_edges(fps, radius)]
            yield pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return fine.select("fps").unionAll(large.select("fps")).mapInPandas(search, "a long, b long").distinct()


def component_roots(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component, for every node with
    an edge; alternating large-star and small-star until nothing changes."""
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                         .distinct())
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")))
    state = edges.select(mark).first()
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = checkpointed(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges = checkpointed(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        after = edges.select(mark).first()
        if after == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = after


def fingerprint_groups(rows: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(fp, root, no_key, least, n) of every distinct ``fp`` of ``rows``
    (key, fp): its component's root, its smallest key (nulls last) and how
    many rows have that key and fingerprint."""
    first = F.struct(F.col("key").isNull().alias("no_key"), F.col("key").alias("least"), "n")
    nodes = checkpointed(rows.groupBy("key", "fp").agg(F.count("*").alias("n"))
                         .groupBy("fp").agg(F.min(first).alias("first")).select("fp", "first.*"))
    roots = component_roots(links(nodes, radius, bucket_rows)).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "no_key", "least", "n")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS,
                    radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """key, fingerprint, component_id of every row.

    Texts are read once; the rest works on (key, fp). The final join is on the
    fingerprint, whose component table has each value once, so AQE may split
    a fingerprint that a third of the rows share.
    """
    rows = checkpointed(docs.select(F.col(key).alias("key"), fingerprint(F.col(text), shingle_words).alias("fp")))
    groups = checkpointed(fingerprint_groups(rows, radius, bucket_rows))
    smallest = groups.groupBy("root").agg(F.min("least").alias("component"))
    components = groups.join(smallest, "root").select("fp", "component")
    return rows.join(components, "fp").select(
        F.col("key").alias(key), fingerprint_hex(F.col("fp")).alias("fingerprint"),
        F.col("component").alias("component_id"))


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS,
                  radius: int = RADIUS) -> DataFrame:
    """One row of each component, all columns: that with the smallest key
    (nulls last), then the smallest fingerprint; of rows equal in both, any one."""
    fp = fresh_name(docs, "fp")
    rows = staged(docs.withColumn(fp, fingerprint(F.col(text), shingle_words)), "fingerprints")
    groups = fingerprint_groups(rows.select(F.col(key).alias("key"), F.col(fp).alias("fp")), radius)
    pick = F.min(F.struct("no_key", "least", F.col("fp").alias("of"), "n")).alias("pick")
    picks = checkpointed(groups.groupBy("root").agg(pick).select("pick.least", "pick.of", "pick.n"))

    def kept(chosen: DataFrame) -> DataFrame:
        return rows.join(chosen, (rows[fp] == chosen["of"]) & rows[key].eqNullSafe(chosen["least"]), "left_semi")

    repeated = kept(picks.where("n > 1")).dropDuplicates([key, fp])
    return kept(picks.where("n = 1")).unionAll(repeated).drop(fp)
