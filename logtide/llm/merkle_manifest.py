"""Merkle manifest: one tree of digests per group, one tree over the groups.

A leaf is the SHA-256 of a row's columns, each as its length and value. Within
a group the leaves are numbered without gaps; each run of ``fanout``
consecutive nodes makes a parent, until one node remains. The groups' roots
are the leaves of the last tree. Nodes are rows (tree, idx, digest). On every
level a node computes the numbers of its siblings, by XOR in binary trees and
by slot offsets otherwise, and meets them in an equi-join; the rows in slot
zero then hold their whole run and emit the parents. Proofs go the other way:
every node adds its siblings to its parent's path, so only the leaf level
holds a row for each document.

Defined results
    * a null column is ``-``; an empty text is ``0:``.
    * a null group is a group of its own, before all others.
    * a null order key comes first in its group. Ties, also repeated rows, are
      ordered by leaf digest; rows equal in both are interchangeable.
    * very long texts are hashed whole where they are read; only digests move.
    * a lone leaf is its group's root, and a lone group's root is the root;
      without siblings the proof is the digest of nothing.
    * an empty table gives no rows.
    * columns that are not asked for do not matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, staged

FANOUT = 8
PATH = "array<struct<before: binary, after: binary>>"


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    value = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def linked(nodes: DataFrame, fanout: int) -> DataFrame:
    """(tree, idx, digest, before, after): each node with the digests of the
    run's others on its left and right, joined by their computed numbers."""
    if fanout == 2:
        others = F.array(F.col("idx").bitwiseXOR(F.lit(1).cast("long")))
    else:
        slot = F.col("idx") % fanout
        others = F.array(*[F.col("idx") - slot + (slot + shift) % fanout for shift in range(1, fanout)])
    # A node asks for itself as well, so that the answers hold its own digest.
    asks = nodes.select("tree", "idx", F.explode(F.concat(F.array("idx"), others)).alias("at"))
    answers = asks.join(nodes.select("tree", F.col("idx").alias("at"), "digest"), ["tree", "at"])
    runs = answers.groupBy("tree", "idx").agg(  # at most ``fanout`` answers each
        F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("run"))

    def side(keep) -> Column:
        kept = F.transform(F.filter("run", lambda x: keep(x["at"])), lambda x: x["digest"])
        return F.aggregate(kept, F.lit(b""), lambda a, x: F.concat(a, x))

    return runs.select("tree", "idx", side(lambda at: at == F.col("idx")).alias("digest"),
                       side(lambda at: at < F.col("idx")).alias("before"),
                       side(lambda at: at > F.col("idx")).alias("after"))


def _parent(fanout: int) -> Column:
    return F.expr(f"idx div {fanout}")


def alone() -> Column:
    """Whether a linked node is the only one of its tree on its level."""
    return (F.col("idx") == 0) & (F.length("before") == 0) & (F.length("after") == 0)


def parents(level: DataFrame, fanout: int) -> DataFrame:
    """What the rows in slot zero emit."""
    whole = F.unhex(F.sha2(F.concat(text_of(F.col("digest")), text_of(F.col("after"))), 256))
    return (level.where(~alone() & (F.col("idx") % fanout == 0))
            .select("tree", _parent(fanout).alias("idx"), whole.alias("digest")))


def grow(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The linked levels above and with ``leaves`` (tree, idx, digest). A tree
    ends on the level where its node is alone; on the last level all are."""
    levels, nodes = [], leaves
    size = (leaves.agg(F.max("idx")).first()[0] or 0) + 1  # of the largest tree
    while size > 1:
        levels.append(staged(linked(nodes, fanout), "merkle-level"))
        nodes = parents(levels[-1], fanout)
        size = -(-size // fanout)
    nothing = F.lit(b"")
    levels.append(nodes.select("tree", "idx", "digest", nothing.alias("before"), nothing.alias("after")))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree."""
    found = levels[-1]
    for level in levels[:-1]:
        found = found.unionByName(level.where(alone()))
    return found.select("tree", "digest")


def climb(level: DataFrame, above: DataFrame | None, top: DataFrame, fanout: int) -> DataFrame:
    """``level`` with the path of each node: its own siblings, then its parent's
    path, or ``top``'s path where the node is its tree's root. Further columns
    of ``top`` come along."""
    carried = [c for c in top.columns if c not in ("tree", "path")]
    ends = level.where(alone()).join(top, "tree")
    if above is None:
        return ends
    up = above.select("tree", F.col("idx").alias("up"), F.col("path").alias("rest"), *carried)
    own = F.array(F.struct("before", "after")).cast(PATH)
    inner = (level.where(~alone()).withColumn("up", _parent(fanout)).join(up, ["tree", "up"])
             .withColumn("path", F.concat(own, "rest")).drop("up", "rest"))
    return inner.unionByName(ends)


def paths(levels: list[DataFrame], top: DataFrame, fanout: int = FANOUT, leaves: DataFrame | None = None) -> DataFrame:
    """The leaf level's nodes with their paths; ``leaves`` (tree, idx, ...)
    adds its columns before the paths are joined, so that those never move."""
    above = None
    for level in reversed(levels[1:]):
        above = climb(level, above, top, fanout)
    first = levels[0] if leaves is None else levels[0].join(leaves, ["tree", "idx"])
    return climb(first, above, top, fanout)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf digest leads to along a path, as hex text."""
    return F.aggregate(path, text_of(start), lambda a, s: F.sha2(F.concat(text_of(s["before"]), a, text_of(s["after"])), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: text_of(F.concat(s["before"], s["after"])))), 256)


def prove(docs: DataFrame, columns: list[str], group: str, order: str, claimed: Column | None = None,
          fanout: int = FANOUT) -> DataFrame:
    """order, leaf, subroot, root, proof_sha256, folded_root, verified of every
    row. ``claimed`` is the leaf digest to check against the manifest (default:
    the row's own), such as that of a later copy."""
    rows = docs.select(F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), F.col(group).cast("string")))
                       .alias("tree"),
                       F.col(order).alias("__order"), leaf_digest([F.col(c) for c in columns]).alias("digest"),
                       (F.lit(None).cast("binary") if claimed is None else claimed).alias("claimed"))
    leaves = staged(gapless_rank(rows, ["tree"], ["__order", "digest"], "idx"), "merkle-leaves")
    levels = grow(leaves.select("tree", "idx", "digest"), fanout)
    subroots = staged(roots(levels), "merkle-subroots")

    whole = gapless_rank(subroots, [], ["tree"], "idx").withColumnRenamed("tree", "of")
    whole = staged(whole.withColumn("tree", F.lit("")), "merkle-groups")
    above = grow(whole.select("tree", "idx", "digest"), fanout)
    none = whole.sparkSession.createDataFrame([("", [])], f"tree string, path {PATH}")
    root = none.join(roots(above), "tree").select("tree", "path", text_of(F.col("digest")).alias("root"))
    top = staged(paths(above, root, fanout, whole.select("tree", "idx", "of")).select(
        F.col("of").alias("tree"), "path", text_of(F.col("digest")).alias("subroot"), "root"), "merkle-top")

    proven = paths(levels, top, fanout, leaves.select("tree", "idx", "__order", "claimed"))
    out = proven.select(F.col("__order").alias(order), text_of(F.col("digest")).alias("leaf"), "subroot", "root",
                        proof_digest(F.col("path")).alias("proof_sha256"),
                        folded(F.coalesce("claimed", "digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
