import hashlib
import random
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logtide.llm import merkle_manifest, oracle
from logtide.llm.common import ascii_lower
from logtide.llm.merkle_manifest import leaf_digest, prove

from .conftest import rows_of

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
CLASH = ("tree", "IDX", "digest", "before", "after", "path", "claimed", "at", "run", "root")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def build(digests, fanout):
    """Root of a list of digests and each one's steps (before, after) up to it."""
    at, steps, nodes = list(range(len(digests))), [[] for _ in digests], list(digests)
    while len(nodes) > 1:
        runs = [nodes[i:i + fanout] for i in range(0, len(nodes), fanout)]
        for k, i in enumerate(at):
            run = runs[i // fanout]
            steps[k].append(("".join(run[:i % fanout]), "".join(run[i % fanout + 1:])))
            at[k] = i // fanout
        nodes = [h(*run) for run in runs]
    return nodes[0], steps


def brute(rows, fanout=8):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, h(*map(field, r)), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: build([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in order}
    root, tops = build([trees[g][0] for g in order], fanout)
    out = []
    for g, top in zip(order, tops, strict=True):
        for (_, _, leaf, r), own in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            start = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                start = h(*map(field, (*r[:4], text)))
            for before, after in own + top:
                start = h(before, start, after)
            out.append((r[0], leaf, trees[g][0], root, h(*[b + a for b, a in own + top]), start, start == root))
    return sorted(out, key=str)


def rows_for(sizes, seed=1):
    rng = random.Random(seed)
    rows = []
    for lang, n in sizes.items():
        rows += [(rng.randint(-10**12, 10**12), rng.choice(["s", None, "é"]), lang, rng.choice([None, 5]),
                  rng.choice([None, "", "Text É", "lower", "A" * 3000])) for _ in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def proven(spark):
    def run(rows, fanout=8, partitions=3):
        extra = ", ".join(f"`{c}` string" for c in CLASH)
        df = spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], f"{SCHEMA}, {extra}").repartition(partitions)
        changed = [ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS]
        claimed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf_digest(changed))
        return prove(df, COLUMNS, "lang", "doc_id", claimed, fanout)
    return run


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_against_brute_force_and_sql(proven, duck):
    rows = rows_for({None: 1, "": 2, "en": 150, "fr": 64, "de": 65, "a": 8, "b": 9, "ü": 1, "z": 1, "zz": 7, "zzz": 1})
    got = proven(rows)
    assert plain(got) == brute(rows)
    verified = {r.verified for r in got.collect()}
    assert verified == {True, False}
    frame = pd.DataFrame(rows, columns=COLUMNS).astype({"doc_id": "Int64", "n_chars": "Int64"})
    assert rows_of(got.toPandas()) == duck(oracle.OP12, documents=frame)


@pytest.mark.parametrize("fanout", [2, 3])
def test_other_fanouts(proven, fanout):
    rows = rows_for({"en": 21, None: 16, "x": 1}, seed=fanout)
    assert plain(proven(rows, fanout)) == brute(rows, fanout)


def test_ties_null_keys_and_partitioning(proven):
    rows = [(7, "a", "en", 1, "same")] * 20 + [(7, "b", "en", 1, "other")] * 3 + [(None, None, "en", None, None)] * 2
    rows += [(None, None, None, None, None)]
    assert plain(proven(rows)) == plain(proven(rows, partitions=7)) == brute(rows)


def test_lone_leaf_lone_group_and_empty(proven):
    assert plain(proven([(3, "s", "en", 1, "T")])) == brute([(3, "s", "en", 1, "T")])
    assert plain(proven([(3, None, None, 1, "T"), (4, "s", None, 1, "")])) == brute([(3, None, None, 1, "T"), (4, "s", None, 1, "")])
    assert proven([]).count() == 0


def test_any_changed_column_is_noticed(spark):
    rows = rows_for({"en": 30, "fr": 9})
    df = spark.createDataFrame(rows, SCHEMA)
    new = {"source": F.lit("new"), "n_chars": F.lit(77), "text": F.concat(F.coalesce("text", F.lit("")), F.lit(" ")),
           "lang": F.lit("xx"), "doc_id": F.col("doc_id") + 1}
    claimed = F.lit(None)
    for i, c in enumerate(COLUMNS):  # each row is changed in one column
        changed = leaf_digest([new[x] if x == c else F.col(x) for x in COLUMNS])
        claimed = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == i, changed).otherwise(claimed)
    assert prove(df, COLUMNS, "lang", "doc_id", claimed).where("verified").count() == 0
    assert prove(df, COLUMNS, "lang", "doc_id").where("NOT verified").count() == 0


def test_long_values(proven):
    rows = [(1, "s", "en", 1, "Wörd " * 400_000), (2, "s", "en", 1, "x")]
    assert plain(proven(rows)) == brute(rows)


def test_levels_shrink_by_the_fanout(spark):
    leaves = spark.range(1000).selectExpr("'t' AS tree", "id AS idx", "unhex(sha2(cast(id AS string), 256)) AS digest")
    assert [x.count() for x in merkle_manifest.grow(leaves)] == [1000, 125, 16, 2, 1]
