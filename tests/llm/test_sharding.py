import random
import zlib

from logtide.llm import sharding


def jump(key, n):
    key, b, j = key % (1 << 64), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_against_brute_force(spark, docs_of):
    rng = random.Random(9)
    ids = [0, 1, -1, (1 << 63) - 1, -(1 << 63), *(rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(200)), 7, 7, 7, None,
           None]
    rows = [(i, rng.choice([None, "", "é€", "same", "x" * 5000])) for i in ids]
    got = sharding.shard_rows(docs_of(rows), 8).collect()
    assert len(got) == len(rows)
    body = [("" if t is None else t).encode() for _, t in rows]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        (i is None, i or 0, len(b) + 1, zlib.crc32(b)) for (i, _), b in zip(rows, body, strict=True))
    for r in got:
        assert (r.shard, r.grown_shard, r.law) == (jump(r.doc_id or 0, 8), jump(r.doc_id or 0, 9), "key")
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_slots_do_not_depend_on_partitioning(spark, docs_of):
    rows = [(i % 50, "t" * (i % 7)) for i in range(400)]
    a, b = (sorted(map(tuple, sharding.shard_rows(docs_of(rows).repartition(n), 3).collect())) for n in (1, 7))
    assert a == b


def test_many_shards_and_other_keys(spark, docs_of):
    got = sharding.shard_rows(docs_of([(i, "x") for i in range(60)]), 1000).collect()
    assert all(r.shard == jump(r.doc_id, 1000) for r in got)
    named = sharding.shard_rows(docs_of([(1, "a"), (2, "a")]).withColumnRenamed("source", "s2"), 4, key="s2").collect()
    assert len({r.shard for r in named}) == 1 and sorted(r.slot for r in named) == [0, 1]


def test_empty_and_plan(spark, docs_of):
    df = docs_of([])
    assert sharding.shard_rows(df, 8).count() == 0
    plan = sharding.shard_rows(docs_of([(1, "x")]), 8)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
