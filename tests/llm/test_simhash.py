import random

import numpy as np
import pytest
import xxhash

from logtide.llm import simhash
from logtide.llm.common import checkpointed


def brute_fingerprint(text):
    data = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", data) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def brute_components(ids, prints):
    left, out = set(range(len(ids))), [None] * len(ids)
    while left:
        queue, group = [left.pop()], []
        while queue:
            i = queue.pop()
            group.append(i)
            near = {j for j in left if (prints[i] ^ prints[j]).bit_count() <= 3}
            left -= near
            queue += near
        least = min((ids[i] for i in group if ids[i] is not None), default=None)
        for i in group:
            out[i] = least
    return out


def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = [(1, None), (0, ""), (2, " \t\n"), (3, "One"), (4, "one two"), (5, "ONE TWO"), (6, "é É x y"),
            (None, "null key text here"), (None, "null key text here"), (9, "null key text here")]
    for g in range(12):
        base = rng.choices(words, k=rng.choice([5, 60, 400]))
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((rng.randint(10, 10_000), " ".join(copy)))
        rows.append(rows[-1])  # repeated row
    rows.append((77, " ".join(rng.choices(words, k=60_000))))  # more than one block of shingles
    return rows


def test_whole_operator_against_brute_force(spark, docs_of):
    rows = corpus()
    got = simhash.near_duplicates(docs_of(rows)).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    want = zip((i for i, _ in rows), prints, brute_components([i for i, _ in rows], prints), strict=True)
    order = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(((i, f"{p:016x}", c) for i, p, c in want), key=order)


@pytest.mark.parametrize("bucket_rows", [2, 1024])
def test_links_on_clouds_of_near_fingerprints(spark, bucket_rows):
    """Large buckets are dealt out anew; both ways give the brute-force components."""
    rng = random.Random(3)
    prints = set()
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(60):
            p = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = checkpointed(spark.createDataFrame([(s,) for s in signed], "fp long"))
    roots = {r.node: r.root for r in simhash.component_roots(simhash.links(nodes, 3, bucket_rows)).collect()}
    want = brute_components(list(range(len(prints))), prints)
    got = [roots.get(s, s) for s in signed]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_masks_cover_every_small_difference():
    masks = simhash.covering_masks(list(range(64)), 3)
    assert len(masks) == 15 and all(30 <= m.bit_count() <= 36 for m in masks)
    rng = random.Random(1)
    for _ in range(5000):
        diff = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(diff & m == 0 for m in masks)
    for m in masks:  # the second dealing leaves at most 16 bits free
        free = [b for b in range(64) if not m >> b & 1]
        assert all(64 - (m | x).bit_count() <= 16 for x in simhash.covering_masks(free, 3))


def test_spanning_edges_span():
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 62), 1 << 62)
    points = np.unique(np.array([base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 40, (80, 2))]))
    edges = simhash.spanning_edges(points, 3)
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3 for a, b in edges)
    want = brute_components(list(range(len(points))), [int(p) & ((1 << 64) - 1) for p in points])
    assert len(edges) == len(points) - len(set(want))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    roots = {r.node: r.root for r in simhash.component_roots(edges).collect()}
    assert roots == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_one_per_group_keeps_the_smallest_key(spark, docs_of):
    rows = corpus()
    df = docs_of(rows)
    kept = simhash.one_per_group(df)
    assert kept.columns == df.columns
    prints = [brute_fingerprint(t) for _, t in rows]
    groups = brute_components(list(range(len(rows))), prints)  # ids repeat across groups, so rows name them
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    least = {}
    for (i, _), g in zip(rows, groups, strict=True):
        least[g] = min(least.get(g, (True, 0)), (i is None, i or 0))
    assert got == sorted(least.values())


def test_empty(spark, docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    assert simhash.one_per_group(docs_of([])).count() == 0
