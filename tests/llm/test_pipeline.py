import re

import corpus_pipeline as pipeline
from logtide.llm import decontamination as D
from logtide.llm import packing, quality_rules, secret_scans

from .conftest import SMALL
from .test_decontamination import brute as brute_leaks
from .test_packing import check
from .test_simhash import brute_components, brute_fingerprint


def good(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    repeated = {j for k, g in enumerate(grams) if seen[g] > 1 for j in range(k, k + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return not (len(w) < 20 or 100 * len(repeated) > 30 * len(w) or 10 * sum(map(text.count, "#*$%&|<>")) > len(w)
                or 2 * sum(c.isupper() for c in text) > sum(c.isalpha() for c in text)
                or 2 * (len(lines) - len(set(lines))) > len(lines)
                or 5 * sum(a == b for a, b in zip(w, w[1:], strict=False)) > len(w)
                or 10 * sum(any(c.isalpha() for c in x) for x in w) < 6 * len(w))


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}

    first = pipeline.STAGES[0][1](spark, docs, SMALL)
    want = {i: t for i, t in rows.items() if good(t)}
    assert first.columns == columns and {r.doc_id for r in first.collect()} == set(want)

    second = pipeline.STAGES[1][1](spark, first, SMALL)
    ids = sorted(want)
    groups = brute_components(ids, [brute_fingerprint(want[i]) for i in ids])
    want = {i: want[i] for i in set(groups)}
    assert second.columns == columns and sorted(r.doc_id for r in second.collect()) == sorted(want)

    third = pipeline.STAGES[2][1](spark, second, SMALL)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = {r.doc_id: r.text for r in third.collect()}
    gone = [(i, want[i]) for i in want if i not in kept]
    assert {d for d, _ in brute_leaks(gone, items)} == {i for i, _ in gone}
    whole = [" ".join(w for w in map(D.normal, t.split()) if w) for _, t in items]
    assert not any(x in " ".join(w for w in map(D.normal, t.split()) if w) for t in kept.values() for x in whole)

    fourth = pipeline.STAGES[3][1](spark, third, SMALL)
    masked = {r.doc_id: r.text for r in fourth.collect()}
    assert fourth.columns == columns and set(masked) == set(kept)
    for i, t in masked.items():
        assert not secret_scans.base_spans(t)
        assert (t == kept[i]) == (not secret_scans.base_spans(kept[i]))

    check(list(masked.items()), pipeline.STAGES[4][1](spark, fourth, SMALL).collect(), packing.WINDOW)


def test_run_equals_the_stages_and_names(spark):
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "decontamination", "secret_scans",
                                               "packing"]
    out = pipeline.run(spark, SMALL).toPandas()
    assert len(out) and out.doc_tokens.min() > 1 and pipeline.ORACLE_SQL is None
    assert len(quality_rules.RULES) == 7


def test_stages_on_nulls_repeats_and_no_rows(spark, docs_of):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, None), (3, ""), (None, text + " tail of its own here " * 9)]
    docs = docs_of(rows)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == docs_of([]).columns
    assert sorted((r.doc_id is None, r.text[:5]) for r in docs.collect())[0] == (False, "word0")
    none = docs_of([])
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, SMALL).count() == 0
