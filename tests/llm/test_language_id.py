import math
import zlib
from collections import Counter, defaultdict

from logtide.llm import language_id

SF = "/root/testdata/sf0.01"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def toy(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", "k", 0.5) for i, t, x in rows],
                                 "doc_id long, text string, lang string, source string, key string, score double")


def brute(rows, text):
    """Costs by the published rule, from scratch."""
    words, grams = defaultdict(Counter), {s: defaultdict(Counter) for s in language_id.SIZES}
    for i, t, lang in rows:
        if t is not None and lang is not None and i is not None and not held(i):
            words[lang].update(language_id.words_of(t))
    for lang, c in words.items():
        for w, n in c.items():
            for s in language_id.SIZES:
                for k in range(len(w) + 3 - s):
                    grams[s][lang][f" {w} "[k:k + s]] += n
    cost = lambda table, lang, x: min(language_id.PENALTY, -math.log10(table[lang][x] / sum(table[lang].values()))
                                      ) if table[lang][x] else language_id.PENALTY
    total = Counter()
    found = language_id.words_of(text)
    for w in found:
        if any(w in words[lang] for lang in words):
            parts, table = [w], words
        else:
            for s in language_id.SIZES:
                table = grams[s]
                parts = [g for g in language_id.ngrams(w, s) if any(g in table[lang] for lang in words)]
                if parts:
                    break
        for lang in words:
            total[lang] += (sum(cost(table, lang, x) for x in parts) / len(parts)) if parts else language_id.PENALTY
    return {lang: total[lang] / len(found) for lang in words}


ROWS = [(0, "the cat sat on the mat", "en"), (1, "the dog and the cat", "en"), (7, "le chat est sur le tapis", "fr"),
        (8, "le chien et le chat", "fr"), (9, "die katze ist auf der matte", "de"), (10, None, "de"), (11, "x", None),
        (None, "le le le", "en"), (0, "the the", None), (10, "le", "fr"), (10, "le", "fr"), (2, "held out words", "en")]
ASK = ["the chat", "katzen", "chats noirs", "qqq", "le the die", "THE Cat", "zzz mat"]


def test_scores_against_brute_force(spark):
    model = language_id.learn(toy(spark, ROWS))
    asked = toy(spark, [(k, t, None) for k, t in enumerate(ASK)])
    got = {r.doc_id: r for r in language_id.identify(asked, model).collect()}
    for k, t in enumerate(ASK):
        costs = brute(ROWS, t)
        least = min(costs.values())
        assert costs[got[k].lang_pred] <= least + 1e-9
        assert abs(got[k].score - 1 / sum(10 ** (least - c) for c in costs.values())) < 1e-9
        assert got[k].held_out == held(k)


def test_defined_results(spark):
    model = language_id.learn(toy(spark, ROWS))
    asked = [(1, None, None), (2, "", None), (3, "12 ?! ²", None), (None, "the", None), (4, "é", None), (4, "é", None),
             (5, "the " * 200_000, None)]
    got = language_id.identify(toy(spark, asked), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert all(by[i].score == 0 for i in (1, 2, 3)) and by[None].held_out is False and by[5].lang_pred == "en"
    assert all(0 <= r.score <= 1 and r.lang_pred in {"und", "en", "fr", "de"} for r in got)
    nothing = language_id.learn(toy(spark, []))
    assert [r.lang_pred for r in language_id.identify(toy(spark, asked[3:4]), nothing).collect()] == ["und"]
    assert language_id.identify(toy(spark, []), model).count() == 0


def test_bounded_sample_of_labelled_rows(spark):
    """Small languages teach with all rows, large ones with about so many characters of
    whole rows; no word or n-gram of a sampled row is left out, and no language goes without."""
    rows = [(i, f"common word{i} " + "blah " * 20, "big") for i in range(3000)] + [(i, t, x) for i, t, x in ROWS]
    rows += [(k, f"vast{k} " * 5000, "vast") for k in range(2, 12)]
    model = language_id.learn(toy(spark, rows), sample_chars=30_000)
    assert {"common", "blah", "word"} <= set(model.words)
    assert {"en", "fr", "de", "big", "vast"} == set(model.languages)
    assert {"katze", "matte", "chien", "dog"} <= set(model.words)
    cost = model.costs[model.words["common"]][model.languages.index("big")]
    assert abs(cost - math.log10(22)) < 1e-9  # whole rows: one of their 22 words
    again = language_id.learn(toy(spark, rows[::-1]).repartition(7), sample_chars=30_000)
    assert again.languages == model.languages and set(again.words) == set(model.words)


def test_sample_size(spark):
    rows = [(i, " ".join([f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}"] * 20), "big") for i in range(6000)]
    model = language_id.learn(toy(spark, rows), sample_chars=40_000)
    taught = sum(not held(i) for i, _, _ in rows)
    assert abs(len(model.words) - 40_000 / 100) < 100 < taught  # a row has 99 characters and a word of its own


def test_whole_model_against_brute_force(spark):
    """Every cost of the model of all labelled rows of the given documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.learn(docs)
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for r in docs.select("doc_id", "text", "lang").collect():
        if r.text is not None and r.lang is not None and not held(r.doc_id):
            words[r.lang].update(language_id.words_of(r.text))
    for lang, c in words.items():
        for w, n in c.items():
            for size in language_id.SIZES:
                for g in language_id.ngrams(w, size):
                    grams[lang, size][g] += n
    assert set(model.words) == {w for c in words.values() for w in c}
    assert set(model.grams) == {g for c in grams.values() for g in c}

    def cost(counts, x, total):
        return min(language_id.PENALTY, -math.log10(counts[x] / total)) if x in counts else language_id.PENALTY

    for place, lang in enumerate(model.languages):
        total = sum(words[lang].values())
        assert all(abs(model.costs[row][place] - cost(words[lang], w, total)) < 1e-9 for w, row in model.words.items())
        totals = {size: sum(grams[lang, size].values()) for size in language_id.SIZES}
        assert all(abs(model.costs[row][place] - cost(grams[lang, len(g)], g, totals[len(g)])) < 1e-9
                   for g, row in model.grams.items())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.learn(docs)
    got = language_id.identify(docs, model).toPandas().merge(docs.select("doc_id", "lang").toPandas())
    out = got[got.held_out]
    assert len(out) > 200 and (out.lang == out.lang_pred).mean() >= 0.98
