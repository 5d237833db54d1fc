import random

from logtide.llm import decontamination as D

from .test_decontamination import bench_of, words_of


def edited(rng, text, rate):
    """Random replaced, dropped and added characters, blanks among them."""
    out = list(text)
    for _ in range(round(rate * len(text))):
        i, kind = rng.randrange(len(out)), rng.randrange(3)
        new = rng.choice("abcdefghijklmnopqrstuvwxyz ")
        out[i:i + 1] = [[new], [], [out[i], new]][kind]
    return "".join(out)


def test_short_and_long_items_reach_the_recall(spark, docs_of):
    """Short items with 5%, longer ones with 10% of the characters edited."""
    rng = random.Random(2)
    items = [(r.item_id, " ".join(words_of(r.text)))
             for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    short = [(i, t) for i, t in items if D.WINDOW <= len(t.split()) < 32]
    long = [(i, t) for i, t in items if 32 <= len(t.split())]
    rows, planted = [], [set(), set()]
    for k, (group, rate) in enumerate(((short, 0.05), (long, 0.1))):
        for i, text in group * 3:
            planted[k].add((len(rows), i))
            rows.append((len(rows), edited(rng, text, rate)))
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(docs_of(rows), bench_of(spark, items)).collect()}
    for some in planted:
        assert len(got & some) >= 0.93 * len(some), len(got & some) / len(some)  # 95%, less the draw's error
