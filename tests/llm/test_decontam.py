import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from krunch.llm import decontam


def folded(text):
    return "".join(chr(c) for c in decontam.fold(text)[0]) if text else ""


def edits(item, text):
    """Least edits of the whole item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.fixture(scope="module")
def items():
    r = random.Random(2)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
    return [(k, " ".join(r.choice(words) for _ in range(r.randint(5, 30)))) for k in range(12)]


def test_against_brute_force(spark, items):
    r = random.Random(4)
    texts = [None, "", "x", "a short one"]
    for _ in range(120):
        _, item = r.choice(items)
        x = list(item)
        for _ in range(r.randrange(2 + int(0.09 * len(item)))):
            at, kind = r.randrange(len(x)), r.random()
            x[at : at + (kind < 0.66)] = [r.choice("qxj")] if kind < 0.33 or kind > 0.66 else []
        texts.append("Filler words. " * r.randrange(3) + "".join(x).upper() + "!\n more filler" * r.randrange(3))
    texts.append(items[0][1] + " || " + items[1][1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontam.contaminated(docs, bench).collect()}
    want = {}
    for k, t in enumerate(texts):
        for i, item in items:
            f = folded(item)
            if len(f) >= decontam.LEAST and (e := edits(f, folded(t))) <= decontam.budget(len(f)):
                want[k, i] = e
    assert {k: v.edits for k, v in got.items()} == want and len(want) > 60
    for (k, i), x in got.items():
        span = folded(texts[k][x.start : x.end])
        assert edits(folded(dict(items)[i]), span) == x.edits


def test_blocks_of_items_and_texts(spark, items, monkeypatch):
    docs = spark.createDataFrame([(k, "before " + t + " after") for k, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(k, k) for k, t in items if len(folded(t)) >= decontam.LEAST}
    monkeypatch.setattr(decontam, "ITEM_BLOCK", 100)
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} >= want


def test_edges(spark, make):
    bench = spark.createDataFrame([(1, None), (None, "a text without a number of its own"), (2, ""), (3, "too short"), (4, "this one is long enough to be found"), (4, "this one is long enough to be found")], "item_id long, text string")
    docs = make([(1, "This ONE is, long enough -- to be found"), (2, "too short"), (None, "this one is long enough to be found"), (3, None)]).withColumn("item_id", F.lit(7))
    assert sorted((r.doc_id or 0, r.item_id) for r in decontam.contaminated(docs, bench).distinct().collect()) == [(0, 4), (1, 4), (2, 3)]
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3]
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.contaminated(docs.limit(0), bench).count() == 0


def test_fold_keeps_places():
    symbols, places = decontam.fold("  Ünï-code\n\n TEXT!! ")
    assert "".join(map(chr, symbols)) == "ünï code text" and places[0] == 2 and np.all(np.diff(places) > 0)


def test_planted_passages(tables):
    docs, bench = tables("documents"), tables("benchmark")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {(d, r.item_id) for r in bench.collect() for d, t in texts.items() if r.text in t}
    assert want <= found and all(len(folded(texts[d])) > 20 for d, _ in found)


def test_short_items_without_edits(spark):
    items = [(1, "Seven wise foxes?"), (2, "ten digits"), (3, "今天天气很好我们去公园"), (4, "who wrote of two towns?"), (5, "aaaaaaaaaaaa")]
    docs = ["He saw (seven  WISE, foxes).", "seven wise foxes", "xseven wise foxes", "seven wise foxesy", "seven wide foxes", "ten digits", "often digits ten digitss"]
    docs += ["他说今天天气很好我们去公园。", "他说今天天气很好我们去公圆。", "now: who wrote of two towns", "now: who wrote of two town", "b" + "a" * 40 + " " + "a" * 12]
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(0, 1), (1, 1), (5, 2), (7, 3), (9, 4), (11, 5)} and all(r.edits == 0 for r in got.values())
    assert all(folded(docs[d][r.start : r.end]) == folded(dict(items)[i]) for (d, i), r in got.items())


def test_items_below_a_gram(spark):
    """Found as they are between word borders, by brute force too."""
    items = [(1, "Yes"), (2, "4 of 7"), (3, "今天"), (4, "yes"), (5, "a b c d e"), (6, "!!")]
    docs = ["yes", "yesterday", "say YES!", "4 of 77", "(4, of: 7)", "说今天好", "a b c d ef a b c d e", "", None, "x"]
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(0, 1), (0, 4), (2, 1), (2, 4), (4, 2), (5, 3), (6, 5)}
    assert all(folded(docs[d][r.start : r.end]) == folded(dict(items)[i]) and r.edits == 0 for (d, i), r in got.items())


def test_item_longer_than_any_document(spark):
    """Its diagonals lie far below zero in a short text."""
    r = random.Random(1)
    long = " ".join("%06d" % r.randrange(10**6) for _ in range(6_000))
    docs = spark.createDataFrame([(1, "x " + long[:5000]), (2, "so " + long), (3, "other text")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, long)], "item_id long, text string")
    assert [(x.doc_id, x.edits) for x in decontam.contaminated(docs, bench).collect()] == [(2, 0)]
