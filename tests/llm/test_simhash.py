import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from krunch.llm import simhash
from krunch.llm.graph import components


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, near):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[:i]:
            if near(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {v: root(v) for v in values}


def brute(rows):
    fps = {i: fingerprint(t) for i, t in rows}
    by = classes(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for i in sorted(fps, reverse=True):
        first[by[fps[i]]] = i
    return sorted((i, f"{fps[i]:016x}", first[by[fps[i]]]) for i in fps)


def rows_of(frame):
    return sorted((r.doc_id, r.fingerprint, r.component_id) for r in frame.collect())


WORDS = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were".split()


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(7)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "Two words"), (6, "two WORDS"), (7, "É é É"), (8, "x" * 5000)]
    for k in range(60):
        rows.append((100 + k, " ".join(r.choice(WORDS) for _ in range(r.choice((3, 20, 120))))))
    base = [r.choice(WORDS) for _ in range(400)]
    for k in range(60):  # near copies
        copy = list(base)
        for _ in range(r.randrange(4)):
            copy[r.randrange(len(copy))] = r.choice(WORDS)
        rows.append((300 + k, " ".join(copy)))
    rows += [(500 + k, "exact copy of a text that is repeated") for k in range(30)]
    return rows


def test_against_brute_force(make, corpus):
    assert rows_of(simhash.near_duplicates(make(corpus))) == brute(corpus)


def test_long_texts_in_parts(corpus, monkeypatch):
    for part in (1, 7, 50):
        monkeypatch.setattr(simhash, "_PART", part)
        assert all(simhash.fingerprint(None if t is None else t.encode()) == fingerprint(t) for _, t in corpus[:40])


def test_crowded_segments(make, corpus, monkeypatch):
    """With every segment value crowded, all links come from common centres."""
    fps = make(corpus).sparkSession.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in {fingerprint(t) for _, t in corpus}], "fp long")
    plain = {r.node: r.root for r in components(simhash.links(fps)).collect()}
    crowd = {r.node: r.root for r in components(simhash.links(fps, crowd=0)).collect()}
    assert plain == crowd and plain


def test_links_at_each_distance(spark):
    r = random.Random(3)
    values = set()
    for _ in range(12):
        a = r.getrandbits(64)
        for distance in range(6):
            b = a
            for bit in r.sample(range(64), distance):
                b ^= 1 << bit
            values |= {a, b}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    want = classes({signed(v) for v in values}, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    for crowd in (64, 0):
        got = {x.node: x.root for x in components(simhash.links(fps, crowd)).collect()}
        assert {v: got.get(v, v) for v in want} == want


def test_edges(make, spark):
    assert simhash.near_duplicates(make([(1, "a")]).limit(0)).count() == 0
    twice = make([(1, "same text here"), (1, "same text here"), (None, "other words are here"), (2, "same text here")])
    assert [(r.doc_id, r.component_id) for r in simhash.near_duplicates(twice).orderBy(F.col("doc_id").asc_nulls_first()).collect()] == [(None, None), (1, 1), (1, 1), (2, 1)]
    clash = make([(1, "a b c"), (2, "a b c")]).withColumns({"fp": F.lit(1), "component_id": F.lit("x"), "first": F.lit(2), "root": F.lit(3)})
    assert [r.doc_id for r in simhash.keep_one(clash).collect()] == [1] and simhash.keep_one(clash).columns == clash.columns


def test_long_chain_of_links(spark):
    edges = spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in components(edges).collect()} == {0} and components(edges).count() == 501
    assert components(edges.limit(0)).count() == 0
