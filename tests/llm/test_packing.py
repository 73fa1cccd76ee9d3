import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from krunch.llm import packing


def check(pieces, rows, file, window=packing.WINDOW):
    """Every id of every document in exactly one piece, no gap in a sequence, none too long. Returns the sequences' lengths."""
    library = Tokenizer.from_file(file)
    left = sorted((i if i is not None else -1, tuple(library.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in rows)
    by_doc: dict = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id if p.doc_id is not None else -1, []).append(p)
    ids_of: dict = {}
    for i, ids in left:
        ids_of.setdefault(i, []).append(ids)
    assert set(by_doc) == set(ids_of)
    for i, found in by_doc.items():
        copies = ids_of[i]
        assert sum(p.length for p in found) == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for p in sorted(found, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(copies[0])
                assert p.ids_crc32 == zlib.crc32(np.array(copies[0][at : at + p.length], "<u4").tobytes())
                at += p.length
    sequences: dict = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sequences.get(p.sequence_id, 0)
        sequences[p.sequence_id] = p.offset + p.length
    assert max(sequences.values(), default=0) <= window
    return sequences


def test_round_trip(make, byte_file):
    r = random.Random(5)
    topics = [[f"{name}{k}" for k in range(40)] for name in ("apple", "stone", "river")]
    rows = [(k, " ".join(r.choice(topics[k % 3]) for _ in range(r.choice((1, 30, 300, 900))))) for k in range(90)]
    rows += [(200, None), (201, ""), (202, "twice"), (202, "twice"), (None, "no id")] + [(300 + k, "a copy of one text " * 20) for k in range(40)]
    pieces = packing.pack(make(rows), byte_file, 0).collect()
    sequences = check(pieces, rows, byte_file)
    assert sum(packing.WINDOW - n for n in sequences.values()) <= 8 * packing.WINDOW  # one open sequence a partition


def test_small_shards_and_windows(make, byte_file):
    rows = [(k, "word " * k) for k in range(25)]
    check(packing.pack(make(rows), byte_file, 0, window=16, shard=40, partition=100).collect(), rows, byte_file, 16)


def test_edges(make, byte_file):
    assert packing.pack(make([(1, "x")]).limit(0), byte_file, 0).count() == 0
    clash = make([(1, "some text")]).withColumns({"key": F.lit(1), "ids": F.lit("x"), "length": F.lit(9)})
    assert [(p.doc_id, p.start, p.offset) for p in packing.pack(clash, byte_file, 0).collect()] == [(1, 0, 0)]


def bm25(docs):
    """Of every document (columns) for every one as a query (rows), by the formula; each term of a query counts once."""
    n, mean = len(docs), np.mean([len(d) for d in docs])
    out = np.zeros((n, n))
    df = {t: sum(t in set(x.tolist()) for x in docs) for d in docs for t in d.tolist()}
    for q, a in enumerate(docs):
        for d, b in enumerate(docs):
            for term in set(a.tolist()):
                tf = (b == term).sum()
                if df[term] > 1 and tf:
                    out[q, d] += np.log1p((n - df[term] + 0.5) / (df[term] + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(b) / mean))
    return out


def test_ranking_by_formula():
    r = np.random.default_rng(4)
    docs = [r.integers(0, 30, r.integers(1, 25)) for _ in range(60)]
    want, index = bm25(docs), packing.Index(docs, 10**6)
    used = np.zeros(60, bool)
    used[::7] = True
    for q in range(60):
        for count in (1, 5, 100):
            got = index.neighbours(q, used, count)
            scores = sorted((-want[q, d], d) for d in range(60) if not used[d] and want[q, d] > 1e-9)
            assert np.allclose([want[q, d] for d in got[:count]], [-s for s, _ in scores[:count]], atol=1e-3)
            assert not any(used[d] for d in got)


def test_recall_against_brute_force(tables, byte_file):
    """The index with its shortened queries against every term of every document."""
    library = Tokenizer.from_file(byte_file)
    texts = sorted({r.text for r in tables("documents").select("text").collect() if r.text})
    docs = [np.array(library.encode(t, add_special_tokens=False).ids, np.int64) for t in texts]
    index, want = packing.Index(docs), bm25_fast(docs)
    hits = total = 0
    for q in range(0, len(docs), 3):
        used = np.zeros(len(docs), bool)
        used[q] = True
        scores = want[q].copy()
        scores[q] = -1
        best = set(np.argsort(-scores)[:10].tolist())
        hits += len(best & set(index.neighbours(q, used, 10)[:10]))
        total += len(best)
    assert hits / total > 0.9


def bm25_fast(docs):
    terms = np.unique(np.concatenate(docs))
    tf = np.zeros((len(docs), len(terms)))
    for k, d in enumerate(docs):
        np.add.at(tf[k], np.searchsorted(terms, d), 1)
    df, lengths = (tf > 0).sum(axis=0), tf.sum(axis=1, keepdims=True)
    weights = np.log1p((len(docs) - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * lengths / lengths.mean()))
    return (tf > 0).astype(float) @ weights.T


def test_windows_take_neighbours():
    """The rest of a window goes to the unused document that the seed ranks highest."""
    docs = [np.array([1, 2, 3]), np.array([7, 8]), np.array([1, 2]), np.array([7, 9])]
    pieces = list(packing.Packer(5).pack(docs))
    assert [p[0] for p in pieces[:2]] == [0, 2] and {p[0] for p in pieces[2:]} == {1, 3}


def test_topics_stay_together(make, byte_file):
    r = random.Random(9)
    rows = [(k, " ".join(r.choice(["red", "blue", "green", "pink"] if k % 2 else ["iron", "gold", "zinc", "lead"]) for _ in range(200))) for k in range(120)]
    pieces = packing.pack(make(rows, 1), byte_file, 0).collect()
    by: dict = {}
    for p in pieces:
        by.setdefault(p.sequence_id, set()).add(p.doc_id % 2)
    assert sum(len(x) == 1 for x in by.values()) > 0.7 * len(by)
