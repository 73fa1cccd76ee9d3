import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from krunch.llm import token_store
from krunch.llm.common import new_path
from krunch.llm.tokenizing import Encoder

PIECES = st.lists(st.sampled_from(["  ", " ", "\n", "\t", "ab", "The", ".", ",", "é", "'s", "$", "1", "漢", "Σ", "́", "\x1d", "<|endoftext|>", " ", "œ"]), max_size=14).map("".join)


@pytest.mark.parametrize("name", ["word_file", "byte_file"])
def test_ids_are_the_librarys(name, request):
    path = request.getfixturevalue(name)
    mine, library = Encoder(path), Tokenizer.from_file(path)
    assert mine.kind

    @given(st.lists(st.one_of(PIECES, st.text(max_size=30), st.none()), max_size=12))
    @settings(max_examples=1000, deadline=None)
    def check(texts):
        for text, ids in zip(texts, mine.encode(pa.array(texts, pa.string())), strict=True):
            assert ids.tolist() == (library.encode(text, add_special_tokens=False).ids if text else [])

    check()


def test_small_cache_and_slices(word_file, monkeypatch):
    monkeypatch.setattr("krunch.llm.tokenizing.CACHE", 5)
    monkeypatch.setattr("krunch.llm.tokenizing.BLOCK", 40)
    mine, library = Encoder(word_file), Tokenizer.from_file(word_file)
    texts = [None, "", *(f"some words number {k}, and more." * (k % 5) for k in range(40)), None]
    for column in (pa.array(texts), pa.array(["x", *texts]).slice(1)):
        assert [x.tolist() for x in mine.encode(column)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


@given(st.integers(0, 20_000), st.integers(0, 5), st.integers(0, 3000))
@settings(max_examples=40, deadline=None)
def test_cuts(n, seed, at):
    ids = np.random.default_rng(seed).integers(0, 49408, n).astype(np.uint32)
    ends = token_store.cut(ids)
    assert ends == sorted(set(ends)) and (not n or ends[-1] == n)
    sizes = np.diff([0, *ends])
    assert all(s <= token_store.MOST for s in sizes) and all(s >= token_store.LEAST for s in sizes[:-1])
    # what is put in front moves few chunks
    more = token_store.cut(np.concatenate([ids[:at], ids]).astype(np.uint32))
    if n > 8000:
        old = {ids[a:b].tobytes() for a, b in zip([0, *ends], ends)}
        longer = np.concatenate([ids[:at], ids])
        new = {longer[a:b].tobytes() for a, b in zip([0, *more], more)}
        assert len(old - new) <= 3


def store(make, rows, file, **kw):
    docs = make(rows, **kw)
    path = new_path(docs.sparkSession, "test-store")
    token_store.write_store(docs, path, file, 1)
    return docs.sparkSession, path


def test_round_trip(make, word_file):
    r = random.Random(1)
    passage = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) + str(r.randrange(50)) for _ in range(3000))
    rows = [(5, "Hello, world"), (3, None), (9, ""), (7, passage), (8, "a new start. " + passage), (1, passage), (-4, "minus"), (6, "twice"), (6, "twice")]
    spark, path = store(make, rows, word_file)
    library = Tokenizer.from_file(word_file)
    want, at = [], 0
    for doc, text in sorted(rows, key=lambda x: x[0]):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    index = sorted((x.doc_id, x.start, x.n_tokens, x.ids_crc32) for x in token_store.read_index(spark, path).collect())
    assert index == [x[:4] for x in want]
    assert sorted((x.doc_id, x.start, x.ids) for x in token_store.read_ids(spark, path).collect()) == [(d, s, i) for d, s, _, _, i in want]
    chunks = token_store.chunks(spark, path)
    assert chunks.count() == chunks.select("digest").distinct().count() and chunks.selectExpr("sum(octet_length(payload))").collect()[0][0] < 0.6 * 2 * at


def test_empty_and_null_ids(make, word_file):
    spark, path = store(make, [(1, "x")], word_file)
    assert token_store.read_index(spark, path).count() == 1
    path = new_path(spark, "test-store")
    token_store.write_store(make([(1, "x")]).limit(0), path, word_file, 1)
    assert token_store.read_index(spark, path).count() == 0 and token_store.read_ids(spark, path).count() == 0
    spark, path = store(make, [(None, "a b"), (2, "c")], word_file)
    assert [(x.doc_id, x.start) for x in token_store.read_index(spark, path).orderBy("start").collect()] == [(None, 0), (2, 3)]


def test_damage_is_found(make, word_file, spark):
    _, path = store(make, [(k, f"text number {k} with words") for k in range(20)], word_file)
    good, schema = token_store.chunks(spark, path).collect(), "key binary, payload binary"
    for change in ([(good[0].digest, bytearray(bytes(good[0].payload)[::-1]))], [(bytearray(b"?" * 16), good[0].payload)], []):
        bad = new_path(spark, "test-store")
        for part in ("recipes", "top"):
            spark.read.parquet(f"{path}/{part}").write.parquet(f"{bad}/{part}")
        rows = spark.createDataFrame([(r.digest, r.payload) for r in good[1:]] + change, schema).selectExpr("*", "0 AS kind")
        token_store._write_log(rows, bad, spark.read.parquet(f"{path}/top").collect()[0].files)
        with pytest.raises(Exception, match="doesn't match"):
            token_store.read_index(spark, bad).collect()


def test_shared_chunks_and_many_buckets(make, word_file, monkeypatch):
    monkeypatch.setattr(token_store, "BUCKET", 2000)
    passage = " ".join(f"word{k % 97} of{k % 31}" for k in range(2000))
    rows = [(k, passage) for k in range(30)] + [(100 + k, f"{k} {passage}") for k in range(10)]
    spark, path = store(make, rows, word_file)
    found = token_store.read_index(spark, path).orderBy("start").collect()
    library = Tokenizer.from_file(word_file)
    at = 0
    for r, (doc_id, text) in zip(found, sorted(rows), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert spark.read.parquet(f"{path}/recipes").where("digests IS NULL").count() > 5
    chunks = token_store.chunks(spark, path)
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_merkle():
    leaves = [bytes([k]) * 16 for k in range(7)]
    assert len({token_store.merkle(leaves[:k]) for k in range(8)}) == 8
    assert token_store.merkle(leaves[::-1]) != token_store.merkle(leaves)


def test_words_at_the_limit_of_the_cache(byte_file, word_file):
    """Pieces as long as the cache takes and longer ones, letters at the ends of their ranges, and words met twice."""
    from tokenizers import Tokenizer

    import pyarrow as pa
    from krunch.llm.tokenizing import Encoder

    words = [c * n for c in "aZÀÖØöøÿ×÷ß" for n in (1, 2, 46, 47, 48, 49, 50)]
    texts = [" ".join(words), "\n".join(words), *words, " ".join(reversed(words)), None, ""]
    for file in (byte_file, word_file):
        enc, library = Encoder(file), Tokenizer.from_file(file)
        for _ in range(2):
            got = [x.tolist() for x in enc.encode(pa.array(texts))]
            assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
            enc.cache, enc.older = {"": b""}, enc.cache


class Counted:
    """A tokenizer that counts the calls for its ids."""

    def __init__(self, inner):
        self.inner, self.calls = inner, 0

    def encode(self, *args, **kw):
        self.calls += 1
        return self.inner.encode(*args, **kw)

    def encode_batch_fast(self, *args, **kw):
        self.calls += 1
        return self.inner.encode_batch_fast(*args, **kw)


@pytest.mark.parametrize("name", ["word_file", "byte_file"])
def test_words_met_long_ago_are_not_encoded_again(name, request, monkeypatch):
    """What takes the time of op5_packing: words that were thrown out after two generations of the cache."""
    monkeypatch.setattr("krunch.llm.tokenizing.CACHE", 5)
    monkeypatch.setattr("krunch.llm.tokenizing.BLOCK", 40)
    path = request.getfixturevalue(name)
    mine, library = Encoder(path), Tokenizer.from_file(path)
    texts = [" ".join("thon" + chr(97 + j) + chr(97 + k) for k in range(26)) + "." for j in range(26)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in mine.encode(pa.array(texts))] == want
    for held in [k for k, v in vars(mine).items() if isinstance(v, Tokenizer)]:
        setattr(mine, held, Counted(getattr(mine, held)))
    assert [x.tolist() for x in mine.encode(pa.array(texts))] == want
    assert sum(v.calls for v in vars(mine).values() if isinstance(v, Counted)) < 5


@pytest.mark.parametrize("name", ["word_file", "byte_file"])
def test_pieces_of_one_place_and_of_the_tables_sizes(name, request, monkeypatch):
    """Pieces that drive each other out of the table, zero bytes, and pieces as long, and of as many ids, as a row holds or more."""
    monkeypatch.setattr("krunch.llm.tokenizing.SLOTS", 3, raising=False)
    path = request.getfixturevalue(name)
    mine, library = Encoder(path), Tokenizer.from_file(path)
    sizes = [c * n for c in "aqé漢" for n in (1, 7, 8, 9, 10, 11, 12, 21, 22, 23, 24, 25)]
    zeros = ["a", "a\0", "a\0\0", "\0", " \0", "\0" * 23, "\0" * 24]
    texts = [*sizes, *zeros, *(" " + x for x in sizes), " ".join(sizes), "\n".join(sizes + zeros), "qzxj" * 5 + " " + "zqxjk" * 4, None, ""]
    for _ in range(2):
        for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["x", *texts]).slice(1)):
            assert [x.tolist() for x in mine.encode(column)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
