"""Packing by lexical retrieval.

Documents are put in an order that brings lexical neighbours together (see route), dealt to partitions of about
PARTITION ids, and read there in shards of about SHARD ids. A shard has a BM25 inverted index over its token ids.
A window starts with a seed document; the unused neighbours that the index ranks highest for it fill the window,
the last one cut where the window ends, and the rest of that one seeds the next window. Only the last window of a
partition can stay open.

A seed's TERMS terms of highest weight have short posting lists; they nominate the candidates, and these are ranked
by all terms. Postings of documents already used are dropped now and then. What a shard doesn't hold its seeds can't
find: SHARD is the price of a bounded index, as every document must be used once, by one window. README has the recall
against brute-force BM25 over all documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batch, materialise, sliced
from .tokenizing import encoder

WINDOW = 1024
#: Ids of a shard and of a partition, about. A shard of 12 million takes some 300 MB while it is indexed.
SHARD, PARTITION = 12_000_000, 12_000_000
K1, B = 1.2, 0.75
#: Terms of a seed that nominate, and how many are ranked by all terms, at least.
TERMS, CANDIDATES = 40, 96
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Index:
    """BM25 over the documents of one shard: the postings of each term, one behind the other, with their weights."""

    def __init__(self, docs: list[np.ndarray], terms: int = TERMS):
        self.size, self.most = len(docs), terms
        lengths = np.fromiter(map(len, docs), np.int64, self.size)
        # a posting for each different id of a document, in order of document
        unique = [np.unique(d, return_counts=True) for d in docs]
        counts = np.fromiter((len(u) for u, _ in unique), np.int64, self.size)
        self.bounds = np.append(0, np.cumsum(counts))
        self.ids = np.concatenate([u for u, _ in unique]).astype(np.int64)
        tf = np.concatenate([n for _, n in unique]).astype(np.float32)
        del unique
        order = np.argsort(self.ids, kind="stable")
        owner = np.repeat(np.arange(self.size), counts)
        df = np.bincount(self.ids)
        self.first = np.append(0, np.cumsum(df))
        idf = np.log1p((self.size - df + 0.5) / (df + 0.5)).astype(np.float32)
        norm = (K1 * (1 - B + B * lengths / max(lengths.mean(), 1))).astype(np.float32)
        self.weights = idf[self.ids] * tf * np.float32(K1 + 1) / (tf + norm[owner])
        # as bincount takes them, without a copy
        self.posting, self.posted = owner[order], self.weights[order].astype(np.float64)
        self.df, self.asked = df, np.zeros(len(df), np.float32)

    def query(self, doc: int) -> np.ndarray:
        """The terms of a document that weigh most in it and that another document has, each once."""
        a, b = self.bounds[doc], self.bounds[doc + 1]
        ids, weights = self.ids[a:b], self.weights[a:b]
        shared = self.df[ids] > 1
        ids, weights = ids[shared], weights[shared]
        return ids[np.argpartition(-weights, self.most)[: self.most]] if len(ids) > self.most else ids

    def neighbours(self, doc: int, used: np.ndarray, count: int) -> list[int]:
        """The unused documents that the query ranks highest, best first; of equal ones the earlier first."""
        terms = self.query(doc)
        lists = [slice(a, b) for a, b in zip(self.first[terms].tolist(), self.first[terms + 1].tolist(), strict=True)]
        if not lists:
            return []
        scores = np.bincount(np.concatenate([self.posting[x] for x in lists]), np.concatenate([self.posted[x] for x in lists]), self.size)
        scores *= ~used
        found, most = np.flatnonzero(scores > 0), max(count, CANDIDATES)
        if len(found) > most:
            found = np.sort(found[np.argpartition(-scores[found], most)[:most]])
        if not len(found):
            return []
        scores = self.whole(doc, found)
        order = np.argsort(-scores, kind="stable")
        return found[order].tolist()

    def whole(self, doc: int, found: np.ndarray) -> np.ndarray:
        """Scores of some documents for all terms of one."""
        ids = self.ids[self.bounds[doc] : self.bounds[doc + 1]]
        self.asked[ids] = self.df[ids] > 1
        first, last = self.bounds[found], self.bounds[found + 1]
        rows = [slice(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        shared = np.concatenate([self.ids[x] for x in rows])
        sizes = last - first
        hits = self.asked.take(shared, mode="clip")
        hits *= np.concatenate([self.weights[x] for x in rows])
        out = np.add.reduceat(hits, np.cumsum(sizes) - sizes)
        self.asked[ids] = 0
        return out

    def drop(self, used: np.ndarray) -> None:
        """Postings of used documents find nothing any more."""
        keep = ~used[self.posting]
        self.first = np.append(0, np.cumsum(keep))[self.first]
        self.posting, self.posted = self.posting[keep], self.posted[keep]


class Packer:
    """Windows of one partition, over its shards in turn. pack() yields (document, start, length, window, offset)."""

    def __init__(self, window: int = WINDOW, terms: int = TERMS):
        self.window, self.terms, self.number, self.filled = window, terms, 0, 0

    def _take(self, doc: int, start: int, length: int) -> tuple[int, int, int, int, int]:
        piece = doc, start, length, self.number, self.filled
        self.filled += length
        if self.filled == self.window:
            self.number, self.filled = self.number + 1, 0
        return piece

    def pack(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        index = Index(docs, self.terms) if len(docs) > 1 else None
        used, lengths = np.zeros(len(docs), bool), [len(d) for d in docs]
        seed, ranked, following, wanted = None, iter(()), 0, 0
        for turn in range(len(docs)):
            if turn and turn % max(64, len(docs) // 16) == 0:
                index.drop(used)
            doc = None
            while seed is not None and self.filled and doc is None:
                doc = next((k for k in ranked if not used[k]), None)
                if doc is None:
                    found = index.neighbours(seed, used, wanted) if wanted else []
                    if not found:
                        break
                    ranked, wanted = iter(found), wanted * 4
            if doc is None:  # a new window, or a seed without neighbours: the next document in the shard's order
                while used[following]:
                    following += 1
                doc = following
            if seed is None:
                seed, ranked, wanted = doc, iter(()), 8
            used[doc] = True
            start = 0
            while start < lengths[doc]:
                if start and not self.filled:
                    seed, ranked, wanted = doc, iter(()), 8  # what is left of it opens a window
                length = min(lengths[doc] - start, self.window - self.filled)
                yield self._take(doc, start, length)
                start += length
            if not self.filled:
                seed = None


def route(ids: np.ndarray) -> int:
    """A key by which near copies stand together: the least hash of a document's pairs of ids."""
    if len(ids) < 2:
        return 0
    wide = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = wide[:-1] * _MIX
        wide += np.uint64(7)
        h ^= wide[1:]
        h *= _MIX
        h ^= h >> np.uint64(32)
    return int(h.min() >> np.uint64(1))


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, shard: int = SHARD, partition: int = PARTITION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are their end id alone. Repeated rows are packed each. An empty table gives no rows.
    """
    tokens = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def width(enc) -> str:
        return "<u2" if max(enc.vocabulary - 1, end_id) < 1 << 16 else "<u4"

    def tokenise(batches):
        enc, row = encoder(tokenizer), TaskContext.get().partitionId() << 40
        end = np.array([end_id], np.uint32)
        for b in sliced(batches):
            keys, rows, sizes = [], [], []
            for ids in enc.encode(b.column(1)):
                keys.append(route(ids))
                sizes.append(len(ids) + 1)
                rows.append(np.concatenate([ids, end]).astype(width(enc)).tobytes())
            yield batch(tokens, b.column(0), keys, np.arange(row, row + len(rows)), sizes, rows)
            row += len(rows)

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tokenise, "doc_id long, key long, row long, n long, ids binary")
    encoded = materialise(found, "tokens")
    total = encoded.agg(F.sum("n")).collect()[0][0] or 0
    # row parts what has one key; it makes no difference to a document's pieces
    order = [F.col("key"), F.xxhash64("doc_id", "row")]
    dealt = encoded.drop("n").repartitionByRange(max(1, math.ceil(total / partition)), *order).sortWithinPartitions(*order)
    out = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def fill(batches):
        packer, base = Packer(window), TaskContext.get().partitionId() << 33
        kind = width(encoder(tokenizer))
        ids, rows, size = [], [], 0

        def filled():
            pieces = []
            for d, start, length, k, offset in packer.pack(rows):
                pieces.append((ids[d], start, length, zlib.crc32(rows[d][start : start + length].astype("<u4").tobytes()), len(rows[d]), base + k, offset))
                if len(pieces) == 1 << 16:
                    yield batch(out, *zip(*pieces, strict=True))
                    pieces = []
            if pieces:
                yield batch(out, *zip(*pieces, strict=True))

        for b in sliced(batches):
            for doc_id, raw in zip(b.column(0).to_pylist(), as_bytes(b.column(3)), strict=True):
                ids.append(doc_id)
                rows.append(np.frombuffer(raw, kind))
                size += len(rows[-1])
                if size >= shard:
                    yield from filled()
                    ids, rows, size = [], [], 0
        if rows:
            yield from filled()

    return dealt.mapInArrow(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
