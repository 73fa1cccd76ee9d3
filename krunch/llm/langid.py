"""Language identification with a string kernel.

A text is cut in blocks of 1024 characters (the last takes the rest), each lower-cased. The kernel of two blocks
is the cosine of their blended spectra: which n-grams of two, three and four characters are present, hashed
to 8192 buckets. Nyström landmarks, blocks of the training sample, stand for the kernel; one ridge regression
against the rest for each language gives the decision values. Scoring is two matrix products for each 256 blocks.
A document's decision value is the mean over its blocks, weighted by their length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, sliced, without

BLOCK, GRAMS, BUCKETS = 1024, (2, 3, 4), 8192
#: The training sample: about so many documents of each language, and so many blocks in all, at most. Landmarks are for all languages together.
DOCS_EACH, BLOCKS_MOST, LANDMARKS, RIDGE = 400, 6000, 64, 1e-3
_AT_ONCE = 256
_PRIME = np.uint32(0x9E3779B1)
_ODDS = [np.uint32(x) for x in (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)]
UNKNOWN = "und"
#: Below this score a document is in none of the languages. Half is where the best decision value is zero; a line or two of a known language lies about there.
LEAST_SCORE = 0.35


def blocks(text: str) -> list[str]:
    text = text.lower()
    count = max(1, len(text) // BLOCK)
    return [text[k * BLOCK : (k + 1) * BLOCK] for k in range(count - 1)] + [text[(count - 1) * BLOCK :]]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def presence(some: list[str]) -> np.ndarray:
    """Rows of 0 and 1 over the buckets, one for each block. N-grams with the end mark tell how a block ends; none crosses into another."""
    gap = max(GRAMS) - 1
    codes = np.frombuffer("".join(b + "\0" * gap for b in some).encode("utf-32-le"), "<u4")
    lengths = np.fromiter(map(len, some), np.int64, len(some))
    row = np.repeat(np.arange(len(some)), lengths + gap)
    own = codes[: len(row)] != 0
    out = np.zeros((len(some), BUCKETS), np.float32)
    flat = out.reshape(-1)
    with np.errstate(over="ignore"):
        h = codes * _ODDS[0]
        for n in range(2, max(GRAMS) + 1):
            h = h[:-1] * _PRIME + codes[n - 1 :] * _ODDS[0]
            if n in GRAMS:
                x = (h ^ np.uint32(n)) * _ODDS[1]
                x ^= x >> np.uint32(15)
                x *= _ODDS[2]
                at = (row * BUCKETS)[: len(x)] + (x >> np.uint32(19)).astype(np.int64)
                flat[at[own[: len(x)]]] = 1
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  #: buckets x landmarks, unit columns
    weights: np.ndarray  #: landmarks x languages

    def decide(self, texts: list[str]) -> np.ndarray:
        """Decision values, texts x languages, each about -1 to 1."""
        pieces, owner, out = [], [], np.zeros((len(texts), len(self.langs)))
        total = np.zeros(len(texts))

        def flush():
            values = (unit(presence(pieces)) @ self.landmarks) @ self.weights
            size = np.fromiter(map(len, pieces), float, len(pieces))
            np.add.at(out, owner, values * size[:, None])
            np.add.at(total, owner, size)
            pieces.clear()
            owner.clear()

        for k, t in enumerate(texts):
            for b in blocks(t):
                pieces.append(b)
                owner.append(k)
                if len(pieces) == _AT_ONCE:
                    flush()
        if pieces:
            flush()
        return out / np.maximum(total, 1)[:, None]


def fit(rows: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Presence rows of blocks and their languages -> model. Landmarks are dealt to the languages in turn."""
    langs = sorted(set(labels))
    of = np.searchsorted(langs, labels)
    turns = [np.flatnonzero(of == k) for k in range(len(langs))]
    picked = [t[i] for i in range(max(map(len, turns))) for t in turns if i < len(t)][: max(landmarks, 2 * len(langs))]
    x = unit(rows)
    marks = x[picked]
    kernel = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = (x @ marks.T) @ root
    target = np.where(of[:, None] == np.arange(len(langs)), 1.0, -1.0)
    weight = 1 / np.bincount(of, minlength=len(langs))[of][:, None]
    # each language counts alike; the last column is the offset, which the unit kernel lacks
    gram = phi.T @ (phi * weight) + ridge * np.eye(phi.shape[1])
    solved = np.linalg.solve(gram, phi.T @ (target * weight))
    return Model(langs, np.ascontiguousarray(marks.T, np.float32), (root @ solved).astype(np.float32))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fits on a bounded sample of the rows with text, a letter and a language; None if there are none.

    Rows are picked by a hash of text and language, at a rate for each language that gives about DOCS_EACH different
    texts, and a text with its copies is one; of their blocks, BLOCKS_MOST with the lowest hashes come to the driver as
    bitmaps of one KB.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = rows.withColumn("hash", F.xxhash64("text", "lang"))
    counts = {r["lang"]: r["count"] for r in rows.select("lang", "hash").distinct().groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, DOCS_EACH / n))))[F.col("lang")]
    picked = rows.where(F.pmod("hash", F.lit(1 << 20)) < share * (1 << 20)).dropDuplicates(["lang", "hash"]).select("text", "lang")
    schema = pa.schema([("lang", pa.string()), ("bits", pa.binary())])

    def features(batches):
        for b in sliced(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not has_letter(text):
                    continue
                some = blocks(text)
                for at in range(0, len(some), _AT_ONCE):
                    bits = np.packbits(presence(some[at : at + _AT_ONCE]).astype(np.uint8), axis=1)
                    yield batch(schema, [lang] * len(bits), [x.tobytes() for x in bits])

    found = picked.mapInArrow(features, "lang string, bits binary").orderBy(F.xxhash64("bits", F.lit(7)), "lang", "bits").limit(BLOCKS_MOST).collect()
    if not found:
        return None
    bits = np.frombuffer(b"".join(bytes(r.bits) for r in found), np.uint8).reshape(len(found), -1)
    return fit(np.unpackbits(bits, axis=1).astype(np.float32), [r.lang for r in found])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row. No text, no letter, or no model: "und" with score 0.

    The score is the best decision value brought from -1..1 to 0..1; of equal values the first language wins.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for b in sliced(batches):
            texts = b.column(1).to_pylist()
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            some = [k for k, t in enumerate(texts) if model and has_letter(t)]
            if some:
                values = model.decide([texts[k] for k in some])
                for k, best, top in zip(some, values.argmax(axis=1).tolist(), values.max(axis=1).tolist(), strict=True):
                    names[k], scores[k] = model.langs[best], min(1.0, max(0.0, (top + 1) / 2))
            yield batch(schema, b.column(0), names, scores)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Trains on the rows not held out and predicts all: doc_id, held_out, lang_pred, score. A null doc_id isn't held out."""
    return _scored(docs, train(docs.where(~held_out())))


def _scored(docs: DataFrame, model: Model | None) -> DataFrame:
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")


def keep(docs: DataFrame) -> DataFrame:
    """The documents in a language that is known, with all columns of docs. If there is nothing to learn a language from all stay."""
    model = train(docs.where(~held_out()))
    if model is None:
        return docs
    return without(docs, lambda: _scored(docs, model).where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < LEAST_SCORE)), "foreign")
