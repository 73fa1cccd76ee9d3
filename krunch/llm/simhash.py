"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits come from hashed word shingles. Two documents are linked when their fingerprints
differ in at most three bits. Cut in two segments of 32 bits, such a pair differs by at most one bit in one
of them; so each fingerprint looks up the 33 values of the Hamming ball of radius one around each of its
segments in a table of exact segment values, and the whole distance is verified on what is found.

A segment value that very many different fingerprints share (a large group of near copies) would make that
lookup quadratic. Fingerprints that look up such a value are linked through common centres instead, with
as many rows as a constant times their number: two fingerprints at distance two or less have a point within
one bit of both; at distance three, two of the three bits lie in one segment, and flipping these two leads
to a point one bit from the other. Every link made that way is within three bits, and none is lost up to
connection, which is all that components need.
"""

from __future__ import annotations

import re
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import as_bytes, batch, materialise, sliced, without
from .graph import components

SEED = 42
#: More different fingerprints than this with one segment value are linked through centres.
CROWD = 64
_BLOCK, _PART = 1 << 16, 4 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _words(text: bytes):
    """Lists of the words of a text, from some megabytes at a time."""
    at = 0
    while at < len(text):
        end = at + _PART
        if end < len(text):
            border = _SPACE.search(text, end)
            end = border.start() if border else len(text)
        yield text[at:end].lower().split()
        at = end


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """SimHash of a UTF-8 text: A-Z lower-cased, words between ASCII white space, shingles with their repeats.

    Fewer words than a shingle takes: one shingle of all of them. No word, or null: zero.
    """
    ones, total, last = np.zeros(64, np.int64), 0, []

    def add(shingles):
        nonlocal total
        hashes = map(xxh64_intdigest, shingles, repeat(SEED))
        while len(block := np.fromiter(islice(hashes, _BLOCK), np.uint64)):
            bits = np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones[:] += bits.sum(axis=0, dtype=np.uint32)
            total += len(block)

    for found in _words(text or b""):
        found = last + found
        add(map(b" ".join, zip(*(found[i:] for i in range(words)))))
        last = found[max(0, len(found) - words + 1) :]
    if not total and last:
        add([b" ".join(last)])
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in sliced(batches):
            fps = np.fromiter((fingerprint(t, words) for t in as_bytes(b.column(1))), np.uint64, b.num_rows)
            yield batch(schema, b.column(0), pa.array(fps.view(np.int64)))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _flips(pairs: bool) -> list[int]:
    """Masks as signed longs: none and single bits, or the pairs of bits within one half."""
    if pairs:
        masks = [1 << i | 1 << j for half in (0, 32) for i in range(half, half + 32) for j in range(i)  if j >= half]
    else:
        masks = [0] + [1 << i for i in range(64)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _explode_flips(fps: DataFrame, pairs: bool) -> DataFrame:
    masks = F.lit(_flips(pairs)).cast(T.ArrayType(T.LongType()))
    return fps.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("centre"))


def _segments(column: str = "fp"):
    """Both segment values, each with its own number in bit 32."""
    low = F.col(column).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    high = F.shiftrightunsigned(F.col(column), 32).bitwiseOR(F.lit(1 << 32).cast("long"))
    return F.array(low, high)


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b), a subset of the pairs within three bits that connects the same components."""
    table = fps.select("fp", F.explode(_segments()).alias("seg"))
    crowded = materialise(table.groupBy("seg").count().where(F.col("count") > crowd).select("seg"), "crowded")
    ball = F.lit([0] + [1 << i for i in range(32)]).cast(T.ArrayType(T.LongType()))
    probes = table.select(F.col("fp").alias("a"), "seg", F.explode(ball).alias("m")).select("a", F.col("seg").bitwiseXOR(F.col("m")).alias("seg"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3
    if not crowded.limit(1).count():
        found = probes.join(table.withColumnRenamed("fp", "b").hint("shuffle_hash"), "seg").where(near & (F.col("a") != F.col("b")))
        return found.select("a", "b")
    sparse = table.join(crowded, "seg", "left_anti").withColumnRenamed("fp", "b")
    found = probes.join(sparse.hint("shuffle_hash"), "seg").where(near & (F.col("a") != F.col("b"))).select("a", "b")
    among = materialise(probes.join(crowded, "seg", "left_semi").select(F.col("a").alias("fp")).distinct(), "crowd")
    within_one = _explode_flips(among, False)
    least = within_one.groupBy("centre").agg(F.min("fp").alias("b"))
    by_centre = within_one.unionByName(_explode_flips(among, True)).join(least, "centre").where("fp <> b")
    return found.unionByName(by_centre.select(F.col("fp").alias("a"), "b").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links of at most three bits).

    Null and empty texts have fingerprint zero and are linked like any other. Equal doc_ids stay separate rows.
    An empty table gives an empty result. Other columns of docs are ignored.
    """
    signed = materialise(fingerprints(docs, id_col, text_col, words), "fingerprints")
    owners = signed.groupBy("fp").agg(F.min("doc_id").alias("first"))
    owners = materialise(owners, "owners")
    roots = materialise(components(links(owners.select("fp"))), "roots")
    joined = owners.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    of_root = roots.join(owners.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("first").alias("component"))
    classes = joined.join(of_root, "root", "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return signed.join(classes, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that are the first of their component, with all columns of docs. Rows with one doc_id are one document."""
    return without(docs, lambda: near_duplicates(docs).where("doc_id <> component_id"), "duplicates")
