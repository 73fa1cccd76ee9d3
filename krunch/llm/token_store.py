"""A content-addressed store of token ids.

Layout under one folder, all Parquet, so that any file system Spark knows will do and a lost task is redone:

* log/kind=0, the chunks: key (a digest), payload. Id streams are cut where a rolling hash over the last ids says so, so
  equal passages give equal chunks wherever they stand; each different chunk is stored once. The payload is little-endian,
  `width` bytes an id: two where the vocabulary allows, else four. Files are bucketed by key in Spark's own way, so that
  payloads needn't be shuffled to be looked up.
* recipes: bucket, start, doc_id, n_tokens, digests (one behind the other), root. In ascending doc_id order through
  the buckets; start counts from the bucket's first id, root is the Merkle root of the document's digests. A row
  without digests closes each bucket: the manifest, with its number of documents in start, of ids in n_tokens, and the
  Merkle root of its recipes' roots.
* top: the Merkle root of the buckets' roots, their number, the width, and in how many files the chunks are.

Reading puts every document together from its chunks. It recomputes the digest of every chunk and the root of every
document, bucket and store, and fails where one differs.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, batch, writing, pieces_of, sliced, write
from .tokenizing import encoder

#: A chunk ends where the lowest bits of the rolling hash are ones: every 256 ids on average, behind 32 at least, 4096 at most.
MASK, LEAST, MOST = 255, 32, 4096
#: Ids of a bucket, about. A bucket is read by one task, and the driver sees a row for each; above MANY buckets they grow instead.
BUCKET, MANY = 1 << 24, 200_000
_DIGEST = 16
#: Bytes of input for each file of chunks, about.
FILE = 16 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Merkle:
    """The Merkle root of leaves given in order, holding one node for each level. An odd node moves up as it is."""

    def __init__(self):
        self.levels: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        for k, node in enumerate(self.levels):
            if node is None:
                self.levels[k] = leaf
                return
            leaf, self.levels[k] = digest(node + leaf), None
        self.levels.append(leaf)

    def root(self) -> bytes:
        out = None
        for node in self.levels:
            if node is not None:
                out = node if out is None else digest(node + out)
        return digest(b"") if out is None else out


def merkle(leaves) -> bytes:
    tree = Merkle()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


def marks(ids: np.ndarray) -> np.ndarray:
    """Places behind which a chunk may end: where the hash of the last eight ids has its low bits set."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
        h ^= h >> np.uint64(29)
        power = _BASE
        for step in (1, 2, 4):  # each doubles the window
            h[step:] += h[:-step] * power
            power = power * power
    return np.flatnonzero((h >> np.uint64(32)) & np.uint64(MASK) == MASK) + 1


def chunk_ends(places: list[int], length: int) -> list[int]:
    """Ends of the chunks of an id stream from its marks. Marks before LEAST don't count, so it doesn't matter what stood before the stream."""
    ends, last = [], 0
    for at in places:
        if at - last < LEAST:
            continue
        ends += range(last + MOST, at, MOST)
        ends.append(at)
        last = at
    ends += range(last + MOST, length, MOST)
    return ends if not length or ends and ends[-1] == length else [*ends, length]


def cut(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream, by content."""
    return chunk_ends(marks(ids).tolist(), len(ids))


def _groups(streams, size: int = 1 << 19):
    """(number of the first, id streams) with about size ids in all; a longer stream stands alone."""
    first, some, held = 0, [], 0
    for ids in streams:
        if some and held + len(ids) > size:
            yield first, some
            first, some, held = first + len(some), [], 0
        some.append(ids)
        held += len(ids)
    if some:
        yield first, some


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes whole texts (null: empty), appends end_id to each, and writes the store at path.

    Equal and null doc_ids stay separate documents; nulls come first. An empty table gives an empty store.
    """
    spark = docs.sparkSession
    schema = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("place", pa.int64()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def tokenise(batches):
        end_mark = np.array([end_id], np.uint32)
        place, seen = TaskContext.get().partitionId() << 40, set()
        enc = encoder(tokenizer)
        width = f"<u{_width(enc.vocabulary, end_id)}"
        for b in sliced(batches):
            ids_of = b.column(0).to_pylist()
            for first, group in _groups(enc.encode(b.column(1))):
                rows: list[tuple] = []
                parts = [x for ids in group for x in (ids, end_mark)]
                stream = np.concatenate(parts)  # of several documents: their marks are found at once
                borders = np.cumsum([0, *(len(x) + 1 for x in group)]).tolist()
                places = marks(stream)
                firsts = np.searchsorted(places, borders, "right").tolist()
                data, size = stream.astype(width).tobytes(), int(width[2])
                for k in range(len(group)):
                    begin, length, digests = borders[k] * size, borders[k + 1] - borders[k], []
                    last = begin
                    for end in chunk_ends((places[firsts[k] : firsts[k + 1]] - borders[k]).tolist(), length):
                        end = begin + end * size
                        payload = data[last:end]
                        digests.append(name := digest(payload))
                        if name not in seen:  # by this task; the shuffle meets the others
                            seen.add(name)
                            rows.append((0, name, place, payload, None, None))
                        last = end
                    place += 1
                    rows.append((1, place.to_bytes(8, "big"), place, b"".join(digests), ids_of[first + k], length))
                yield batch(schema, *zip(*rows, strict=True))

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tokenise, "kind int, key binary, place long, payload binary, doc_id long, n_tokens long")
    files = pieces_of(docs, FILE)
    first = F.row_number().over(Window.partitionBy("kind", "key").orderBy("place"))
    _write_log(found.repartition(files, "key").withColumn("first", first).where("first = 1").drop("first"), path, files)
    log = spark.read.schema("place long, payload binary, doc_id long, n_tokens long").parquet(f"{path}/log/kind=1").withColumnRenamed("payload", "digests") if _has(spark, f"{path}/log/kind=1") else spark.createDataFrame([], "place long, digests binary, doc_id long, n_tokens long")
    total = log.agg(F.sum("n_tokens")).collect()[0][0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.col("place")]
    rows = log.select("doc_id", "place", "n_tokens", "digests").repartitionByRange(max(1, min(MANY, math.ceil(total / BUCKET))), *order).sortWithinPartitions(*order)
    out = pa.schema([("bucket", pa.int64()), ("start", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.binary()), ("root", pa.binary())])

    def recipe(batches):
        bucket, start, rows, tree = TaskContext.get().partitionId(), 0, 0, Merkle()
        for b in sliced(batches):
            doc_ids, sizes, lists = b.column(0).to_pylist(), b.column(2).to_pylist(), as_bytes(b.column(3))
            roots, starts = [_root(x) for x in lists], []
            for n, root in zip(sizes, roots, strict=True):
                starts.append(start)
                start += n
                tree.add(root)
            rows += len(sizes)
            yield batch(out, [bucket] * len(sizes), starts, doc_ids, sizes, lists, roots)
        if rows:
            yield batch(out, [bucket], [rows], [None], [start], [None], [tree.root()])

    write(rows.mapInArrow(recipe, _RECIPES), f"{path}/recipes")
    buckets = _manifests(spark, path)
    top = [(bytearray(merkle(bytes(r.root) for r in buckets)), len(buckets), _width(encoder(tokenizer).vocabulary, end_id), files)]
    write(spark.createDataFrame(top, "root binary, buckets long, width int, files int"), f"{path}/top")


def _has(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _write_log(rows: DataFrame, path: str, files: int) -> None:
    """Bucketed files have to be written as a table; only its entry in the catalog is dropped again, its files stay."""
    name = f"krunch_{uuid.uuid4().hex}"
    with writing(rows.sparkSession):
        rows.write.option("compression", "zstd").partitionBy("kind").bucketBy(files, "key").option("path", f"{path}/log").saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")


_RECIPES = "bucket long, start long, doc_id long, n_tokens long, digests binary, root binary"


def _width(vocabulary: int, end_id: int) -> int:
    return 2 if max(vocabulary - 1, end_id) < 1 << 16 else 4


def _root(digests: bytes) -> bytes:
    return merkle(digests[k : k + _DIGEST] for k in range(0, len(digests), _DIGEST))


def _manifests(spark: SparkSession, path: str) -> list:
    """A row for each bucket: one for BUCKET ids, MANY at most."""
    return spark.read.schema(_RECIPES).parquet(f"{path}/recipes").where("digests IS NULL").orderBy("bucket").select("bucket", "start", "n_tokens", "root").collect()


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload of every chunk."""
    if not _has(spark, f"{path}/log/kind=0"):
        return spark.createDataFrame([], "digest binary, payload binary")
    files, name = spark.read.parquet(f"{path}/top").collect()[0].files, f"krunch_{uuid.uuid4().hex}"
    place = f"{path}/log/kind=0".replace("'", r"\'")
    spark.sql(f"CREATE TABLE {name} (key BINARY, payload BINARY) USING parquet CLUSTERED BY (key) INTO {files} BUCKETS LOCATION '{place}'")
    out = spark.table(name).select(F.col("key").alias("digest"), "payload")
    out.schema  # resolved now, so that the name isn't needed any more
    spark.sql(f"DROP TABLE {name}")
    return out


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, n_chunks, ids_crc32 and ids (little-endian, unsigned, 32 bits each) of every document,
    put together from the files alone, in no order. start counts the ids of all documents before it.

    A bucket asks for each chunk once, however often its documents name it, so a chunk that very many documents
    share is sent once for each bucket.
    """
    found = _manifests(spark, path)
    top = spark.read.parquet(f"{path}/top").collect()[0]
    if merkle(bytes(r.root) for r in found) != bytes(top.root) or top.buckets != len(found):
        raise ValueError("the store's root doesn't match its manifests")
    heads, at = [], 0
    for r in found:
        heads.append((r.bucket, at, r.start, r.n_tokens, r.root))
        at += r.n_tokens
    width = top.width
    recipes = spark.read.schema(_RECIPES).parquet(f"{path}/recipes").where("digests IS NOT NULL")
    names = F.transform(F.sequence(F.lit(0), (F.octet_length("digests") / _DIGEST - 1).cast("int")), lambda k: F.substring(F.col("digests"), k * _DIGEST + 1, F.lit(_DIGEST)))
    wanted = recipes.where(F.octet_length("digests") > 0).select("bucket", F.explode(names).alias("digest")).distinct()
    nothing = F.lit(None)
    columns = ["bucket", "kind", "start", "doc_id", "n_tokens", "name", "data"]
    first = spark.createDataFrame(heads, "bucket long, start long, doc_id long, n_tokens long, data binary").select("bucket", F.lit(0).alias("kind"), "start", "doc_id", "n_tokens", nothing.cast("binary").alias("name"), "data")
    supply = chunks(spark, path).join(wanted.hint("shuffle_hash"), "digest").select("bucket", F.lit(1).alias("kind"), nothing.cast("long").alias("start"), nothing.cast("long").alias("doc_id"), nothing.cast("long").alias("n_tokens"), F.col("digest").alias("name"), F.col("payload").alias("data"))
    rows = recipes.select("bucket", F.lit(2).alias("kind"), "start", "doc_id", "n_tokens", F.col("digests").alias("name"), F.col("root").alias("data"))
    every = first.select(columns).unionByName(supply.select(columns)).unionByName(rows.select(columns))
    dealt = every.repartition(max(1, len(found)), "bucket").sortWithinPartitions("bucket", "kind", "start")
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("n_chunks", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def rebuild(batches):
        bucket, base, want, stored, tree, count, total = None, 0, None, {}, Merkle(), 0, 0

        def close():
            if want is not None and want != (count, total, tree.root()):
                raise ValueError(f"bucket {bucket} doesn't match its manifest")

        for b in sliced(batches, 1024):
            rows = []
            starts, ids, sizes = (b.column(k).to_pylist() for k in (2, 3, 4))
            for of, kind, start, doc_id, n, name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), starts, ids, sizes, as_bytes(b.column(5)), as_bytes(b.column(6)), strict=True):
                if kind == 0:
                    close()
                    bucket, base, want, stored, tree, count, total = of, start, (doc_id, n, data), {}, Merkle(), 0, 0
                elif of != bucket:
                    raise ValueError(f"bucket {of} has no manifest")
                elif kind == 1:
                    if digest(data) != name:
                        raise ValueError(f"chunk {name.hex()} doesn't match its digest")
                    stored[name] = data
                else:
                    keys = [name[k : k + _DIGEST] for k in range(0, len(name), _DIGEST)]
                    try:
                        whole = b"".join([stored[k] for k in keys])
                    except KeyError as e:
                        raise ValueError(f"document {doc_id} doesn't match its recipe: a chunk is missing") from e
                    if start != total or len(whole) != n * width or merkle(keys) != data:
                        raise ValueError(f"document {doc_id} doesn't match its recipe")
                    tree.add(data)
                    count, total = count + 1, total + n
                    wide = np.frombuffer(whole, f"<u{width}").astype("<u4").tobytes()
                    rows.append((doc_id, base + start, n, len(keys), zlib.crc32(wide), wide))
            if rows:
                yield batch(out, *zip(*rows, strict=True))
        close()

    return dealt.mapInArrow(rebuild, "doc_id long, start long, n_tokens long, n_chunks long, ids_crc32 long, ids binary")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks of every document, from its ids as put together."""
    return documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids: the id lists themselves."""

    def lists(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])
        for b in sliced(batches, 256):
            yield batch(schema, b.column(0), b.column(1), [np.frombuffer(x, "<u4").tolist() for x in as_bytes(b.column(2))])

    return documents(spark, path).select("doc_id", "start", "ids").mapInArrow(lists, "doc_id long, start long, ids array<long>")
