"""The benchmark matrix: file x codec x level x size as a DataFrame, with ratio, rate and the change against the reference codec."""

from __future__ import annotations

import hashlib
import time

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.container import DEFAULT_CHUNK, compress_chunk
from ..functions.meta import MOST
from .codecs import codec, codecs
from .stages import resize

LEVELS, SIZES = (1, 6, 9), (10_000, 100_000, 1_000_000)


def _noise(seed: str, n: int) -> bytes:
    """Bytes from a counter's hashes: the same everywhere."""
    return b"".join(hashlib.sha256(f"{seed}:{k}".encode()).digest() for k in range(-(-n // 32)))[:n]


def shapes(n: int = 1 << 18) -> dict[str, bytes]:
    """Made files: all zero, noise, noise with repeats at growing distances, and skewed letters."""
    noise, out = _noise("noise", n), bytearray(_noise("repeats", 256))
    steps = _noise("steps", n)
    for k in range(0, len(steps) - 4, 4):
        distance, length = 1 + int.from_bytes(steps[k : k + 2], "big") % min(len(out), 32767), 4 + steps[k + 2] % 60
        for _ in range(length):
            out.append(out[-distance])
        out += steps[k + 3 : k + 4]
        if len(out) >= n:
            break
    letters = "etaoinshrdlucmfwypvbgkjqxzéü".encode()
    skewed = bytes(letters[min(b.bit_length() * 3 + (b & 3), len(letters) - 1)] for b in _noise("skewed", n))
    return {"zeros.bin": bytes(n), "random.bin": noise, "repeats.bin": bytes(out[:n]), "huffman.txt": skewed}


def shape_files(spark: SparkSession, n: int = 1 << 18) -> DataFrame:
    return spark.createDataFrame([(k, bytearray(v)) for k, v in shapes(n).items()], "file string, data binary")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a path as (file, data), by Spark's own reader."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("file"), F.col("content").alias("data"))


def codec_table(spark: SparkSession) -> DataFrame:
    """format, codec, rank, can_encode, can_decode: as many rows as codecs are registered."""
    return spark.createDataFrame([(c.format, c.name, c.rank, c.encode is not None, c.decode is not None) for c in codecs()], "format string, codec string, rank int, can_encode boolean, can_decode boolean")


def references(spark: SparkSession) -> DataFrame:
    """The codec of each format that others are compared with: of those that encode, the one of least rank."""
    return codec_table(spark).where("can_encode").groupBy("format").agg(F.min_by("codec", "rank").alias("codec"))


def matrix(files: DataFrame, levels=LEVELS, sizes=SIZES) -> DataFrame:
    """file, format, codec, level, size with data of that size. The factors besides files are lists of constants."""
    spark = files.sparkSession
    grid = codec_table(spark).where("can_encode").select("format", "codec", "rank").withColumn("level", F.explode(F.lit(list(levels)))).withColumn("size", F.explode(F.lit(list(sizes))))
    return files.crossJoin(F.broadcast(grid)).select("file", "format", "codec", "rank", "level", "size", "data")


def run(files: DataFrame, levels=LEVELS, sizes=SIZES) -> DataFrame:
    """file, format, codec, level, size, raw, comp, ratio, enc_mb_s, dec_mb_s, ok: each cell timed where it runs."""
    cells = matrix(files, levels, sizes).withColumn("data", F.element_at(F.create_map(*(x for n in sizes for x in (F.lit(n), resize(F.col("data"), n)))), F.col("size")))
    schema = pa.schema([("file", pa.string()), ("format", pa.string()), ("codec", pa.string()), ("rank", pa.int32()), ("level", pa.int32()), ("size", pa.int64()), ("raw", pa.int64()), ("comp", pa.int64()), ("ratio", pa.float64()), ("enc_mb_s", pa.float64()), ("dec_mb_s", pa.float64()), ("ok", pa.bool_())])

    def measure(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                used, data = codec(r["codec"]), r["data"]
                decoder = used if used.decode else codec(used.format)
                t0 = time.perf_counter()
                comp = used.encode(data, r["level"])
                t1 = time.perf_counter()
                back, _, fault = decoder.decode(comp, len(data))
                t2 = time.perf_counter()
                rows.append((r["file"], r["format"], r["codec"], r["rank"], r["level"], r["size"], len(data), len(comp), len(data) / len(comp), len(data) / 1e6 / (t1 - t0), len(data) / 1e6 / (t2 - t1), fault is None and back == data))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    kind = "file string, format string, codec string, rank int, level int, size long, raw long, comp long, ratio double, enc_mb_s double, dec_mb_s double, ok boolean"
    return cells.mapInArrow(measure, kind)


def with_delta(results: DataFrame, value: str, *by: str) -> DataFrame:
    """Adds delta: value over that of the first codec of the same cell."""
    return results.withColumn("delta", F.col(value) / F.first(value).over(Window.partitionBy(*by).orderBy("rank", "codec").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def report(results: DataFrame, value: str) -> DataFrame:
    """A row for each file, level and size, a column for each codec."""
    names = sorted(c.name for c in codecs() if c.encode)
    return results.groupBy("file", "level", "size").pivot("codec", names).agg(F.first(value))


def cross_check(streams: DataFrame, stream_id: str, data: str) -> DataFrame:
    """format, encoder, decoder, stream_id, ok: whether every decoder of a format gives back what every encoder of it made."""
    pairs = [(e, d) for e in codecs() if e.encode for d in codecs() if d.decode and d.format == e.format]
    schema = pa.schema([("format", pa.string()), ("encoder", pa.string()), ("decoder", pa.string()), ("stream_id", pa.int64()), ("ok", pa.bool_())])

    def check(batches):
        for b in batches:
            rows = []
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                made = {e.name: e.encode(x, 0) for e, _ in pairs}
                rows += [(e.format, e.name, d.name, k, d.decode(made[e.name], len(x))[::2] == (x, None)) for e, d in pairs]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return streams.select(F.col(stream_id).cast("long"), F.coalesce(F.col(data).cast("binary"), F.lit(b""))).mapInArrow(check, "format string, encoder string, decoder string, stream_id long, ok boolean")


def chunking_cost(streams: DataFrame, stream_id: str, data: str, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """stream_id, streamed, chunked, n_chunks: compressed size whole and in chunks."""

    def run(x: bytes) -> dict:
        parts = [x[k : k + chunk] for k in range(0, len(x), chunk)]
        return {"streamed": len(codec("deflate").encode(x, 0)), "chunked": sum(len(compress_chunk(p)) for p in parts), "n_chunks": len(parts)}

    from .codecs import transform

    found = streams.select(F.col(stream_id).alias("stream_id"), transform(F.col(data), run, "struct<streamed:bigint,chunked:bigint,n_chunks:bigint>").alias("r"))
    return found.select("stream_id", "r.*")


def meta_efficiency(spark: SparkSession) -> DataFrame:
    """n_bytes, ones and the code length of every possible number of one bits in meta blocks of 0 to 31 bytes."""
    from ..functions.bits import meta_code_length

    rows = spark.range(MOST + 1).select(F.col("id").cast("int").alias("n_bytes")).withColumn("ones", F.explode(F.sequence(F.lit(0), 8 * F.col("n_bytes"))))
    return rows.withColumn("code_length", meta_code_length(8 * F.col("n_bytes") - F.col("ones"), F.col("ones")))
