"""Streams cut in chunks, their index, and reading ranges through it.

A stream is a row with an id and bytes; its chunks are rows with stream_id, chunk_id, raw_start and raw_end. Index records
hold ends, as sums over the chunks of a stream. All of it is windows and joins on (stream_id, chunk_id).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import container
from ..functions.errors import CodecError
from .codecs import in_slices, transform

CHUNK = 4096


def plan(streams: DataFrame, chunk: int = CHUNK, stream_id: str = "stream_id", data: str = "data", keep_bytes: bool = True) -> DataFrame:
    """stream_id, chunk_id, raw_start, raw_end and raw: a row for each chunk. An empty or null stream has none."""
    n = F.octet_length(F.col(data))
    ids = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")))
    rows = streams.select(F.col(stream_id).alias("stream_id"), F.col(data).alias("_data"), F.explode(ids).alias("chunk_id"))
    start = F.col("chunk_id").cast("long") * chunk
    raw = [F.substring(F.col("_data"), (start + 1).cast("int"), F.lit(chunk)).alias("raw")] if keep_bytes else []
    return rows.select("stream_id", "chunk_id", start.alias("raw_start"), F.least(start + chunk, F.octet_length("_data").cast("long")).alias("raw_end"), *raw)


def store(chunks: DataFrame, level: int = 0) -> DataFrame:
    """Adds comp: each chunk by itself, ended by a sync marker."""
    container.zlib_level(level)
    return chunks.withColumn("comp", transform(F.col("raw"), lambda x: container.compress_chunk(x, level), "binary"))


def index(chunks: DataFrame, comp_size: Column, raw_size: Column) -> DataFrame:
    """Adds comp_end and raw_end: where each chunk ends in its stream. One window, partitioned by stream."""
    so_far = Window.partitionBy("stream_id").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("comp_end", F.sum(comp_size).over(so_far)).withColumn("raw_end", F.sum(raw_size).over(so_far))


def with_starts(indexed: DataFrame, *ends: str) -> DataFrame:
    """Adds the start for each end column: the end of the record before, 0 for the first."""
    before = Window.partitionBy("stream_id").orderBy("chunk_id")
    return indexed.select("*", *(F.coalesce(F.lag(e).over(before), F.lit(0)).alias(e.replace("_end", "_start")) for e in ends))


def merge(fragments: DataFrame, part: str) -> DataFrame:
    """Index fragments of one stream, numbered by part, set behind each other: raw_end and comp_end count from the stream's start."""
    order = Window.partitionBy("stream_id").orderBy(part, "chunk_id")
    size = {e: F.col(e) - F.coalesce(F.lag(e).over(Window.partitionBy("stream_id", part).orderBy("chunk_id")), F.lit(0)) for e in ("raw_end", "comp_end")}
    sized = fragments.select("*", *(v.alias(f"_{e}") for e, v in size.items()))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    out = sized.withColumn("record", F.row_number().over(order) - 1)
    for e in size:
        out = out.withColumn(e, F.sum(f"_{e}").over(so_far)).drop(f"_{e}")
    return out


def totals(indexed: DataFrame) -> DataFrame:
    """The last record of each stream."""
    return indexed.groupBy("stream_id").agg(F.count("*").alias("n_chunks"), F.max("comp_end").alias("comp_size"), F.max("raw_end").alias("raw_size"))


def flushed_indexes(indexed: DataFrame, index_size: int = container.DEFAULT_INDEX) -> DataFrame:
    """The indexes that a writer puts out: one for each index_size records of a stream and one for the rest."""
    return indexed.groupBy("stream_id", F.floor(F.col("chunk_id") / index_size).cast("int").alias("index_id")).agg(F.count("*").alias("records"), F.min("raw_start").alias("raw_start"), F.max("raw_end").alias("raw_end"))


def search(requests: DataFrame, chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Requests (stream_id, offset) with the chunk that holds the offset; null columns beyond the end.

    Chunks of a stream have one size, so the interval is an equality on (stream_id, offset div chunk), which shuffles and
    broadcasts like any other.
    """
    keyed = requests.withColumn("chunk_id", F.floor(F.col("offset") / chunk).cast("int"))
    return keyed.join(chunks, ["stream_id", "chunk_id"], "left")


def read_ranges(requests: DataFrame, store: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Requests (stream_id, offset, length) with slice: the raw bytes from offset on, read from stored chunks (stream_id, chunk_id, raw_start, raw_end, comp).

    Only chunks that a request touches are inflated. Beyond the end the slice is short or empty.
    """
    last = F.floor((F.col("offset") + F.greatest(F.col("length") - 1, F.lit(0))) / chunk).cast("int")
    asked = requests.withColumn("_request", F.monotonically_increasing_id())
    wanted = asked.withColumn("chunk_id", F.explode(F.sequence(F.floor(F.col("offset") / chunk).cast("int"), last)))
    hit = wanted.join(store.select("stream_id", "chunk_id", "raw_start", "raw_end", "comp"), ["stream_id", "chunk_id"])
    raw = transform(F.col("comp"), container.inflate_chunk, "binary")
    first = F.greatest(F.col("offset") - F.col("raw_start"), F.lit(0))
    size = F.least(F.col("offset") + F.col("length"), F.col("raw_end")) - F.greatest(F.col("offset"), F.col("raw_start"))
    piece = F.substring(F.col("_raw"), (first + 1).cast("int"), F.greatest(size, F.lit(0)).cast("int"))
    pieces = hit.withColumn("_raw", raw).groupBy("_request").agg(F.sort_array(F.collect_list(F.struct("chunk_id", piece.alias("piece")))).alias("_pieces"))
    joined = F.aggregate(F.col("_pieces"), F.lit(b""), lambda all, x: F.concat(all, x["piece"]))
    return asked.join(pieces, "_request", "left").select(*requests.columns, F.coalesce(joined, F.lit(b"")).alias("slice"))


def assemble(chunks: DataFrame, index_size: int = 0) -> DataFrame:
    """stream_id and comp: chunks (chunk_id, raw_start, raw_end, comp) of each stream put together with indexes and footer.

    A stream's compressed chunks meet in one task, as they must in one cell; a cell can't hold more than 2 GB anyway.
    """
    rows = chunks.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("chunk_id", (F.col("raw_end") - F.col("raw_start")).alias("size"), "comp"))).alias("parts"))

    def build(column: pa.Array) -> pa.Array:
        out = []
        for parts in column.to_pylist():
            made = container.Writer(index_size)
            for p in parts:
                made.chunk(p["comp"], p["size"])
            out.append(made.close())
        return pa.array(out, pa.binary())

    return rows.select("stream_id", in_slices(build, "binary")(F.col("parts")).alias("comp"))


def stored_records(comp: Column) -> Column:
    """struct(records, err): the records of the indexes inside a whole stream."""
    kind = "struct<records:array<struct<comp_end:bigint,raw_end:bigint,type:int>>,err:string>"

    def read(data: bytes) -> dict:
        try:
            return {"records": [vars(r) for r in container.read_index(data)], "err": None}
        except CodecError as e:
            return {"records": [], "err": e.code}

    return transform(comp, read, kind)


def stored_index(streams: DataFrame, stream_id: str = "stream_id", comp: str = "comp") -> DataFrame:
    """Records of the indexes inside whole streams: stream_id, record, type, comp_start, comp_end, raw_start, raw_end; err where a stream has none."""
    found = streams.select(F.col(stream_id).alias("stream_id"), stored_records(F.col(comp)).alias("r"))
    before = lambda name: F.when(F.col("record") > 0, F.get(F.col("r.records"), F.col("record") - 1)[name]).otherwise(0)
    rows = found.select("stream_id", "r", F.posexplode_outer("r.records").alias("record", "x"))
    return rows.select("stream_id", "record", F.col("x.type").alias("type"), before("comp_end").alias("comp_start"), F.col("x.comp_end").alias("comp_end"), before("raw_end").alias("raw_start"), F.col("x.raw_end").alias("raw_end"), F.col("r.err").alias("err"))
