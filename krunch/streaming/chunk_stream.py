"""Compression of streams as they arrive.

A micro-batch is cut in chunks and each is compressed by itself (what a full flush is to a writer), so batches need no
state between them. inflate_parts decodes streams that arrive in pieces, with the decoder's state kept by Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from ..functions import deflate
from ..functions.errors import CORRUPTED
from ..operators import chunks


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table, one file or a folder of them, as a stream of its files."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    reader = spark.readStream.schema(schema)
    if folder:
        return reader.parquet(path)
    return reader.option("pathGlobFilter", hadoop.getName()).parquet(str(hadoop.getParent()))


def store_stream(source: DataFrame, target: str, checkpoint: str, stream_id: str, data: str, chunk: int = chunks.CHUNK, packed: bool = True) -> None:
    """Runs over all that has arrived and appends its chunks to the Parquet table at target, exactly once."""
    planned = chunks.plan(source, chunk, stream_id, data)
    out = chunks.store(planned).drop("raw") if packed else planned.drop("raw")
    out.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).outputMode("append").start().awaitTermination()


class _Inflater(StatefulProcessor):
    """Keeps a stream's compressed bytes so far and how much of its output is already out: zlib's own state can't be stored.

    A stream that has ended or turned out to be faulty keeps no bytes, and what still comes of it gives no row.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("inflate", StructType([StructField("comp", BinaryType()), StructField("out", LongType()), StructField("over", BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        comp, out, over = self.state.get() if self.state.exists() else (b"", 0, False)
        parts = sorted((int(n), bytes(part)) for frame in rows for n, part in zip(frame["part"], frame["comp"], strict=True) if part is not None)
        if over:
            return
        comp = bytes(comp) + b"".join(part for _, part in parts)
        made, code = zlib.decompressobj(-15), None
        try:
            raw = made.decompress(comp)
        except zlib.error:
            raw, _, fault = deflate.inflate(comp)
            code = fault.code if fault else CORRUPTED
        over = made.eof or code is not None
        self.state.update((b"" if over else comp, len(raw), over))
        yield pd.DataFrame({"stream_id": [key[0]], "raw_start": [out], "raw": [raw[out:]], "done": [made.eof], "err": [code]})

    def close(self) -> None:
        pass


def inflate_parts(parts: DataFrame) -> DataFrame:
    """Raw DEFLATE streams that arrive as (stream_id, part, comp), parts in order from batch to batch -> what each batch adds to each
    stream. err is the class of the fault at which a stream stops; no fault fails the query."""
    return parts.groupBy("stream_id").transformWithStateInPandas(_Inflater(), "stream_id long, raw_start long, raw binary, done boolean, err string", "Append", "None")


def recent(events: DataFrame, time: str, delay: str, window: str) -> DataFrame:
    """Chunks of events by time: count and bytes of each window, late rows beyond the delay left to the watermark."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window)).agg(F.count("*").alias("events"), F.sum(F.octet_length("props")).alias("bytes"))
