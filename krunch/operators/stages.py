"""The stages of compression as DataFrame operations.

What is sequential inside a row (run lengths, sorting rotations, lists that move) is a function over batches of rows; what
counts or orders symbols is an aggregate or a window.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bzip2, huffman, meta
from ..functions.checksums import crc32_msb
from ..functions.errors import CodecError
from .codecs import in_slices, transform


def histogram(streams: DataFrame, stream_id: str, data: str) -> DataFrame:
    """stream_id, sym, cnt for every byte that occurs. Counted inside a row's batch, so a row makes 256 rows at most."""
    schema = pa.schema([("stream_id", pa.int64()), ("sym", pa.int32()), ("cnt", pa.int64())])

    def run(batches):
        for b in batches:
            ids, data = b.column(0).to_pylist(), b.column(1).to_pylist()
            owners, symbols, counts = [], [], []
            for k, x in zip(ids, data, strict=True):
                if x:
                    found = np.bincount(np.frombuffer(x, np.uint8), minlength=256)
                    used = np.flatnonzero(found)
                    owners += [k] * len(used)
                    symbols.append(used)
                    counts.append(found[used])
            if owners:
                yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(np.concatenate(symbols).astype(np.int32)), pa.array(np.concatenate(counts))], schema=schema)

    return streams.select(F.col(stream_id).cast("long"), F.col(data).cast("binary")).mapInArrow(run, "stream_id long, sym int, cnt long")


def entropy(counts: DataFrame) -> DataFrame:
    """stream_id, n, used, bits: the information of each stream's bytes, which no code of single bytes can beat."""
    return _shares(counts).groupBy("stream_id").agg(F.sum("cnt").alias("n"), F.count("*").alias("used"), F.sum("part").alias("bits"))


def _shares(counts: DataFrame) -> DataFrame:
    """Adds part: the information of all of a symbol's bytes."""
    total = F.sum("cnt").over(Window.partitionBy("stream_id"))
    return counts.withColumn("total", total).withColumn("part", -F.col("cnt") * F.log2(F.col("cnt") / F.col("total")))


def rle1(data: Column) -> Column:
    return transform(data, lambda x: bzip2.rle1_encode(x)[0], "binary")


def rle1_inverse(data: Column) -> Column:
    def run(x: bytes) -> dict:
        raw, fault = bzip2.rle1_decode(x)
        return {"raw": raw, "err": fault.code if fault else None}

    return transform(data, run, "struct<raw:binary,err:string>")


def rle1_stats(data: Column) -> Column:
    """struct(runs, size): number of runs of equal bytes and their size after the first run-length stage."""

    def run(x: bytes) -> dict:
        values = np.frombuffer(x, np.uint8)
        if not len(values):
            return {"runs": 0, "size": 0}
        edges = np.flatnonzero(np.diff(values)) + 1
        n = np.diff(np.concatenate([[0], edges, [len(values)]]))
        rest = n % 255
        return {"runs": len(n), "size": int((5 * (n // 255) + np.where(rest < 4, rest, 5)).sum())}

    return transform(data, run, "struct<runs:bigint,size:bigint>")


def bwt(data: Column) -> Column:
    """struct(bwt, ptr)."""
    return transform(data, lambda x: dict(zip(("bwt", "ptr"), bzip2.bwt_encode(x), strict=True)), "struct<bwt:binary,ptr:int>")


def bwt_inverse(found: Column) -> Column:
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else bzip2.bwt_decode(x["bwt"], x["ptr"]) for x in column.to_pylist()], pa.binary())

    return in_slices(run, "binary")(found)


def mtf(data: Column) -> Column:
    """Places in a list of all bytes that moves to the front."""
    return transform(data, bzip2.move_to_front, "binary")


def mtf_rle2(data: Column) -> Column:
    """Symbols of the second stage of bzip2."""
    return transform(data, bzip2.mtf_rle2_encode, "array<int>")


def crc_msb(data: Column) -> Column:
    return transform(data, crc32_msb, "bigint")


def fold_crcs(blocks: DataFrame, order: str, crc: str) -> DataFrame:
    """stream_id and crc of a stream, from those of its blocks in order."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(crc).cast("long").alias("c"))))
    mask = F.lit(0xFFFFFFFF).cast("long")
    step = lambda total, x: F.shiftleft(total, 1).bitwiseOR(F.shiftright(total, 31)).bitwiseAND(mask).bitwiseXOR(x["c"])
    return blocks.groupBy("stream_id").agg(F.aggregate(ordered, F.lit(0).cast("long"), step).alias("stream_crc"))


def code_lengths(counts: DataFrame, limit: int = 15) -> DataFrame:
    """counts (stream_id, sym, cnt) with len: optimal lengths of at most limit bits. A stream's symbols are 256 at most.

    Streams are sorted into partitions, not grouped: a task of its own for each, however short, would cost more than its code.
    """
    schema = pa.schema([("stream_id", pa.int64()), ("sym", pa.int32()), ("cnt", pa.int64()), ("len", pa.int32())])

    def coded(rows: pa.Table) -> pa.RecordBatch:
        """Rows of whole streams, in order."""
        ids, found = rows["stream_id"].to_pylist(), rows["cnt"].to_pylist()
        lengths = [n for _, group in groupby(range(len(ids)), ids.__getitem__) for at in (list(group),) for n in huffman.code_lengths(found[at[0] : at[-1] + 1], limit)]
        columns = [*(rows[name].combine_chunks() for name in schema.names[:3]), pa.array(lengths, pa.int32())]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) for c in columns], schema=schema)

    def run(batches):
        held = schema.remove(3).empty_table()  # of a stream that may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.concat_tables([held, pa.Table.from_batches([b]).cast(schema.remove(3))])
            ids = rows["stream_id"].to_pylist()
            whole = len(ids)
            while whole and ids[whole - 1] == ids[-1]:
                whole -= 1
            if whole:
                yield coded(rows.slice(0, whole))
            held = rows.slice(whole)
        if held.num_rows:
            yield coded(held)

    dealt = counts.select("stream_id", "sym", "cnt").repartition("stream_id").sortWithinPartitions("stream_id", "sym")
    return dealt.mapInArrow(run, "stream_id long, sym int, cnt long, len int")


def code_cost(codes: DataFrame) -> DataFrame:
    """stream_id, bits, used, kraft: the coded size, and whether the lengths fill the code space exactly (a lone symbol needs none); with n and least, the entropy."""
    space = F.sum(F.expr("shiftleft(cast(1 as bigint), 27 - len)"))
    whole = (space == (1 << 27)) | ((F.count("*") == 1) & (F.max("len") == 0))
    return _shares(codes).groupBy("stream_id").agg(F.sum(F.col("len") * F.col("cnt")).alias("bits"), F.count("*").alias("used"), whole.alias("kraft"), F.sum("cnt").alias("n"), F.sum("part").alias("least"))


def canonical(codes: DataFrame) -> DataFrame:
    """Adds val to (table_id, sym, len): canonical code values, first bit lowest. One running sum of code space for each table."""
    before = Window.partitionBy("table_id").orderBy("len", "sym").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.expr("shiftleft(cast(1 as bigint), 27 - len)")).over(before), F.lit(0))
    forward = codes.withColumn("_f", used)
    value = F.expr("shiftright(_f, 27 - len)")
    return forward.withColumn("val", F.conv(F.reverse(F.lpad(F.bin(value), F.col("len"), "0")), 2, 10).cast("long")).drop("_f")


def prefix_conflicts(codes: DataFrame) -> DataFrame:
    """table_id and the number of pairs of codes of which one begins the other, from (table_id, sym, len, val).

    In forward bits a code is an interval of code space, and sorted intervals conflict if one begins before the largest end so far.
    """
    forward = F.conv(F.reverse(F.lpad(F.bin("val"), F.col("len"), "0")), 2, 10).cast("long")
    spans = codes.withColumn("_a", F.call_function("shiftleft", forward, 27 - F.col("len"))).withColumn("_z", F.col("_a") + F.expr("shiftleft(cast(1 as bigint), 27 - len)"))
    before = Window.partitionBy("table_id").orderBy("_a", "_z", "sym").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_bad", (F.max("_z").over(before) > F.col("_a")).cast("int")).groupBy("table_id").agg(F.coalesce(F.sum("_bad"), F.lit(0)).alias("conflicts"))


def magic_search(data: Column) -> Column:
    """The last place where a meta block might begin, -1 if none."""

    def run(x: bytes) -> int:
        raw = np.frombuffer(x, np.uint8).astype(np.uint32)
        if len(raw) < 4:
            return meta.reverse_search(x)
        words = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
        hits = np.flatnonzero(words & meta.MASK == meta.MAGIC)
        return int(hits[-1]) if len(hits) else -1

    return transform(data, run, "int")


def meta_encode(data: Column, final: str = meta.META) -> Column:
    return transform(data, lambda x: meta.encode(x, final), "binary")


def meta_decode(data: Column) -> Column:
    """struct(raw, final, in_offset, err)."""

    def run(x: bytes) -> dict:
        try:
            raw, final, end = meta.decode(x)
            return {"raw": raw, "final": final, "in_offset": end, "err": None}
        except CodecError as e:
            return {"raw": b"", "final": None, "in_offset": 0, "err": e.code}

    return transform(data, run, "struct<raw:binary,final:string,in_offset:bigint,err:string>")


def literal_context_counts(streams: DataFrame, data: str) -> DataFrame:
    """mode, context, n over all bytes of all streams, the first two bytes following zeros. A task sends 256 rows."""
    from ..functions import brotli_tables as T

    last = np.array([[T.literal_context(m, b, 0) for b in range(256)] for m in range(4)])
    second = np.array([[T.utf8_second(b) if m == 2 else T.signed_group(b) if m == 3 else 0 for b in range(256)] for m in range(4)])
    schema = pa.schema([("mode", pa.int32()), ("context", pa.int32()), ("n", pa.int64())])

    def run(batches):
        sums = np.zeros((4, 64), np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                if x:
                    raw = np.frombuffer(b"\0\0" + x[:-1], np.uint8)
                    for m in range(4):
                        sums[m] += np.bincount(last[m][raw[1:]] | second[m][raw[:-1]], minlength=64)
        mode, context = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(mode.astype(np.int32)), pa.array(context.astype(np.int32)), pa.array(sums[mode, context])], schema=schema)

    return streams.select(F.col(data).cast("binary")).mapInArrow(run, "mode int, context int, n long").groupBy("mode", "context").agg(F.sum("n").alias("n"))


def word_transforms(words: DataFrame, word: str, table: DataFrame) -> DataFrame:
    """Every word with every word transform: id, word, result. The table has 121 rows, whatever the words."""
    pairs = words.crossJoin(F.broadcast(table))
    text, op = F.col(word).cast("binary"), F.col("op")
    n = F.octet_length(text)
    cut = F.expr("try_cast(substring(op, 2) as int)")
    upper = transform_upper(text, op)
    body = F.when(op == "id", text).when(op.isin("first", "all"), upper)
    body = body.when(op.startswith("+"), F.when(n > cut, F.substring(text, cut + 1, n)).otherwise(F.lit(b"")))
    body = body.otherwise(F.when(n > cut, F.substring(text, F.lit(1), n - cut)).otherwise(F.lit(b"")))
    return pairs.select("id", F.col(word).alias("word"), F.concat(F.col("prefix"), body, F.col("suffix")).alias("result"))


def transform_upper(text: Column, op: Column) -> Column:
    """The format's bytewise upper-casing: of ASCII words by expression, of others by function."""
    from ..functions import brotli_tables as T

    @F.arrow_udf("binary")
    def other(words: pa.Array, ops: pa.Array) -> pa.Array:
        return pa.array([None if w is None else T.upper(w, o == "first") for w, o in zip(words.to_pylist(), ops.to_pylist(), strict=True)], pa.binary())

    return other(text, op)


def resize(data: Column, size: int) -> Column:
    """Cut to size, or repeated up to it, each repeat with its number as a mask."""

    def run(x: bytes) -> bytes:
        if len(x) >= size or not x:
            return x[:size]
        turns = -(-size // len(x))
        raw = np.tile(np.frombuffer(x, np.uint8), (turns, 1)) ^ (np.arange(turns) % 256).astype(np.uint8)[:, None]
        return raw.reshape(-1)[:size].tobytes()

    return transform(data, run, "binary")
