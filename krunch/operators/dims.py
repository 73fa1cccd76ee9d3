"""The formats' tables as small DataFrames, computed by rule. Sizes are fixed by the formats, so they may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import brotli_tables as T
from ..functions import deflate

_RANGES = {
    "deflate_length": (3, deflate.LENGTH_BITS[:28]),
    "deflate_distance": (1, deflate.DISTANCE_BITS[:30]),
    "brotli_insert": (0, T.INSERT_BITS),
    "brotli_copy": (2, T.COPY_BITS),
    "brotli_block": (1, T.BLOCK_BITS),
    "brotli_run": (2, T.RUN_BITS),
}


def make_ranges(bits: DataFrame, *by: str) -> DataFrame:
    """Adds base and end to rows with sym, bits and first: adjoining ranges of 2^bits values, in order of sym."""
    before = Window.partitionBy(*by).orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits"))
    base = F.col("first") + F.coalesce(F.sum(size).over(before), F.lit(0))
    return bits.withColumn("base", base).withColumn("end", F.col("base") + size)


def ranges(spark: SparkSession) -> DataFrame:
    """name, sym, bits, base, end of every range table."""
    rows = [(name, k, b, first) for name, (first, bits) in _RANGES.items() for k, b in enumerate(bits)]
    return make_ranges(spark.createDataFrame(rows, "name string, sym int, bits int, first long"), "name").drop("first")


def insert_copy(spark: SparkSession) -> DataFrame:
    """All 704 command symbols of Brotli with the bases and extra bits of both lengths."""
    row, low = F.shiftright("sym", 6), F.col("sym") % 64
    upper = F.lit([list(x) for x in ((0, 0), (0, 8), (0, 0), (0, 8), (8, 0), (8, 8), (0, 16), (16, 0), (8, 16), (16, 8), (16, 16))])
    found = spark.range(704).select(F.col("id").cast("int").alias("sym")).withColumn("u", F.get(upper, row))
    codes = found.select("sym", (F.col("u")[0] + F.shiftright(low, 3)).cast("int").alias("ins"), (F.col("u")[1] + low % 8).cast("int").alias("cpy"))
    table = ranges(spark)
    insert = table.where("name = 'brotli_insert'").select(F.col("sym").alias("ins"), F.col("base").alias("ins_base"), F.col("bits").alias("ins_bits"))
    copy = table.where("name = 'brotli_copy'").select(F.col("sym").alias("cpy"), F.col("base").alias("cpy_base"), F.col("bits").alias("cpy_bits"))
    return codes.join(F.broadcast(insert), "ins").join(F.broadcast(copy), "cpy").select("sym", "ins_base", "ins_bits", "cpy_base", "cpy_bits")


def distance_short(spark: SparkSession) -> DataFrame:
    """Brotli's sixteen short distance codes: which of the last distances, and what is added."""
    s = F.col("id")
    step = (F.floor((s - 4) % 6 / 2) + 1).cast("int")
    place = F.when(s < 4, s).otherwise(F.floor((s - 4) / 6)).cast("int")
    add = F.when(s < 4, 0).when(s % 2 == 1, step).otherwise(-step)
    return spark.range(16).select(s.cast("int").alias("sym"), place.alias("ring_index"), add.cast("int").alias("delta"))


def distance_long(spark: SparkSession) -> DataFrame:
    """Brotli's long distance codes for each postfix size, without direct codes: base and extra bits."""
    rows = spark.range(4).withColumnRenamed("id", "p").select(F.col("p").cast("int").alias("p"))
    k = F.col("k")
    exploded = rows.select("p", F.explode(F.sequence(F.lit(0), F.lit(48) * F.expr("shiftleft(1, p)") - 1)).alias("k"))
    bits = (1 + F.expr("shiftright(k, p + 1)")).cast("int")
    base = F.expr("shiftleft(cast(shiftleft(2 + (shiftright(k, p) & 1), 1 + shiftright(k, p + 1)) - 4 as bigint), p)") + F.expr("k & (shiftleft(1, p) - 1)") + 1
    return exploded.select(F.col("p").alias("npostfix"), k.alias("sym"), base.cast("long").alias("base"), bits.alias("bits"))


def static_codes(spark: SparkSession) -> DataFrame:
    """Brotli's fixed prefix codes for window bits, counts and run maxima: name, sym, len and value, first bit lowest."""
    rows = [("window_bits", 16, 1, 0), *(("window_bits", 17 + n, 4, n << 1 | 1) for n in range(1, 8)), ("window_bits", 17, 7, 1), *(("window_bits", 8 + n, 7, n << 4 | 1) for n in range(2, 8))]
    rows += [("counts", 1, 1, 0)] + [("counts", 1 + (1 << n) + j, n + 4, j << 4 | n << 1 | 1) for n in range(8) for j in range(1 << n)]
    rows += [("run_max", 0, 1, 0)] + [("run_max", n + 1, 5, n << 1 | 1) for n in range(16)]
    rows += [("code_length", s, n, v) for s, n, v in ((0, 2, 0), (3, 2, 2), (4, 2, 1), (2, 3, 3), (1, 4, 7), (5, 4, 15))]
    rows += [("selector", n, n + 1 if n < 6 else 6, (1 << n) - 1) for n in range(7)]
    return spark.createDataFrame(rows, "name string, sym int, len int, val int")


def literal_contexts(spark: SparkSession) -> DataFrame:
    """For each mode and byte, the parts of the literal context that it gives as last and as second byte; the context is their bitwise or."""
    rows = [(mode, b, T.literal_context(mode, b, 0) & ~second(mode, 0), second(mode, b)) for mode in range(4) for b in range(256)]
    return spark.createDataFrame(rows, "mode int, byte int, as_last int, as_second int")


def second(mode: int, b: int) -> int:
    return T.utf8_second(b) if mode == 2 else T.signed_group(b) if mode == 3 else 0


def transforms(spark: SparkSession) -> DataFrame:
    """Brotli's word transforms: id, prefix, operation, suffix."""
    rows = [(k, bytearray(p), op, bytearray(s)) for k, (p, op, s) in enumerate(T.TRANSFORMS)]
    return spark.createDataFrame(rows, "id int, prefix binary, op string, suffix binary")


def range_symbol(values: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """values with the sym of the range that holds the value; where ranges overlap, the last of them. A format's ranges are few
    and fixed, so they are part of the expression: no join, no shuffle, and each row comes back once."""
    spans = table.select("sym", "base", "end").orderBy(F.col("sym").desc()).collect()
    held = [F.when((F.col(value) >= r["base"]) & (F.col(value) < r["end"]), F.lit(r["sym"])) for r in spans]
    return values.withColumn("sym", F.coalesce(*held) if held else F.lit(None).cast("int"))
