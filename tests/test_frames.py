"""Operators on DataFrames, sources, sinks and streams."""

import bz2
import zlib

import pytest
from pyspark.sql import functions as F

from krunch.functions import container
from krunch.functions.errors import CodecError, is_corrupted, is_truncated
from krunch.operators import bench, chunks, dims, stages
from krunch.operators.codecs import codecs, decode, encode, register_sql, transform

ROWS = [(1, b"hello hello hello hello"), (2, b""), (3, None), (4, bytes(range(256)) * 40), (5, "äöü".encode())]


@pytest.fixture(scope="module")
def streams(spark):
    return spark.createDataFrame([(k, None if x is None else bytearray(x)) for k, x in ROWS], "stream_id long, data binary")


@pytest.mark.parametrize("name", sorted({c.format for c in codecs()}))
def test_round_trips(streams, name):
    found = streams.select("stream_id", encode(F.col("data"), name).alias("c")).select("stream_id", "c", decode(F.col("c"), name).alias("r")).collect()
    for row, (_, data) in zip(sorted(found), ROWS, strict=True):
        if data is None:
            assert row.r is None and row.c is None
        else:
            assert bytes(row.r.raw) == data and row.r.in_offset == len(row.c) and row.r.err is None


def test_faults_are_values(streams):
    bad = streams.where("stream_id = 1").select(decode(F.lit(b"\x07"), "deflate").alias("a"), decode(F.lit(b""), "bzip2").alias("b"), decode(F.lit(bz2.compress(b"x") + b"BZ"), "bzip2").alias("c"))
    row = bad.select(is_corrupted("a"), is_truncated("b"), is_truncated("c"), "c.raw").collect()[0]
    assert (row[0], row[1], row[2], bytes(row[3])) == (True, True, True, b"x")


def test_levels_and_makers(streams):
    with pytest.raises(CodecError):
        encode(F.col("data"), "bzip2", 10)
    with pytest.raises(CodecError):
        encode(F.col("data"), "brotli/strict")
    with pytest.raises(CodecError):
        decode(F.col("data"), "nothing")


def test_output_limit(streams):
    comp = zlib.compress(bytes(100_000))[2:-4]
    row = streams.limit(1).select(decode(F.lit(comp), "deflate", 1000).alias("r")).collect()[0].r
    assert row.err.code == "INVALID" and len(row.raw) <= 1000


def test_sql_functions(spark, streams):
    register_sql(spark)
    streams.createOrReplaceTempView("streams")
    row = spark.sql("SELECT deflate_decode(deflate_encode(data)).raw AS raw FROM streams WHERE stream_id = 1").collect()[0]
    assert bytes(row.raw) == ROWS[0][1]


def test_chunks_and_ranges(spark, streams):
    plan = chunks.plan(streams, 100)
    got = {(r.stream_id, r.chunk_id): bytes(r.raw) for r in plan.collect()}
    assert got[4, 3] == ROWS[3][1][300:400] and (2, 0) not in got and (3, 0) not in got and len(got[4, 102]) == 40
    store = chunks.store(plan)
    requests = spark.createDataFrame([(4, 95, 10), (4, 0, 0), (4, 99999, 5), (4, 10230, 100), (1, 3, 300), (9, 0, 5)], "stream_id long, offset long, length int")
    found = {(r.stream_id, r.offset): bytes(r.slice) for r in chunks.read_ranges(requests, store, 100).collect()}
    data = dict(ROWS)
    assert found == {(s, o): (data.get(s) or b"")[o : o + n] for s, o, n in ((4, 95, 10), (4, 0, 0), (4, 99999, 5), (4, 10230, 100), (1, 3, 300), (9, 0, 5))}


def test_assembled_streams(streams):
    made = chunks.assemble(chunks.store(chunks.plan(streams, 100)), 7)
    for r in made.collect():
        assert container.decompress(bytes(r.comp))[0] == dict(ROWS)[r.stream_id]
    index = chunks.stored_index(made).where("stream_id = 4 and type = 1").orderBy("record").collect()
    assert [r.raw_start for r in index] == list(range(0, 10240, 100)) and index[-1].raw_end == 10240


def test_index_of_garbage(spark):
    rows = chunks.stored_index(spark.createDataFrame([(1, bytearray(b"garbage"))], "stream_id long, comp binary")).collect()
    assert len(rows) == 1 and rows[0].err == "CORRUPTED" and rows[0].record is None


def test_symbols(streams):
    counts = stages.histogram(streams, "stream_id", "data")
    codes = stages.code_lengths(counts)
    cost = {r.stream_id: r for r in stages.code_cost(codes).collect()}
    assert set(cost) == {1, 4, 5} and all(r.kraft for r in cost.values()) and cost[4].bits == 8 * 256 * 40
    values = stages.canonical(codes.select(F.col("stream_id").alias("table_id"), "sym", "len"))
    assert [r.conflicts for r in stages.prefix_conflicts(values).collect()] == [0, 0, 0]


def test_conflicts_are_found(spark):
    rows = spark.createDataFrame([(1, 0, 1, 0), (1, 1, 2, 0), (1, 2, 2, 1)], "table_id long, sym int, len int, val long")
    assert stages.prefix_conflicts(rows).collect()[0].conflicts == 1


def test_range_symbols(spark):
    table = dims.ranges(spark).where("name = 'brotli_copy'")
    values = spark.createDataFrame([(2,), (9,), (10,), (2117,), (1,)], "v long")
    assert {r.v: r.sym for r in dims.range_symbol(values, table, "v").collect()} == {2: 0, 9: 7, 10: 8, 2117: 22, 1: None}


def test_word_transforms_of_any_bytes(spark):
    words = spark.createDataFrame([("éa",), ("漢字",), ("a",)], "w string")
    from krunch.functions.brotli_tables import transform as one

    for r in stages.word_transforms(words, "w", dims.transforms(spark)).collect():
        assert bytes(r.result) == one(r.word.encode(), r.id)


def test_resize(streams):
    out = {r.stream_id: r.x for r in streams.select("stream_id", stages.resize(F.col("data"), 30).alias("x")).collect()}
    assert bytes(out[4]) == ROWS[3][1][:30] and bytes(out[2]) == b"" and out[3] is None
    data = ROWS[0][1]
    assert bytes(out[1]) == data + bytes(b ^ 1 for b in data[:7])


def test_cross_check(streams):
    assert all(r.ok for r in bench.cross_check(streams.where("stream_id < 4"), "stream_id", "data").collect())


def test_bench(spark):
    files = spark.createDataFrame([("f", bytearray(b"some text " * 50))], "file string, data binary")
    found = bench.with_delta(bench.run(files, (1, 9), (200, 1000)), "ratio", "file", "level", "size").collect()
    assert all(r.ok for r in found) and len(found) == 4 * len([c for c in codecs() if c.encode])
    assert all(r.delta == 1 for r in found if r.codec == "brotli/c")
    assert set(bench.shapes(5000)) == {"zeros.bin", "random.bin", "repeats.bin", "huffman.txt"} and all(len(v) == 5000 for v in bench.shapes(5000).values())


def test_raw_streams(spark, tmp_path):
    from krunch.sources.chunked import as_text, raw_streams

    for k in range(3):
        made = zlib.compressobj(6, zlib.DEFLATED, -15)
        (tmp_path / f"{k}.fl").write_bytes(made.compress(f"text {k}".encode()) + made.flush())
    got = raw_streams(spark, str(tmp_path), "deflate", "*.fl").select(as_text(F.col("result")).alias("t")).collect()
    assert sorted(r.t for r in got) == ["text 0", "text 1", "text 2"]


def test_data_source(spark, tmp_path):
    from krunch.sources import chunked

    chunked.register(spark)
    data = [bytes([k]) * 1000 for k in range(20)]
    frame = spark.createDataFrame([(bytearray(x),) for x in data], "data binary").coalesce(1)
    frame.write.format("chunked_deflate").option("chunkSize", 1500).option("indexSize", 4).mode("append").save(str(tmp_path / "out"))
    rows = spark.read.format("chunked_deflate").load(str(tmp_path / "out"))
    assert b"".join(bytes(r.raw) for r in rows.orderBy("chunk_id").collect()) == b"".join(data)
    some = rows.where("raw_start >= 3000 and raw_end <= 6000")
    assert [r.chunk_id for r in some.orderBy("chunk_id").collect()] == [2, 3]
    pruned = chunked.ChunkedReader(str(tmp_path / "out"))
    from pyspark.sql.datasource import EqualTo

    assert list(pruned.pushFilters([EqualTo(("chunk_id",), 5)])) == []
    assert [b.num_rows for p in pruned.partitions() for b in pruned.read(p)] == [1]
    split = chunked.ChunkedReader("file://" + str(tmp_path / "out"), 40)
    found = [r for p in split.partitions() for b in split.read(p) for r in b.to_pylist()]
    assert len(split.partitions()) > 3 and [r["chunk_id"] for r in found] == list(range(14)) and b"".join(r["raw"] for r in found) == b"".join(data)


def test_opening_reads_little():
    """At most a hundredth of the raw size to open, and a chunk at each end of what is sought."""
    import random

    data = random.Random(5).randbytes(1 << 20)
    comp, asked = container.pack(data, 1 << 13, 16), []

    def read(start, end):
        asked.append(end - start)
        return comp[start:end]

    records = container.open_index(read, len(comp))
    assert records == container.read_index(comp) and sum(asked) <= len(data) // 100
    k = container.search(records, 500_000)
    before, here = container.around(records, k)
    assert container.inflate_chunk(comp[before.comp_end : here.comp_end]) == data[before.raw_end : here.raw_end]


def test_gzip_member_is_readable(spark, tmp_path):
    """A container inside a gzip member is read by Spark's own text reader."""
    text = b"line one\nline two\n" * 40
    body = container.pack(text, 64)
    member = b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + zlib.crc32(text).to_bytes(4, "little") + len(text).to_bytes(4, "little")
    (tmp_path / "x.gz").write_bytes(member)
    assert spark.read.text(str(tmp_path / "x.gz")).count() == 80


def test_stateful_inflate(spark, tmp_path):
    from krunch.streaming.chunk_stream import inflate_parts

    made = zlib.compressobj(6, zlib.DEFLATED, -15)
    comp = made.compress(b"a stream in three parts, of which the last comes later") + made.flush()
    schema = "stream_id long, part int, comp binary"
    source = tmp_path / "in"
    for k, part in enumerate((comp[:10], comp[10:20], comp[20:])):
        spark.createDataFrame([(1, k, bytearray(part))], schema).coalesce(1).write.mode("append").parquet(str(source))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = inflate_parts(stream).writeStream.format("memory").queryName("inflated").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.sql("SELECT * FROM inflated").collect()
    assert b"".join(bytes(r.raw) for r in sorted(rows, key=lambda r: r.raw_start)) == b"a stream in three parts, of which the last comes later"
    assert len(rows) == 3 and any(r.done for r in rows) and not any(r.err for r in rows)


def test_faults_in_streams_are_values():
    """A faulty stream gives what came before the fault, once; nothing is kept of it or of one that has ended."""
    import pandas as pd

    from krunch.streaming.chunk_stream import _Inflater

    class Held:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    stored = b"\0\3\0\xfc\xffabc"
    for tail, code in ((b"\x06", "CORRUPTED"), (b"\x03\0", None)):
        made = _Inflater()
        made.state = Held()
        give = lambda k, part: [tuple(r) for f in made.handleInputRows((1,), iter([pd.DataFrame({"part": [k], "comp": [part]})]), None) for r in f.itertuples(index=False)]
        assert give(0, stored) == [(1, 0, b"abc", False, None)]
        assert give(1, tail) == [(1, 3, b"", code is None, code)]
        assert made.state.value == (b"", 3, True) and give(2, b"more") == []


def test_plans(spark, streams):
    """What matters in a plan: pruned columns, one exchange for an index, no cartesian product for a search."""
    text = chunks.index(chunks.store(chunks.plan(streams)), F.octet_length("comp"), F.octet_length("raw"))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    found = chunks.search(spark.createDataFrame([(1, 5)], "stream_id long, offset long"), chunks.plan(streams, keep_bytes=False))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_transform_keeps_nulls(streams):
    rows = streams.select("stream_id", transform(F.col("data"), len, "int").alias("n")).orderBy("stream_id").collect()
    assert [r.n for r in rows] == [23, 0, None, 10240, 6]


def test_damage(streams):
    from krunch.operators import faults

    made = streams.where("stream_id in (1, 4)").withColumn("c", encode(F.col("data"), "deflate"))
    row = made.select(
        decode(faults.truncate(F.col("c"), F.octet_length("c") - 1), "deflate").alias("cut"),
        decode(faults.trailing(F.col("c"), b"zz"), "deflate").alias("more"),
        F.octet_length("c").alias("n"),
        faults.first_difference(F.col("c"), faults.flip(F.col("c"))).alias("at"),
        faults.first_difference(F.col("c"), F.col("c")).alias("none"),
    ).collect()[0]
    assert row.cut.err.code == "UNEXPECTED_EOF" and row.more.in_offset == row.n and row.at == 7919 % (8 * row.n) // 8 and row.none is None


def test_range_symbol_keeps_equal_rows(spark):
    from krunch.operators import dims

    table = dims.ranges(spark).where("name = 'deflate_length'")
    rows = spark.createDataFrame([(3,), (3,), (10,), (None,), (99999,)], "v long")
    assert sorted((r.v or 0, r.sym) for r in dims.range_symbol(rows, table, "v").collect() if r.sym is not None) == [(3, 0), (3, 0), (10, 7)]
    text = dims.range_symbol(rows, table, "v")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text


def test_zstd_bomb_is_held():
    import zstandard

    from krunch.operators import codecs

    data = zstandard.ZstdCompressor().compress(bytes(64 << 20))
    out, used, fault = codecs.codec("zstd").decode(data, 1000)
    assert out == bytes(1000) and fault.code == "INVALID" and used <= len(data)
    good = zstandard.ZstdCompressor().compress(b"abc" * 5000)
    assert codecs.codec("zstd").decode(good + b"rest", 1 << 20) == (b"abc" * 5000, len(good), None)
    assert codecs.codec("zstd").decode(good[:-3], 1 << 20)[2].code == "UNEXPECTED_EOF"
