"""Every query of the library by name, with the SQL that must give the same rows where SQL can say it.

Queries run over whole tables and whole texts. Where SQL would take a text apart byte by byte, the query itself does it in
batches; the SQL is the check. Floats are rounded in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, brotli_tables, container
from ..functions.bitstream import BitWriter
from ..functions.errors import is_corrupted, is_deprecated, is_truncated
from ..operators import bench, chunks, dims, stages
from ..operators.codecs import codec, decode, encode, transform

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_streams(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    """stream_id and data: the UTF-8 bytes of a text column; null is empty."""
    return table(spark, sf_dir, name).select(F.col(key).alias("stream_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("data"))


def dealt(streams: DataFrame, size: int = 16 << 20) -> DataFrame:
    """The streams dealt over all cores, in parts of about size bytes: files of few row groups would keep a few tasks busy."""
    cores = streams.sparkSession.sparkContext.defaultParallelism
    found = int(str(streams._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return streams.repartition(max(2 * cores, min(1 << 14, -(-found // size))))


# Streams and bytes in SQL: b has the bytes of each stream as a list of hex pairs.
_DOCS = "d AS (SELECT doc_id AS stream_id, encode(coalesce(text, '')) AS data FROM documents), s AS (SELECT stream_id, data, octet_length(data) AS n FROM d)"


def _bytes(source: str, key: str, text: str) -> str:
    """CTEs: l (stream_id, h: hex pairs) and b (stream_id, i, v: byte values)."""
    return f"""l AS (SELECT {key} AS stream_id, regexp_extract_all(hex(encode(coalesce({text}, ''))), '..') AS h FROM {source}),
b AS (SELECT stream_id, i, CAST('0x' || h[i + 1] AS INT) AS v FROM (SELECT stream_id, h, unnest(range(len(h))) AS i FROM l))"""


_DOC_BYTES, _NAME_BYTES = _bytes("documents", "doc_id", "text"), _bytes("customer", "c_custkey", "c_name")

# --- tables of the formats


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_RANGE_SQL = f"""SELECT name, sym, bits, CAST(first + coalesce(sum(CAST(1 AS BIGINT) << bits) OVER (PARTITION BY name ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base
FROM (VALUES {_values((name, k, b, first) for name, (first, found) in dims._RANGES.items() for k, b in enumerate(found))}) t(name, sym, bits, first)"""


@query(f'SELECT name, sym, bits, base, base + (CAST(1 AS BIGINT) << bits) AS "end" FROM ({_RANGE_SQL})')
def range_tables(spark, sf_dir):
    return dims.ranges(spark)


@query(f"""WITH r AS ({_RANGE_SQL}), u AS (SELECT sym, CAST(sym // 64 AS INT) AS row, CAST(sym % 64 AS INT) AS low FROM range(704) t(sym)),
c AS (SELECT sym, [0, 0, 0, 0, 8, 8, 0, 16, 8, 16, 16][row + 1] + (low >> 3) AS ins, [0, 8, 0, 8, 0, 8, 16, 0, 16, 8, 16][row + 1] + low % 8 AS cpy FROM u)
SELECT c.sym, i.base AS ins_base, i.bits AS ins_bits, k.base AS cpy_base, k.bits AS cpy_bits FROM c JOIN r i ON i.name = 'brotli_insert' AND i.sym = c.ins JOIN r k ON k.name = 'brotli_copy' AND k.sym = c.cpy""")
def iac_table(spark, sf_dir):
    return dims.insert_copy(spark)


@query("""SELECT sym, CASE WHEN sym < 4 THEN sym WHEN sym < 10 THEN 0 ELSE 1 END AS ring_index,
CASE WHEN sym < 4 THEN 0 ELSE (CASE WHEN sym < 10 THEN sym // 2 - 1 ELSE sym // 2 - 4 END) * (CASE WHEN sym % 2 = 0 THEN -1 ELSE 1 END) END AS delta FROM range(16) t(sym)""")
def dist_short(spark, sf_dir):
    return dims.distance_short(spark)


@query("""WITH t AS (SELECT CAST(p AS INT) AS p, CAST(unnest(range(48 << CAST(p AS INT))) AS INT) AS k FROM range(4) x(p)),
u AS (SELECT p, k, 1 + (k >> (p + 1)) AS bits, k >> p AS h, k % (1 << p) AS low FROM t)
SELECT p AS npostfix, k AS sym, (((CAST(2 + h % 2 AS BIGINT) << bits) - 4) << p) + low + 1 AS base, bits FROM u""")
def dist_long(spark, sf_dir):
    return dims.distance_long(spark)


@query("""SELECT 'counts' AS name, 1 + (1 << n) + j AS sym, n + 4 AS len, (j << 4) + (n << 1) + 1 AS val FROM (SELECT CAST(n AS INT) AS n, CAST(unnest(range(1 << CAST(n AS INT))) AS INT) AS j FROM range(8) t(n))
UNION ALL SELECT 'counts', 1, 1, 0 UNION ALL SELECT 'run_max', 0, 1, 0 UNION ALL SELECT 'run_max', n + 1, 5, 2 * n + 1 FROM range(16) t(n)
UNION ALL SELECT 'window_bits', 16, 1, 0 UNION ALL SELECT 'window_bits', 17 + n, 4, 2 * n + 1 FROM range(1, 8) t(n) UNION ALL SELECT 'window_bits', 17, 7, 1 UNION ALL SELECT 'window_bits', 8 + n, 7, 16 * n + 1 FROM range(2, 8) t(n)
UNION ALL SELECT * FROM (VALUES ('code_length', 0, 2, 0), ('code_length', 3, 2, 2), ('code_length', 4, 2, 1), ('code_length', 2, 3, 3), ('code_length', 1, 4, 7), ('code_length', 5, 4, 15))
UNION ALL SELECT 'selector', n, least(n + 1, 6), (1 << CAST(n AS INT)) - 1 FROM range(7) t(n)""")
def static_codes(spark, sf_dir):
    return dims.static_codes(spark)


# --- chunks and their index


@query(f"WITH {_DOCS} SELECT stream_id, CAST(c AS INT) AS chunk_id, c * 4096 AS raw_start, least(c * 4096 + 4096, n) AS raw_end FROM (SELECT stream_id, n, unnest(range((n + 4095) // 4096)) AS c FROM s)")
def chunk_plan(spark, sf_dir):
    return chunks.plan(text_streams(spark, sf_dir), keep_bytes=False)


_CHUNK_SQL = f"{_DOCS}, c AS (SELECT stream_id, c AS chunk_id, c * 4096 AS raw_start, least(c * 4096 + 4096, n) AS raw_end FROM (SELECT stream_id, n, unnest(range((n + 4095) // 4096)) AS c FROM s))"


@query(f"WITH {_CHUNK_SQL} SELECT stream_id, CAST(chunk_id AS INT) AS chunk_id, raw_start, CAST(sum(raw_end - raw_start) OVER (PARTITION BY stream_id ORDER BY chunk_id) AS BIGINT) AS raw_end, true AS comp_grows FROM c")
def chunk_index(spark, sf_dir):
    made = chunks.store(chunks.plan(text_streams(spark, sf_dir)))
    found = chunks.index(made, F.octet_length("comp"), F.col("raw_end") - F.col("raw_start"))
    grows = chunks.with_starts(found.select("stream_id", "chunk_id", "raw_end", "comp_end"), "raw_end", "comp_end")
    return grows.select("stream_id", "chunk_id", "raw_start", "raw_end", (F.col("comp_end") > F.col("comp_start")).alias("comp_grows"))


@query("""WITH t AS (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS n FROM conversations),
c AS (SELECT conv_id, turn, i, least(n - i * 256, 256) AS size FROM (SELECT conv_id, turn, n, unnest(range((n + 255) // 256)) AS i FROM t))
SELECT conv_id AS stream_id, turn, CAST(i AS INT) AS chunk_id, row_number() OVER w - 1 AS record, CAST(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS raw_end FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, i)""")
def index_merge(spark, sf_dir):
    """Each turn of a conversation is a fragment with its own index; the conversation is the stream."""
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("stream_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    parts = chunks.plan(turns, 256, keep_bytes=False).select(F.col("stream_id.conv_id").alias("stream_id"), F.col("stream_id.turn").alias("turn"), "chunk_id", "raw_end", F.col("raw_end").alias("comp_end"))
    return chunks.merge(parts, "turn").select("stream_id", "turn", "chunk_id", "record", "raw_end")


@query(f"WITH {_CHUNK_SQL}, r AS (SELECT stream_id, CASE WHEN n = 0 THEN 0 ELSE (stream_id * 7919) % n END AS o FROM s) SELECT r.stream_id, r.o AS \"offset\", CAST(c.chunk_id AS INT) AS chunk_id, c.raw_start, c.raw_end FROM r ASOF LEFT JOIN c ON r.stream_id = c.stream_id AND r.o >= c.raw_start")
def index_search(spark, sf_dir):
    streams = text_streams(spark, sf_dir)
    n = F.octet_length("data")
    requests = streams.select("stream_id", F.when(n == 0, 0).otherwise(F.pmod(F.col("stream_id") * 7919, n)).cast("long").alias("offset"))
    found = chunks.search(requests, chunks.plan(streams, keep_bytes=False))
    return found.select("stream_id", "offset", F.when(F.col("raw_start").isNotNull(), F.col("chunk_id")).alias("chunk_id"), "raw_start", "raw_end")


@query(f"WITH {_DOCS} SELECT stream_id, (n + 4095) // 4096 AS n_chunks, n AS raw_size, true AS ok FROM s WHERE n > 0")
def index_totals(spark, sf_dir):
    made = chunks.store(chunks.plan(text_streams(spark, sf_dir)))
    found = chunks.totals(chunks.index(made, F.octet_length("comp"), F.col("raw_end") - F.col("raw_start")))
    return found.select("stream_id", "n_chunks", "raw_size", (F.col("comp_size") > 4 * F.col("n_chunks")).alias("ok"))


@query(f"WITH {_CHUNK_SQL} SELECT stream_id, CAST(chunk_id // 3 AS INT) AS index_id, count(*) AS records, min(raw_start) AS raw_start, max(raw_end) AS raw_end FROM c GROUP BY stream_id, chunk_id // 3")
def index_flush(spark, sf_dir):
    return chunks.flushed_indexes(chunks.plan(text_streams(spark, sf_dir), keep_bytes=False), 3)


@query(f"WITH {_DOCS} SELECT stream_id, (stream_id * 7919) % n AS \"offset\", 100 AS length, substring(hex(data), CAST(2 * ((stream_id * 7919) % n) + 1 AS BIGINT), 200) AS slice FROM s WHERE n > 0")
def range_read(spark, sf_dir):
    streams = text_streams(spark, sf_dir).where(F.octet_length("data") > 0)
    store = chunks.store(chunks.plan(streams))
    requests = streams.select("stream_id", F.pmod(F.col("stream_id") * 7919, F.octet_length("data")).cast("long").alias("offset"), F.lit(100).alias("length"))
    return chunks.read_ranges(requests, store).withColumn("slice", F.hex("slice"))


# --- codecs


def _round_trip(spark, sf_dir, name, level=0):
    streams = dealt(text_streams(spark, sf_dir)).withColumn("comp", encode(F.col("data"), name, level))
    found = streams.withColumn("r", decode(F.col("comp"), name))
    return found.select("stream_id", F.md5("r.raw").alias("raw_md5"), F.col("r.out_offset").alias("n"), (F.col("r.in_offset") == F.octet_length("comp")).alias("all_read"), F.col("r.err.code").alias("err"))


_ROUND_SQL = f"WITH {_DOCS} SELECT stream_id, md5(data) AS raw_md5, n, true AS all_read, CAST(NULL AS VARCHAR) AS err FROM s"


@query(_ROUND_SQL)
def roundtrip_deflate(spark, sf_dir):
    return _round_trip(spark, sf_dir, "deflate")


@query(_ROUND_SQL)
def roundtrip_bzip2(spark, sf_dir):
    return _round_trip(spark, sf_dir, "bzip2", 9)


@query(_ROUND_SQL)
def roundtrip_bzip2_strict(spark, sf_dir):
    """The stages' own encoder, read by the library."""
    streams = dealt(text_streams(spark, sf_dir)).withColumn("comp", encode(F.col("data"), "bzip2/strict", 1))
    found = streams.withColumn("r", decode(F.col("comp"), "bzip2/c"))
    return found.select("stream_id", F.md5("r.raw").alias("raw_md5"), F.col("r.out_offset").alias("n"), (F.col("r.in_offset") == F.octet_length("comp")).alias("all_read"), F.col("r.err.code").alias("err"))


def _stored(data: bytes) -> bytes:
    """DEFLATE of stored blocks, the last of them empty."""
    parts = [data[at : at + 0xFFFF] for at in range(0, len(data), 0xFFFF)]
    return b"".join(b"\0" + len(p).to_bytes(2, "little") + (len(p) ^ 0xFFFF).to_bytes(2, "little") + p for p in parts) + container.END_BLOCK


def _uncompressed(data: bytes) -> bytes:
    """Brotli of uncompressed meta-blocks, a metadata block of five bytes before each."""
    bits = BitWriter()
    bits.write(0, 1)  # a window of 16 bits
    for at in range(0, len(data), 1 << 16):
        part = data[at : at + (1 << 16)]
        for value, n in ((0, 1), (3, 2), (0, 1), (1, 2), (4, 8)):  # not last, no length, reserved, one byte of a length of 5
            bits.write(value, n)
        bits.align()
        bits.write(int.from_bytes(b"notes", "little"), 40)
        for value, n in ((0, 1), (0, 2), (len(part) - 1, 16), (1, 1)):  # not last, four nibbles of a length, uncompressed
            bits.write(value, n)
        bits.align()
        bits.write(int.from_bytes(part, "little"), 8 * len(part))
    bits.write(3, 2)  # last and empty
    return bits.bytes()


@query(f"WITH {_DOCS} SELECT stream_id, codec, md5(data) AS raw_md5, n, true AS all_read, CAST(NULL AS VARCHAR) AS err FROM s, (VALUES ('deflate/strict'), ('deflate/c'), ('brotli/strict'), ('brotli/c')) t(codec)")
def stored_blocks(spark, sf_dir):
    """Streams put together block by block from bytes left as they are, and metadata to skip."""
    out = None
    for name, make in (("deflate/strict", _stored), ("deflate/c", _stored), ("brotli/strict", _uncompressed), ("brotli/c", _uncompressed)):
        rows = text_streams(spark, sf_dir).withColumn("comp", transform(F.col("data"), make, "binary")).withColumn("r", decode(F.col("comp"), name))
        rows = rows.select("stream_id", F.lit(name).alias("codec"), F.md5("r.raw").alias("raw_md5"), F.col("r.out_offset").alias("n"), (F.col("r.in_offset") == F.octet_length("comp")).alias("all_read"), F.col("r.err.code").alias("err"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(_ROUND_SQL)
def roundtrip_brotli(spark, sf_dir):
    return _round_trip(spark, sf_dir, "brotli")


@query(_ROUND_SQL)
def roundtrip_zstd(spark, sf_dir):
    return _round_trip(spark, sf_dir, "zstd")


@query(_ROUND_SQL)
def roundtrip_xz(spark, sf_dir):
    return _round_trip(spark, sf_dir, "xz", 1)


_PAIRS = [(e.format, e.name, d.name) for e in bench.codecs() if e.encode for d in bench.codecs() if d.decode and d.format == e.format]


@query(f"""SELECT format, encoder, decoder, n_nationkey AS stream_id, true AS ok FROM nation, (VALUES {_values(_PAIRS)}) t(format, encoder, decoder)""")
def codec_matrix(spark, sf_dir):
    """Every decoder of a format on the output of every encoder of it, over the nations' comments and names."""
    nations = table(spark, sf_dir, "nation")
    text = F.concat_ws(" ", *(F.col(c).cast("string") for c in sorted(nations.columns)))
    return bench.cross_check(nations.select(F.col("n_nationkey").alias("stream_id"), F.encode(text, "UTF-8").alias("data")), "stream_id", "data")


@query("""SELECT format, min_by(codec, rank) AS codec FROM (VALUES ('brotli', 'brotli/c', 0), ('bzip2', 'bzip2/c', 0), ('chunked', 'chunked/own', 0), ('deflate', 'deflate/c', 0), ('xz', 'xz/c', 0), ('zstd', 'zstd/c', 0)) t(format, codec, rank) GROUP BY format""")
def codec_priority(spark, sf_dir):
    return bench.references(spark)


def _truncated(spark, sf_dir, name):
    """Each stream cut in half: a prefix of the text and the class of a short input."""
    cut = dealt(text_streams(spark, sf_dir)).withColumn("comp", encode(F.col("data"), name))
    cut = cut.withColumn("r", decode(F.substring(F.col("comp"), F.lit(1), F.floor(F.octet_length("comp") / 2).cast("int")), name))
    prefix = F.substring(F.col("data"), F.lit(1), F.col("r.out_offset").cast("int")) == F.col("r.raw")
    return cut.select("stream_id", F.lit(name).alias("codec"), is_truncated("r").alias("truncated"), prefix.alias("is_prefix"))


@query("SELECT doc_id AS stream_id, codec, true AS truncated, true AS is_prefix FROM documents, (VALUES ('deflate'), ('bzip2'), ('zstd'), ('xz')) t(codec)")
def truncated_streams(spark, sf_dir):
    out = _truncated(spark, sf_dir, "deflate")
    for name in ("bzip2", "zstd", "xz"):
        out = out.unionByName(_truncated(spark, sf_dir, name))
    return out


@query("SELECT doc_id AS stream_id, 'brotli' AS codec, true AS truncated, true AS is_prefix FROM documents")
def truncated_brotli(spark, sf_dir):
    """Whole texts, by the strict decoder: the library gives nothing of a stream that isn't whole."""
    return _truncated(spark, sf_dir, "brotli")


@query("""SELECT doc_id AS stream_id, fault, code, n_raw FROM documents, (VALUES ('deflate reserved block', 'CORRUPTED', 0), ('bzip2 magic', 'CORRUPTED', 0), ('bzip2 version 0', 'DEPRECATED', 0), ('bzip2 level 0', 'CORRUPTED', 0), ('brotli reserved window', 'CORRUPTED', 0), ('chunked without footer', 'CORRUPTED', 0), ('empty bzip2', 'UNEXPECTED_EOF', 0), ('empty brotli', 'UNEXPECTED_EOF', 0), ('empty chunked', 'CORRUPTED', 0)) t(fault, code, n_raw)""")
def corrupt_streams(spark, sf_dir):
    """Streams with one thing wrong that no content can hide, and empty ones."""
    streams = dealt(text_streams(spark, sf_dir))
    spoil_deflate = lambda made: bytes([made[0] | 6]) + made[1:]
    spoiled = {
        "deflate reserved block": ("deflate", lambda x: spoil_deflate(codec("deflate").encode(x, 0))),
        "bzip2 magic": ("bzip2", lambda x: b"XZ" + codec("bzip2").encode(x, 1)[2:]),
        "bzip2 version 0": ("bzip2", lambda x: b"BZ0" + codec("bzip2").encode(x, 1)[3:]),
        "bzip2 level 0": ("bzip2", lambda x: b"BZh0" + codec("bzip2").encode(x, 1)[4:]),
        "brotli reserved window": ("brotli", lambda x: b"\x11" + x),
        "chunked without footer": ("chunked", lambda x: container.compress_chunk(x)),
        "empty bzip2": ("bzip2", lambda x: b""),
        "empty brotli": ("brotli", lambda x: b""),
        "empty chunked": ("chunked", lambda x: b""),
    }
    out = None
    for fault, (name, spoil) in spoiled.items():
        rows = streams.withColumn("r", decode(transform(F.col("data"), spoil, "binary"), name))
        code = F.when(is_corrupted("r"), "CORRUPTED").when(is_deprecated("r"), "DEPRECATED").when(is_truncated("r"), "UNEXPECTED_EOF")
        rows = rows.select("stream_id", F.lit(fault).alias("fault"), code.alias("code"), F.col("r.out_offset").cast("int").alias("n_raw"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT doc_id AS stream_id, codec, octet_length(encode(coalesce(text, ''))) AS n, 7 AS unread FROM documents, (VALUES ('deflate'), ('zstd'), ('xz')) t(codec)")
def trailing_data(spark, sf_dir):
    """What follows a stream isn't touched: the input offset is its end."""
    out = None
    for name in ("deflate", "zstd", "xz"):
        rows = dealt(text_streams(spark, sf_dir)).withColumn("comp", encode(F.col("data"), name))
        rows = rows.withColumn("r", decode(F.concat(F.col("comp"), F.lit(b"\xff" * 7)), name))
        rows = rows.select("stream_id", F.lit(name).alias("codec"), F.col("r.out_offset").alias("n"), (F.octet_length("comp") + 7 - F.col("r.in_offset")).cast("int").alias("unread"))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- symbols and codes


@query(f"WITH {_DOC_BYTES} SELECT stream_id, v AS sym, count(*) AS cnt FROM b GROUP BY stream_id, v")
def byte_histogram(spark, sf_dir):
    return stages.histogram(text_streams(spark, sf_dir), "stream_id", "data")


@query(f"WITH {_DOC_BYTES} SELECT stream_id, count(DISTINCT v) AS used, string_agg(DISTINCT h2, '' ORDER BY h2) AS symbols FROM (SELECT stream_id, v, lower(right('0' || hex(v), 2)) AS h2 FROM b) GROUP BY stream_id")
def used_symbols(spark, sf_dir):
    found = stages.histogram(text_streams(spark, sf_dir), "stream_id", "data")
    pair = F.lower(F.lpad(F.hex("sym"), 2, "0"))
    return found.groupBy("stream_id").agg(F.count("*").alias("used"), F.array_join(F.array_sort(F.collect_set(pair)), "").alias("symbols"))


@query(f"WITH {_DOC_BYTES}, h AS (SELECT stream_id, v, count(*) AS cnt FROM b GROUP BY stream_id, v), t AS (SELECT *, sum(cnt) OVER (PARTITION BY stream_id) AS n FROM h) SELECT stream_id, CAST(max(n) AS BIGINT) AS n, count(*) AS used, round(sum(-cnt * log2(cnt / n)), 2) AS bits FROM t GROUP BY stream_id")
def entropy_bits(spark, sf_dir):
    return stages.entropy(stages.histogram(text_streams(spark, sf_dir), "stream_id", "data")).withColumn("bits", F.round("bits", 2))


def _codes(spark, sf_dir):
    return stages.code_lengths(stages.histogram(dealt(text_streams(spark, sf_dir)), "stream_id", "data"))


@query()
def huffman_lengths(spark, sf_dir):
    """Code lengths of every document's bytes. Which of several optimal codes comes out is the algorithm's; the cost is not (see kraft_check and the tests)."""
    return _codes(spark, sf_dir)


@query(f"WITH {_DOC_BYTES}, h AS (SELECT stream_id, v, count(*) AS cnt FROM b GROUP BY stream_id, v) SELECT stream_id, count(*) AS used, true AS kraft, true AS near_entropy FROM h GROUP BY stream_id")
def kraft_check(spark, sf_dir):
    """Codes fill the code space and cost at most one bit a symbol more than the entropy."""
    cost = stages.code_cost(_codes(spark, sf_dir))
    near = (F.col("bits") >= F.col("least") - 1e-6) & (F.col("bits") <= F.col("least") + F.col("n"))
    return cost.select("stream_id", "used", "kraft", near.alias("near_entropy"))


# complete trees of every size: one code for each length and two of the longest, dealt to symbols in an order of its own
_TREES_SQL = "t AS (SELECT p_size AS table_id, CAST(unnest(range(least(p_size, 25) + 1)) AS INT) AS k FROM (SELECT DISTINCT p_size FROM part)), c AS (SELECT table_id, CAST((k * 7 + table_id) % 97 AS INT) AS sym, CAST(least(k + 1, least(table_id, 25)) AS INT) AS len FROM t)"


def _trees(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("table_id")).distinct()
    depth = F.least(F.col("table_id"), F.lit(25))
    rows = sizes.select("table_id", F.explode(F.sequence(F.lit(0).cast("long"), depth)).alias("k"))
    return rows.select("table_id", ((F.col("k") * 7 + F.col("table_id")) % 97).cast("int").alias("sym"), F.least(F.col("k") + 1, depth).cast("int").alias("len"))


_CANONICAL_SQL = f"{_TREES_SQL}, f AS (SELECT *, CAST(coalesce(sum(CAST(1 AS BIGINT) << (27 - len)) OVER (PARTITION BY table_id ORDER BY len, sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) >> (27 - len) AS fwd FROM c)"


@query(f"WITH {_CANONICAL_SQL} SELECT CAST(table_id AS BIGINT) AS table_id, sym, len, CAST(list_sum(list_transform(range(len), lambda j: ((fwd >> CAST(j AS INT)) & 1) << CAST(len - 1 - j AS INT))) AS BIGINT) AS val FROM f")
def canonical_codes(spark, sf_dir):
    return stages.canonical(_trees(spark, sf_dir))


@query(f"WITH {_TREES_SQL} SELECT CAST(table_id AS BIGINT) AS table_id, CAST(0 AS BIGINT) AS conflicts FROM c GROUP BY table_id")
def prefix_free(spark, sf_dir):
    return stages.prefix_conflicts(stages.canonical(_trees(spark, sf_dir)))


@query(f"""WITH r AS ({_RANGE_SQL}), v AS (SELECT l_orderkey, l_linenumber, l_orderkey % 32768 + 1 AS distance FROM lineitem)
SELECT l_orderkey, l_linenumber, distance, max(sym) AS sym FROM v JOIN r ON r.name = 'deflate_distance' AND distance >= base AND distance < base + (CAST(1 AS BIGINT) << bits) GROUP BY l_orderkey, l_linenumber, distance""")
def range_symbol(spark, sf_dir):
    values = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 32768 + 1).alias("distance"))
    # lineitem repeats keys here; the SQL groups by them, so the query is of different rows, while the operator keeps all
    return dims.range_symbol(values.distinct(), dims.ranges(spark).where("name = 'deflate_distance'"), "distance")


# --- stages of bzip2

_RUNS_SQL = "r AS (SELECT stream_id, v, min(i) AS i, count(*) AS n FROM (SELECT stream_id, i, v, i - row_number() OVER (PARTITION BY stream_id, v ORDER BY i) AS g FROM b) GROUP BY stream_id, v, g)"


@query(f"WITH {_DOC_BYTES}, {_RUNS_SQL} SELECT l.stream_id, count(r.n) AS runs, CAST(coalesce(sum(5 * (r.n // 255) + CASE WHEN r.n % 255 < 4 THEN r.n % 255 ELSE 5 END), 0) AS BIGINT) AS size FROM l LEFT JOIN r USING (stream_id) GROUP BY l.stream_id")
def rle1_runs(spark, sf_dir):
    return text_streams(spark, sf_dir).withColumn("s", stages.rle1_stats(F.col("data"))).select("stream_id", "s.runs", "s.size")


@query(f"""WITH {_DOC_BYTES}, {_RUNS_SQL}, p AS (SELECT stream_id, i, right('0' || hex(v), 2) AS h2, n // 255 AS full_runs, n % 255 AS rest FROM r)
SELECT l.stream_id, md5(coalesce(string_agg(repeat(repeat(h2, 4) || 'FB', CAST(full_runs AS BIGINT)) || CASE WHEN rest < 4 THEN repeat(h2, CAST(rest AS BIGINT)) ELSE repeat(h2, 4) || right('0' || hex(rest - 4), 2) END, '' ORDER BY i), '')) AS encoded_md5, true AS ok FROM l LEFT JOIN p USING (stream_id) GROUP BY l.stream_id""")
def rle1_encode(spark, sf_dir):
    made = text_streams(spark, sf_dir).withColumn("e", stages.rle1(F.col("data"))).withColumn("back", stages.rle1_inverse(F.col("e")))
    return made.select("stream_id", F.md5(F.hex("e").cast("binary")).alias("encoded_md5"), ((F.col("back.raw") == F.col("data")) & F.col("back.err").isNull()).alias("ok"))


@query("""WITH s AS (SELECT c_custkey AS stream_id, hex(encode(c_name)) AS t, octet_length(encode(c_name)) AS n FROM customer),
r AS (SELECT stream_id, i, substring(t || t, 2 * i + 1, 2 * n) AS rot FROM (SELECT *, unnest(range(n)) AS i FROM s)),
o AS (SELECT stream_id, i, rot, row_number() OVER (PARTITION BY stream_id ORDER BY rot, i DESC) - 1 AS k FROM r)
SELECT stream_id, string_agg(right(rot, 2), '' ORDER BY k) AS bwt, CAST(min(CASE WHEN i = 0 THEN k END) AS INT) AS ptr, true AS ok FROM o GROUP BY stream_id""")
def bwt_names(spark, sf_dir):
    made = dealt(text_streams(spark, sf_dir, "customer", "c_custkey", "c_name")).withColumn("b", stages.bwt(F.col("data")))
    return made.select("stream_id", F.hex("b.bwt").alias("bwt"), "b.ptr", (stages.bwt_inverse(F.col("b")) == F.col("data")).alias("ok"))


@query(f"SELECT doc_id AS stream_id, true AS ok FROM documents WHERE coalesce(text, '') <> ''")
def bwt_documents(spark, sf_dir):
    """Whole documents sorted and restored."""
    made = dealt(text_streams(spark, sf_dir).where(F.octet_length("data") > 0)).withColumn("b", stages.bwt(F.col("data")))
    return made.select("stream_id", (stages.bwt_inverse(F.col("b")) == F.col("data")).alias("ok"))


_SEEN_SQL = f"""{_NAME_BYTES}, q AS (SELECT stream_id, i, v, max(i) OVER (PARTITION BY stream_id, v ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b),
near AS (SELECT q.stream_id, q.i, q.v, q.before, count(DISTINCT p.v) AS between_them, count(DISTINCT CASE WHEN p.v > q.v THEN p.v END) AS above
FROM q LEFT JOIN b p ON p.stream_id = q.stream_id AND p.i < q.i AND (q.before IS NULL OR p.i > q.before) GROUP BY q.stream_id, q.i, q.v, q.before)"""


@query(f"WITH {_SEEN_SQL} SELECT stream_id, string_agg(right('0' || hex(CAST(CASE WHEN before IS NULL THEN v + above ELSE between_them END AS INT)), 2), '' ORDER BY i) AS places FROM near GROUP BY stream_id")
def mtf_identity(spark, sf_dir):
    return text_streams(spark, sf_dir, "customer", "c_custkey", "c_name").select("stream_id", F.hex(stages.mtf(F.col("data"))).alias("places"))


@query(f"""WITH {_SEEN_SQL}, alpha AS (SELECT stream_id, v, row_number() OVER (PARTITION BY stream_id ORDER BY v) - 1 AS rank FROM (SELECT DISTINCT stream_id, v FROM b)),
places AS (SELECT n.stream_id, n.i, CASE WHEN n.before IS NULL THEN a.rank + n.above ELSE n.between_them END AS p FROM near n JOIN alpha a ON a.stream_id = n.stream_id AND a.v = n.v),
g AS (SELECT *, CASE WHEN p = 0 THEN i - row_number() OVER (PARTITION BY stream_id, p = 0 ORDER BY i) ELSE -1 - i END AS grp FROM places),
runs AS (SELECT stream_id, min(i) AS i, max(p) AS p, count(*) AS n FROM g GROUP BY stream_id, p = 0, grp),
text AS (SELECT stream_id, i, CASE WHEN p > 0 THEN CAST(p + 1 AS VARCHAR) ELSE substring(regexp_replace(reverse(bin(n + 1)), '(.)', ',\\1', 'g'), 2, 2 * length(bin(n + 1)) - 3) END AS part FROM runs)
SELECT stream_id, string_agg(part, ',' ORDER BY i) AS symbols FROM text GROUP BY stream_id""")
def rle2_symbols(spark, sf_dir):
    made = text_streams(spark, sf_dir, "customer", "c_custkey", "c_name").select("stream_id", stages.mtf_rle2(F.col("data")).alias("s"))
    return made.select("stream_id", F.array_join(F.col("s").cast("array<string>"), ",").alias("symbols"))


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i, l_partkey % 4294967296 AS c FROM lineitem),
f AS (SELECT k, i, c AS crc FROM l WHERE i = 1 UNION ALL SELECT l.k, l.i, xor((f.crc * 2) % 4294967296 + f.crc // 2147483648, l.c) FROM f JOIN l ON l.k = f.k AND l.i = f.i + 1)
SELECT k AS stream_id, CAST(max_by(crc, i) AS BIGINT) AS stream_crc FROM f GROUP BY k""")
def crc_fold(spark, sf_dir):
    """The checksum of a stream from its blocks': here an order's lines are the blocks and their part keys the checksums."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("stream_id"), "l_linenumber", F.col("l_partkey").alias("crc"))
    return stages.fold_crcs(lines, "l_linenumber", "crc")


@query()
def block_checksums(spark, sf_dir):
    """CRC-32 both ways round of every document: Spark's own, and most significant bit first."""
    return text_streams(spark, sf_dir).select("stream_id", F.crc32("data").alias("crc_lsb"), stages.crc_msb(F.col("data")).alias("crc_msb"))


# --- bits and integers


@query("SELECT l_orderkey, l_linenumber, CAST(list_sum(list_transform(range(32), lambda j: ((l_orderkey >> CAST(j AS INT)) & 1) << CAST(31 - j AS INT))) AS BIGINT) AS reversed, (l_orderkey >> 3) & 31 AS middle FROM lineitem")
def bit_reverse(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bits.reverse_bits(F.col("l_orderkey"), 32).alias("reversed"), bits.take_bits(F.col("l_orderkey"), 3, 5).alias("middle"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey < 128 THEN 1 WHEN o_orderkey < 16384 THEN 2 WHEN o_orderkey < 2097152 THEN 3 WHEN o_orderkey < 268435456 THEN 4 ELSE 5 END AS varint_bytes,
CASE WHEN o_orderkey <= 1 THEN 0 ELSE length(bin(o_orderkey - 1)) END AS needed, CAST((8 - o_orderkey % 8) % 8 AS INT) AS pads FROM orders""")
def integer_sizes(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", bits.uvarint_len(k).alias("varint_bytes"), bits.needed_bits(k).alias("needed"), bits.pads(k).alias("pads"))


@query(f"""WITH {_bytes("part", "p_partkey", "p_name")}, c AS (SELECT stream_id, CAST(8 * count(*) AS BIGINT) AS n, CAST(sum(bit_count(v)) AS BIGINT) AS ones FROM b GROUP BY stream_id),
m AS (SELECT stream_id, n - ones AS zeros, ones, least(n - ones, ones) AS few, greatest(n - ones, ones) AS many FROM c)
SELECT stream_id, zeros, ones, CAST(coalesce((SELECT min(h) FROM range(1, 8) t(h) WHERE 257 - (1 << CAST(h AS INT)) >= many + 8 AND (1 << CAST(h AS INT)) >= few + 8), 0) AS INT) AS code_length FROM m""")
def meta_code_length(spark, sf_dir):
    """The code length that a meta block of each part's name would need."""
    counts = stages.histogram(text_streams(spark, sf_dir, "part", "p_partkey", "p_name"), "stream_id", "data")
    ones = F.sum(F.col("cnt") * F.bit_count("sym"))
    found = counts.groupBy("stream_id").agg((8 * F.sum("cnt") - ones).alias("zeros"), ones.alias("ones"))
    return found.withColumn("code_length", bits.meta_code_length(F.col("zeros"), F.col("ones")))


@query("""WITH m AS (SELECT CAST(n AS INT) AS n_bytes, CAST(unnest(range(8 * n + 1)) AS INT) AS ones FROM range(32) t(n)), k AS (SELECT *, least(8 * n_bytes - ones, ones) AS few, greatest(8 * n_bytes - ones, ones) AS many FROM m)
SELECT n_bytes, ones, CAST(coalesce((SELECT min(h) FROM range(1, 8) t(h) WHERE 257 - (1 << CAST(h AS INT)) >= many + 8 AND (1 << CAST(h AS INT)) >= few + 8), 0) AS INT) AS code_length FROM k""")
def meta_coverage(spark, sf_dir):
    return bench.meta_efficiency(spark)


def _context_sql() -> str:
    last = _values((m, b, brotli_tables.literal_context(m, b, 0) & ~dims.second(m, 0)) for m in (2, 3) for b in range(256))
    second = _values((m, b, dims.second(m, b)) for m in (2, 3) for b in range(256))
    return f"""WITH {_DOC_BYTES}, p AS (SELECT v, coalesce(lag(v, 1) OVER w, 0) AS p1, coalesce(lag(v, 2) OVER w, 0) AS p2 FROM b WINDOW w AS (PARTITION BY stream_id ORDER BY i)), g AS (SELECT p1, p2, count(*) AS n FROM p GROUP BY p1, p2),
c AS (SELECT 0 AS mode, p1 & 63 AS context, n FROM g UNION ALL SELECT 1, p1 >> 2, n FROM g
UNION ALL SELECT l.mode, l.c | s.c, n FROM g JOIN (VALUES {last}) l(mode, b, c) ON l.b = g.p1 JOIN (VALUES {second}) s(mode, b, c) ON s.b = g.p2 AND s.mode = l.mode)
SELECT mode, context, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY mode, context"""


@query(_context_sql())
def literal_contexts(spark, sf_dir):
    return stages.literal_context_counts(text_streams(spark, sf_dir), "data")


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 20 + 2 > 4 THEN 3 ELSE o_orderkey % 20 END AS INT) AS context FROM orders")
def distance_context(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", bits.distance_context(F.col("o_orderkey") % 20 + 2).cast("int").alias("context"))


def _transform_sql() -> str:
    def text(b: bytes) -> str:
        return "''" if not b else " || ".join(f"chr({k})" for k in b.decode("utf-8").encode("utf-32-le")[::4]) if b.isascii() else "chr(160)"

    rows = ", ".join(f"({k}, {text(p)}, '{op}', {text(s)})" for k, (p, op, s) in enumerate(brotli_tables.TRANSFORMS))
    return f"""WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> ''), t(id, p, op, s) AS (VALUES {rows})
SELECT id, word, p || CASE WHEN op = 'id' THEN word WHEN op = 'first' THEN upper(left(word, 1)) || substring(word, 2) WHEN op = 'all' THEN upper(word)
WHEN op[1] = '+' THEN substring(word, CAST(op[2:] AS INT) + 1) ELSE left(word, CAST(greatest(0, length(word) - CAST(op[2:] AS INT)) AS BIGINT)) END || s AS result FROM w, t"""


@query(_transform_sql())
def word_transforms(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).where("word <> ''").distinct()
    return stages.word_transforms(words, "word", dims.transforms(spark)).withColumn("result", F.decode("result", "UTF-8"))


# --- containers


@query(f"WITH {_DOCS} SELECT stream_id, md5(data) AS raw_md5, (n + 1023) // 1024 AS n_chunks, (n + 3071) // 3072 AS n_indexes, true AS inflates FROM s WHERE n > 0")
def container_roundtrip(spark, sf_dir):
    """Streams chunked, compressed, put together, indexed from their own bytes, and read back two ways."""
    made = chunks.assemble(chunks.store(chunks.plan(dealt(text_streams(spark, sf_dir)), 1024)), 3)
    back = made.withColumn("r", decode(F.col("comp"), "chunked")).withColumn("z", decode(F.col("comp"), "deflate")).withColumn("k", chunks.stored_records(F.col("comp")))
    same = (F.col("z.raw") == F.col("r.raw")) & (F.col("z.in_offset") == F.octet_length("comp"))
    count = lambda kind: F.size(F.filter("k.records", lambda x: x["type"] == kind)).cast("long")
    return back.select("stream_id", F.md5("r.raw").alias("raw_md5"), same.alias("inflates"), count(container.DEFLATE).alias("n_chunks"), count(container.INDEX).alias("n_indexes"))


@query("SELECT p_partkey AS stream_id, p_name AS raw, 'META' AS final, true AS all_read, 0 AS inflated FROM part")
def meta_roundtrip(spark, sf_dir):
    made = dealt(text_streams(spark, sf_dir, "part", "p_partkey", "p_name")).withColumn("m", stages.meta_encode(F.col("data")))
    back = made.withColumn("r", stages.meta_decode(F.col("m"))).withColumn("z", decode(F.col("m"), "deflate"))
    return back.select("stream_id", F.decode("r.raw", "UTF-8").alias("raw"), "r.final", (F.col("r.in_offset") == F.octet_length("m")).alias("all_read"), F.col("z.out_offset").cast("int").alias("inflated"))


@query("SELECT doc_id AS stream_id, octet_length(encode(coalesce(text, ''))) AS at, -1 AS none FROM documents")
def magic_search(spark, sf_dir):
    """The footer of an empty container, found behind each document; the documents alone have none."""
    footer = container.encode_footer(0)
    made = text_streams(spark, sf_dir)
    return made.select("stream_id", stages.magic_search(F.concat(F.col("data"), F.lit(footer))).alias("at"), stages.magic_search(F.col("data")).alias("none"))


# --- benchmark


_CELLS = _values((c.format, c.name) for c in bench.codecs() if c.encode)


@query(f"SELECT file, format, codec, level, size, true AS ok FROM (VALUES ('zeros.bin'), ('random.bin'), ('repeats.bin'), ('huffman.txt')) f(file), (VALUES {_CELLS}) c(format, codec), (VALUES (1), (6), (9)) l(level), (VALUES (10000), (100000)) s(size)")
def bench_matrix(spark, sf_dir):
    """The grid over made files, each cell encoded and decoded; timings are left out here."""
    found = bench.run(bench.shape_files(spark).repartition(8), sizes=(10_000, 100_000))
    return found.select("file", "format", "codec", "level", "size", "ok")


@query()
def bench_ratios(spark, sf_dir):
    """Ratio of every codec on the made files, a column for each, with no timing in it."""
    return bench.report(bench.run(bench.shape_files(spark).repartition(8), sizes=(100_000,)).withColumn("ratio", F.round("ratio", 3)), "ratio")


@query()
def bench_delta(spark, sf_dir):
    """Ratio of every level over that of the first codec of the same file and size."""
    found = bench.run(bench.shape_files(spark).repartition(8), sizes=(10_000,))
    return bench.with_delta(found, "ratio", "file", "level", "size").select("file", "format", "codec", "level", "size", F.round("ratio", 3).alias("ratio"), F.round("delta", 3).alias("delta"))


@query(f"""WITH l AS (SELECT doc_id AS stream_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents WHERE coalesce(text, '') <> ''),
b AS (SELECT stream_id, i, xor(CAST('0x' || h[i % len(h) + 1] AS INT), CAST((i // len(h)) % 256 AS INT)) AS v FROM (SELECT stream_id, h, unnest(range(2000)) AS i FROM l))
SELECT stream_id, md5(string_agg(right('0' || hex(v), 2), '' ORDER BY i)) AS resized_md5 FROM b GROUP BY stream_id""")
def resize_data(spark, sf_dir):
    streams = text_streams(spark, sf_dir).where(F.octet_length("data") > 0)
    return streams.select("stream_id", F.md5(F.hex(stages.resize(F.col("data"), 2000)).cast("binary")).alias("resized_md5"))


@query(f"""WITH {_CHUNK_SQL} SELECT stream_id, 8 * count(*) AS fixed, CAST(sum(CASE WHEN raw_end < 128 THEN 1 WHEN raw_end < 16384 THEN 2 WHEN raw_end < 2097152 THEN 3 ELSE 4 END) AS BIGINT) AS variable,
CAST(sum(CASE WHEN raw_end - raw_start < 128 THEN 1 ELSE 2 END) AS BIGINT) AS delta FROM c GROUP BY stream_id""")
def layout_sizes(spark, sf_dir):
    """Size of the raw column of each stream's index with fixed, variable and delta integers."""
    rows = chunks.plan(text_streams(spark, sf_dir), keep_bytes=False)
    return rows.groupBy("stream_id").agg((8 * F.count("*")).alias("fixed"), F.sum(bits.uvarint_len(F.col("raw_end"))).alias("variable"), F.sum(bits.uvarint_len(F.col("raw_end") - F.col("raw_start"))).alias("delta"))


@query(f"WITH {_DOCS} SELECT stream_id, (n + 1023) // 1024 AS n_chunks, true AS costs FROM s WHERE n > 4096")
def chunking_cost(spark, sf_dir):
    """Chunks cost something against one stream: never less, for streams of several."""
    found = bench.chunking_cost(dealt(text_streams(spark, sf_dir).where(F.octet_length("data") > 4096)), "stream_id", "data", 1024)
    return found.select("stream_id", "n_chunks", (F.col("chunked") > F.col("streamed")).alias("costs"))


# --- windows of past output


@query("SELECT c_custkey AS stream_id, c_name || left(repeat(right(c_name, 3), 4), 10) || '!' AS expanded FROM customer")
def lz_expand(spark, sf_dir):
    """Operations on a window: insert the name, copy ten bytes from three back, insert a mark."""
    from ..functions.lz import expand

    names = text_streams(spark, sf_dir, "customer", "c_custkey", "c_name")
    made = transform(F.col("data"), lambda x: expand([(3, 10, x), (0, 0, b"!")]), "binary")
    return names.select("stream_id", F.decode(made, "UTF-8").alias("expanded"))


# --- streams in motion


@query(_sql["chunk_plan"])
def stream_chunks(spark, sf_dir):
    """The chunk plan, made by a stream over the table's files that runs until it has them all."""
    import tempfile

    from ..streaming import chunk_stream

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp()
    name = f"{base.rstrip('/')}/stream-{spark.sparkContext.applicationId}-{id(object())}"
    schema = table(spark, sf_dir, "documents").schema
    source = chunk_stream.read_table(spark, f"{sf_dir}/documents.parquet", schema).select(F.col("doc_id").alias("stream_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    chunk_stream.store_stream(source, f"{name}/chunks", f"{name}/state", "stream_id", "data")
    return spark.read.parquet(f"{name}/chunks").select("stream_id", "chunk_id", "raw_start", "raw_end")
