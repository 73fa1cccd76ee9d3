"""WARC archives: written as plain text files by Spark, read back by a verified chain of record borders.

Payloads and headers are UTF-8, so an archive is a text file whose line end is CRLF, and Spark's own text writer
makes it on any file system, with its commit protocol. A record's block is an HTTP response. Pages with equal
payloads of at least REVISIT bytes are stored once, under the smallest page_id; the others are revisit records.

Reading splits files, however large. Spark's text reader cuts a file at the record mark, wherever that stands, and gives
what lies between two marks as a row, so a split's rows add up to its place in the file. The mark isn't trusted, as
payloads may contain it. Tasks emit every candidate, a mark with a whole header, with the offset of its successor, as
its Content-Length has it, and jump pointers inside their split: where does a chain that enters here leave the split?
Pointers from split to split are jumped in DataFrames, from the start of each file, over the few places where chains
leave splits; in each split that the chain enters, its candidates are followed once more. Only what it reaches is a
record, and it must end with the file.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, batch, forget, materialise, sliced

REVISIT = 100
#: Records of one file at most. Nothing depends on it, as files are split on reading.
PER_FILE = 65536
MARK = "WARC/1.1\r\n"
_DATE = "1970-01-01T00:00:00Z"
_FIELD = re.compile(rb"^([A-Za-z-]+): ?(.*?)\r?$", re.M)


def _urn(page: F.Column) -> F.Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit("null"))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """A record for every row of pages. A null page is empty; line ends in a url become blanks; a null url is empty. A url
    that ends like the record mark has its last character escaped, so that no line of a header ends in the mark."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    url = F.regexp_replace(F.translate(F.col(url_col).cast("string"), "\r\n", "  "), r"WARC/1\.1$", "WARC/1.%31")
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(url, F.lit("")).alias("url"), html.alias("html"))
    source = source.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    large = materialise(source.where(F.octet_length("html") >= REVISIT).select("page_id", "digest"), "digests")
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    # of pages that are copies only; written, so that Spark knows its size and picks the join by it
    copies = materialise(large.join(firsts, "digest").where("page_id <> first").select("page_id", "digest", "first").distinct(), "copies")
    rows = source.join(copies, ["page_id", "digest"], "left")
    revisit = F.col("first").isNotNull()
    payload = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    fields = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", _urn(F.col("page_id"))),
        ("WARC-Date", F.lit(_DATE)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.when(revisit, _urn(F.col("first")))),
        ("X-Refers-To-Page", F.when(revisit, F.col("first").cast("string"))),
        ("X-Page", F.col("page_id").cast("string")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", (F.octet_length(http) + F.octet_length(payload)).cast("string")),
    ]
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in fields]
    record = F.concat(F.lit(MARK), *lines, F.lit("\r\n"), http, payload, F.lit("\r\n"))
    rows.select(record.alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", PER_FILE).text(path)
    forget(large, copies)


def header(segment: bytes) -> tuple[dict[bytes, bytes], int, int] | None:
    """Fields of what stands behind a mark, where its block begins, and the block's length; None if that isn't a whole header."""
    end = segment.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = dict(_FIELD.findall(segment[: end + 2]))
    length = fields.get(b"Content-Length", b"")
    return (fields, end + 4, int(length)) if length.isdigit() and len(length) < 19 else None


def leaves(at: np.ndarray, following: np.ndarray, end: int) -> np.ndarray:
    """Where the chain from each candidate of a split first comes to a place that is none of them: by pointer jumping.

    at is in ascending order. A chain that ends inside the split at a place without a candidate is broken, and stays there.
    """
    n = len(at)
    found = np.searchsorted(at, following)
    jump = np.where((found < n) & (at[np.minimum(found, n - 1)] == following), found, n) if n else np.zeros(0, np.int64)
    out, jump = following.copy(), np.append(jump, n)
    while (inside := jump[:n] < n).any():
        out[inside] = out[jump[:n][inside]]
        jump = jump[jump]
    return out


def entered(at: np.ndarray, following: np.ndarray, first: int) -> np.ndarray:
    """Which candidates of a split the chain from first, one of them, meets."""
    n = len(at)
    found = np.searchsorted(at, following)
    jump = np.append(np.where((found < n) & (at[np.minimum(found, n - 1)] == following), found, n), n)
    on = np.zeros(n + 1, bool)
    on[np.searchsorted(at, first)] = True
    while True:
        more = on.copy()
        more[jump[on]] = True
        if (more == on).all():
            return on[:n]
        on, jump = more, jump[jump]


_FACTS = "file string, size long, split long, kind int, at long, next long, leave long, page_id long, type string, refers_to long, told string, digest string, bytes long, body long"
_FACT_SCHEMA = pa.schema([("file", pa.string()), ("size", pa.int64()), ("split", pa.int64()), ("kind", pa.int32()), ("at", pa.int64()), ("next", pa.int64()), ("leave", pa.int64()), ("page_id", pa.int64()), ("type", pa.string()), ("refers_to", pa.int64()), ("told", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()), ("body", pa.int64())])


def _segments(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", MARK).option("pathGlobFilter", "part-*").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("split"), "value")


def _runs(batches, rows: int = 256):
    """(file, size, split, offset in the split, value) of each row. A split's rows come in order, one split after the other."""
    last, offset = None, 0
    for b in sliced(batches, rows):
        for file, size, split, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), as_bytes(b.column(3)), strict=True):
            if (file, split) != last:
                last, offset = (file, split), 0
            yield file, size, split, offset, value
            offset += len(value) + len(MARK)


def _scan(batches):
    """A row of kind 0 for each split, with its bytes in at; rows of kind 1 for its candidates, offsets from the split's start."""

    def close(key, total, found):
        at, following = (np.array([r[k] for r in found], np.int64) for k in (0, 1))
        leave = leaves(at, following, total).tolist()
        rows = [(*key, 1, r[0], r[1], out, *r[2:]) for r, out in zip(found, leave, strict=True)]
        rows.append((*key, 0, total, *[None] * 9))
        for k in range(0, len(rows), 4096):
            yield batch(_FACT_SCHEMA, *zip(*rows[k : k + 4096], strict=True))

    key, total, found = None, 0, []
    for file, size, split, offset, value in _runs(batches):
        if (file, size, split) != key:
            if key:
                yield from close(key, total, found)
            key, found = (file, size, split), []
        total = offset + len(value) + len(MARK)
        whole = header(value)
        if whole is None:
            continue
        fields, begin, length = whole
        text = lambda name: fields.get(name, b"").decode("ascii", "replace")
        page, refers = (int(x) if (x := fields.get(k, b"")).lstrip(b"-").isdigit() else None for k in (b"X-Page", b"X-Refers-To-Page"))
        digest = size_of = None
        body = value.find(b"\r\n\r\n", begin) + 4
        if body >= 4 and begin + length <= len(value):  # else the payload has a mark, and is read again once the chain is known
            payload = value[body : begin + length]
            digest, size_of = hashlib.sha256(payload).hexdigest(), len(payload)
        found.append((offset - len(MARK), offset + begin + length + 4, page, text(b"WARC-Type"), refers, text(b"WARC-Payload-Digest").removeprefix("sha256:"), digest, size_of, offset + begin))
    if key:
        yield from close(key, total, found)


def _reached(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(file, at): where the chain from 0 comes into a split, or ends. Offsets are those of the file."""
    places = candidates.select("file", F.col("leave").alias("at")).distinct().unionByName(files.select("file", F.lit(0).cast("long").alias("at"))).distinct()
    jump = materialise(candidates.join(places, ["file", "at"], "left_semi").select("file", "at", "leave"), "jumps")
    on = materialise(files.select("file", F.lit(0).cast("long").alias("at")), "reached")
    moved = jump.limit(1).count()
    while moved:
        more = materialise(on.unionByName(on.join(jump, ["file", "at"]).select("file", F.col("leave").alias("at"))).distinct(), "reached")
        beyond = jump.select("file", F.col("at").alias("leave"), F.col("leave").alias("beyond"))
        doubled = materialise(jump.join(beyond, ["file", "leave"]).select("file", "at", F.col("beyond").alias("leave")), "jumps")
        moved = doubled.limit(1).count()
        on, jump = more, doubled
    return on


def _pieces(spark: SparkSession, path: str, splits: DataFrame, torn: DataFrame) -> DataFrame:
    """(file, at, digest, bytes) of records whose payload has a mark in it: their splits are read again.

    torn: file, at, body and next of them, the latter two of their block and successor.
    """

    def offsets(batches):
        schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("offset", pa.int64()), ("value", pa.binary())])
        for file, _, split, offset, value in _runs(batches):
            yield batch(schema, [file], [split], [offset], [value])

    wanted = torn.alias("t").join(splits.alias("s"), (F.col("t.file") == F.col("s.file")) & (F.col("t.at") < F.col("s.base") + F.col("s.bytes")) & (F.col("t.next") > F.col("s.base")))
    wanted = materialise(wanted.select("t.file", "t.at", "t.body", "t.next", "s.split", "s.base"), "torn")
    rows = _segments(spark, path).mapInArrow(offsets, "file string, split long, offset long, value binary").join(wanted, ["file", "split"])
    rows = rows.withColumn("offset", F.col("offset") + F.col("base")).where("offset > at AND offset < next").select("file", "at", "body", "next", "offset", "value")
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("digest", pa.string()), ("bytes", pa.int64())])

    def join(batches):
        last, held = None, bytearray()

        def close():
            file, at, body, following, begin = last
            block = bytes(held[body - begin : following - 4 - begin])
            cut = block.find(b"\r\n\r\n") + 4
            return batch(schema, [file], [at], [hashlib.sha256(block[cut:]).hexdigest()], [len(block) - cut])

        for b in sliced(batches, 256):
            for file, at, body, following, offset, value in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if last is None or (file, at) != last[:2]:
                    if last:
                        yield close()
                    last, held = (file, at, body, following, offset), bytearray()
                held += value + MARK.encode()
        if last:
            yield close()

    return rows.repartition("file", "at").sortWithinPartitions("file", "at", "offset").mapInArrow(join, "file string, at long, digest string, bytes long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, from the files alone.

    A response's payload is hashed as read and held against its header. A revisit's length and digest are those of
    the response that it names, which must agree with its own header. A broken chain or a payload that doesn't match is an
    error.
    """
    facts = materialise(_segments(spark, path).mapInArrow(_scan, _FACTS), "facts")
    # a file's last row has no mark behind it
    upward = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = facts.where("kind = 0").select("file", "size", "split", F.col("at").alias("bytes"))
    splits = materialise(splits.withColumn("base", F.coalesce(F.sum("bytes").over(upward), F.lit(0))), "splits")
    files = splits.groupBy("file").agg(F.max("size").alias("size"), F.sum("bytes").alias("bytes"))
    if files.where(f"bytes - {len(MARK)} <> size").limit(1).count():
        raise ValueError("a file wasn't read whole, or has no record mark")
    files = files.select("file", "size")
    shifted = [(F.col(c) + F.col("base")).alias(c) for c in ("at", "next", "leave", "body")]
    plain = [F.col(c) for c in ("file", "split", "page_id", "type", "refers_to", "told", "digest", "bytes")]
    found = facts.where("kind = 1").drop("size").join(splits.select("file", "split", "base"), ["file", "split"]).select(*plain, *shifted)
    candidates = materialise(found, "candidates")
    reached = _reached(candidates, files)
    # the end of the file is where the last record's successor would begin
    ends = reached.select("file", F.col("at").alias("size")).join(files, ["file", "size"], "left_semi")
    if files.join(ends, ["file", "size"], "left_anti").limit(1).count():
        raise ValueError("the chain of records breaks before the end of the file")
    entries = candidates.join(reached, ["file", "at"], "left_semi").groupBy("file", "split").agg(F.min("at").alias("first"))
    fields = ["file", "split", "first", "at", "next", "body", "page_id", "type", "refers_to", "told", "digest", "bytes"]
    schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("first", pa.int64()), ("at", pa.int64()), ("next", pa.int64()), ("body", pa.int64()), ("page_id", pa.int64()), ("type", pa.string()), ("refers_to", pa.int64()), ("told", pa.string()), ("digest", pa.string()), ("bytes", pa.int64())])

    def follow(batches):
        """Partitions hold whole splits, in order of place."""
        key, held = None, []

        def close():
            if not held:
                return
            every = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            on = entered(every.column(3).to_numpy(), every.column(4).to_numpy(), key[2])
            yield batch(schema, *every.filter(pa.array(on)).columns)

        for b in batches:
            names, splits_of, firsts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            start = 0
            for k in range(1, b.num_rows + 1):
                if k == b.num_rows or (names[k], splits_of[k]) != (names[start], splits_of[start]):
                    if key is None or key[:2] != (names[start], splits_of[start]):
                        yield from close()
                        key, held = (names[start], splits_of[start], firsts[start]), []
                    held.append(b.slice(start, k - start))
                    start = k
        yield from close()

    dealt = candidates.join(entries, ["file", "split"]).select(*fields).repartition("file", "split").sortWithinPartitions("file", "split", "at")
    records = materialise(dealt.mapInArrow(follow, ", ".join(f"{f.name} {'string' if pa.types.is_string(f.type) else 'long'}" for f in schema)), "records")
    torn = records.where("type = 'response' AND digest IS NULL")
    if torn.limit(1).count():
        again = _pieces(spark, path, splits, torn.select("file", "at", "body", "next"))
        known = materialise(again.withColumnsRenamed({"digest": "read", "bytes": "length"}), "payloads")
        records = records.join(known, ["file", "at"], "left").withColumn("digest", F.coalesce("digest", "read")).withColumn("bytes", F.coalesce("bytes", "length"))
    response = F.col("type") == "response"
    if records.where(response & ~F.col("digest").eqNullSafe(F.col("told"))).limit(1).count():
        raise ValueError("a payload doesn't match its digest")
    named = records.where(~response).select("refers_to", F.col("told").alias("digest")).distinct()
    responses = records.where(response).select(F.col("page_id").alias("refers_to"), "digest", F.col("bytes").alias("full"))
    full = responses.join(named, ["refers_to", "digest"], "left_semi").groupBy("refers_to", "digest").agg(F.max("full").alias("full"))
    joined = records.drop("digest").withColumnRenamed("told", "digest").join(full, ["refers_to", "digest"], "left")
    length = F.when(response, F.col("bytes")).otherwise(F.coalesce("full", F.raise_error(F.lit("a revisit names no response")).cast("long")))
    return joined.select("page_id", length.alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
