"""Codecs over binary columns, vectorised with Arrow.

Encoders and decoders are C libraries. A row that the library rejects is decoded again by the strict decoder of the format,
which says what came out before the fault, where it lies and of what class it is. No row fails a task.
"""

from __future__ import annotations

import bz2
import contextlib
import ctypes
import lzma
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import brotli, bzip2, container, deflate
from ..functions.errors import CORRUPTED, INVALID, UNEXPECTED_EOF, CodecError

#: What a row may inflate to unless told otherwise; bytes of input given to a library that knows no limit at a time.
MOST, _STEP = 1 << 28, 1 << 10
#: Bytes of a batch that are worked on at a time, and of what a library is asked for at a time.
_SLICE, _PIECE = 1 << 20, 1 << 16
#: Dictionaries of xz's presets.
_XZ_DICTIONARY = {4: 1 << 22, 5: 1 << 23, 6: 1 << 23, 7: 1 << 24, 8: 1 << 25, 9: 1 << 26}
RESULT = "struct<raw:binary,in_offset:bigint,out_offset:bigint,err:struct<code:string,pkg:string,msg:string>>"
_ERR = pa.struct([("code", pa.string()), ("pkg", pa.string()), ("msg", pa.string())])
_RESULT = pa.struct([("raw", pa.binary()), ("in_offset", pa.int64()), ("out_offset", pa.int64()), ("err", _ERR)])

Decoded = tuple[bytes, int, CodecError | None]


@dataclass(frozen=True)
class Codec:
    """name: format/maker. encode takes a level (0: default); decode an output limit. Either may be absent."""

    name: str
    format: str
    rank: int  #: of makers of one format, the least is the reference that others are compared with
    encode: Callable[[bytes, int], bytes] | None = None
    decode: Callable[[bytes, int], Decoded] | None = None


_registry: dict[str, Codec] = {}


def register(codec: Codec) -> None:
    _registry[codec.name] = codec


def codecs() -> list[Codec]:
    """All registered codecs, in the order of their formats and ranks."""
    return sorted(_registry.values(), key=lambda c: (c.format, c.rank))


def codec(name: str) -> Codec:
    """By name, or by format: its first."""
    found = _registry.get(name) or next((c for c in codecs() if c.format == name), None)
    if found is None:
        raise CodecError(INVALID, f"no codec {name}")
    return found


def _level(level: int, default: int) -> int:
    if not 0 <= level <= 9:
        raise CodecError(INVALID, f"level {level}")
    return level or default


def _deflate(data: bytes, level: int) -> bytes:
    made = zlib.compressobj(_level(level, 6), zlib.DEFLATED, -15)
    return made.compress(data) + made.flush()


def _inflate(data: bytes, most: int) -> Decoded:
    made = zlib.decompressobj(-15)
    try:
        out = made.decompress(data, most + 1)
    except zlib.error:
        return deflate.inflate(data, most)
    if len(out) > most:
        return out[:most], len(data) - len(made.unconsumed_tail), CodecError(INVALID, f"more than {most} bytes of output")
    if made.eof:
        return out, len(data) - len(made.unused_data), None
    return out, len(data), CodecError(UNEXPECTED_EOF, "the input ends too early")


def _bunzip2(data: bytes, most: int) -> Decoded:
    """All of the streams that stand in a row."""
    out, rest = [], data
    try:
        while rest or not out:
            made = bz2.BZ2Decompressor()
            out.append(made.decompress(rest, most + 1 - sum(map(len, out))))
            if sum(map(len, out)) > most:
                return b"".join(out)[:most], len(data), CodecError(INVALID, f"more than {most} bytes of output")
            if not made.eof:
                return bzip2.decompress(data, most) if len(out) > 1 else (b"".join(out), len(data), CodecError(UNEXPECTED_EOF, "the input ends too early"))
            rest = made.unused_data
    except OSError:
        return bzip2.decompress(data, most)
    return b"".join(out), len(data), None


def _unbrotli(data: bytes, most: int) -> Decoded:
    """What the library read before the end of a stream cut short is right; of other faults the strict decoder knows more."""
    out = bytearray()
    try:
        with pa.CompressedInputStream(pa.BufferReader(data), "brotli") as stream:
            while data and len(out) <= most:
                room = bytearray(min(_PIECE, most + 1 - len(out)))
                if not (n := stream.readinto(room)):
                    return bytes(out), len(data), None
                out += memoryview(room)[:n]
    except (OSError, pa.ArrowException) as e:
        if "Truncated" in str(e):
            out += _before_cut(data, len(out), room)
            if len(out) <= most:
                return bytes(out), len(data), CodecError(UNEXPECTED_EOF, "the input ends too early")
    return brotli.decompress(data, most)


def _before_cut(data: bytes, known: int, room: bytearray) -> bytes:
    """What came into room, zeros before, by the read that failed. The library doesn't say how much that is: it is where room and one of ones agree."""
    other = bytearray(b"\xff" * len(room))
    with pa.CompressedInputStream(pa.BufferReader(data), "brotli") as stream:
        while known:
            known -= len(stream.read(min(known, _PIECE)))
        with contextlib.suppress(OSError, pa.ArrowException):
            stream.readinto(other)
    same = np.frombuffer(room, np.uint8) == np.frombuffer(other, np.uint8)
    return bytes(room[: len(room) if same.all() else int(np.argmin(same))])


def _xz(data: bytes, level: int) -> bytes:
    """From preset 4 on with a dictionary no larger than the data need: setting up a whole one is most of the work on short rows."""
    preset = _level(level, 6)
    if preset < 4:  # small tables of hashes would find other matches there
        return lzma.compress(data, preset=preset)
    size = max(1 << 12, 1 << max(0, len(data) - 1).bit_length())
    return lzma.compress(data, filters=[{"id": lzma.FILTER_LZMA2, "preset": preset, "dict_size": min(size, _XZ_DICTIONARY[preset])}])


def _unxz(data: bytes, most: int) -> Decoded:
    made = lzma.LZMADecompressor()
    try:
        out = made.decompress(data, most + 1)
    except lzma.LZMAError as e:
        return b"", 0, CodecError(CORRUPTED, str(e))
    if len(out) > most:
        return out[:most], len(data), CodecError(INVALID, f"more than {most} bytes of output")
    return (out, len(data) - len(made.unused_data), None) if made.eof else (out, len(data), CodecError(UNEXPECTED_EOF, "the input ends too early"))


def _unzstd(data: bytes, most: int) -> Decoded:
    """A step of the input inflates to 32 MB at most, as a block takes four bytes and gives 128 KB; so does what is held beyond the limit."""
    made, out, at = zstandard.ZstdDecompressor().decompressobj(), bytearray(), 0
    try:
        while at < len(data) and not made.eof and len(out) <= most:
            out += made.decompress(data[at : at + _STEP])
            at += _STEP
    except zstandard.ZstdError as e:
        return bytes(out[:most]), min(at, len(data)), CodecError(CORRUPTED, str(e))
    used = min(at, len(data)) - len(made.unused_data)
    if len(out) > most:
        return bytes(out[:most]), used, CodecError(INVALID, f"more than {most} bytes of output")
    return (bytes(out), used, None) if made.eof else (bytes(out), len(data), CodecError(UNEXPECTED_EOF, "the input ends too early"))


register(Codec("deflate/c", "deflate", 0, _deflate, _inflate))
register(Codec("deflate/strict", "deflate", 1, None, deflate.inflate))
register(Codec("bzip2/c", "bzip2", 0, lambda data, level: bz2.compress(data, _level(level, 6)), _bunzip2))
register(Codec("bzip2/strict", "bzip2", 1, lambda data, level: bzip2.encode(data, _level(level, 6)), bzip2.decompress))
register(Codec("brotli/c", "brotli", 0, lambda data, level: pa.Codec("brotli", _level(level, 6)).compress(data, asbytes=True), _unbrotli))
register(Codec("brotli/strict", "brotli", 1, None, brotli.decompress))
register(Codec("xz/c", "xz", 0, _xz, _unxz))
register(Codec("zstd/c", "zstd", 0, lambda data, level: zstandard.ZstdCompressor(level=_level(level, 3)).compress(data), _unzstd))
register(Codec("chunked/own", "chunked", 0, lambda data, level: container.pack(data, level=level), container.decompress))
#: A chunked stream is a DEFLATE stream too.
register(Codec("chunked/inflate", "chunked", 1, None, _inflate))


def decoded(used: Codec, column: pa.Array, most: int) -> pa.Array:
    """The results of a batch, its child arrays built apart: raw bytes are copied once."""
    raws, ins, outs, faults, gone = [], [], [], [], []
    for data in column.to_pylist():
        raw, consumed, fault = (None, None, None) if data is None else used.decode(data, most)
        raws.append(raw)
        ins.append(consumed)
        outs.append(None if raw is None else len(raw))
        faults.append(fault.row(used.format) if fault else None)
        gone.append(data is None)
    children = [pa.array(x, f.type) for x, f in zip((raws, ins, outs, faults), _RESULT, strict=True)]
    return pa.StructArray.from_arrays(children, fields=list(_RESULT), mask=pa.array(gone, pa.bool_()))


def slices(column: pa.Array, size: int = _SLICE) -> Iterator[pa.Array]:
    """A column in pieces of about size bytes, of a row at least."""
    if pa.types.is_binary(column.type) or pa.types.is_string(column.type):
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    else:
        ends = np.arange(1, len(column) + 1) * (column.nbytes / max(1, len(column)))
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield column.slice(at, stop - at)
        at = stop


def in_slices(function: Callable[[pa.Array], pa.Array], kind: str, bare: bool = False) -> Callable[[Column], Column]:
    """An Arrow function of one column, applied to slices of each batch: what is made of a slice goes out before the next is taken.

    Behind the last, memory goes back to the machine, as Python workers outlive their tasks. Its argument isn't bare, as Spark
    evaluates a function of a function's result together with it, and the inner one again for each that uses it. bare: for SQL's registry.
    """

    @F.arrow_udf(kind)
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            for part in slices(column):
                yield function(part)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)

    return run if bare else lambda column: run(F.when(column.isNotNull(), column))


def encode(data: Column, name: str, level: int = 0) -> Column:
    """A binary column compressed. Null stays null; a level that the codec doesn't have is an error at once."""
    used = codec(name)
    if used.encode is None:
        raise CodecError(INVALID, f"{used.name} has no encoder")
    used.encode(b"", level)

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else used.encode(x, level) for x in column.to_pylist()], pa.binary())

    return in_slices(run, "binary")(data.cast("binary"))


def decode(data: Column, name: str, most: int = MOST) -> Column:
    """A binary column decompressed to struct(raw, in_offset, out_offset, err). Null stays null; raw holds what came before a fault."""
    used = codec(name)
    if used.decode is None:
        raise CodecError(INVALID, f"{used.name} has no decoder")

    return in_slices(lambda column: decoded(used, column, most), RESULT)(data.cast("binary"))


def transform(data: Column, function: Callable[[bytes], object], kind: str) -> Column:
    """A function of byte strings over a binary column, a batch at a time. Null stays null."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_type(_parse_datatype_string(kind))

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else function(x) for x in column.to_pylist()], target)

    return in_slices(run, kind)(data.cast("binary"))


def register_sql(spark) -> None:
    """Makes every codec a SQL function: deflate_encode(binary), deflate_decode(binary) and so on, named by format, the first maker of each."""
    for kind in sorted({c.format for c in codecs()}):
        used = codec(kind)
        if used.encode:
            spark.udf.register(f"{kind}_encode", in_slices(lambda column, used=used: pa.array([None if x is None else used.encode(x, 0) for x in column.to_pylist()], pa.binary()), "binary", bare=True))
        if used.decode:
            spark.udf.register(f"{kind}_decode", in_slices(lambda column, used=used: decoded(used, column, MOST), RESULT, bare=True))
