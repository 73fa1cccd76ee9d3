"""Chunked DEFLATE: a stream of independently compressed chunks with an index of them, still readable by any inflater.

Chunks end in a sync marker. An index holds the compressed and raw sizes of the chunks since the last one and how far back
that one is; it and the footer are written as meta blocks, which inflate to nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from . import deflate, meta
from .checksums import get_uvarint, put_uvarint
from .errors import CLOSED, CORRUPTED, INVALID, UNEXPECTED_EOF, CodecError, corrupted

#: What ends a raw DEFLATE stream, a sync marker, the footer's magic.
END_BLOCK, SYNC, FOOTER = b"\x01\x00\x00\xff\xff", b"\x00\x00\xff\xff", b"XF\x00"
DEFAULT_CHUNK, DEFAULT_INDEX, DEFAULT_LEVEL = 1 << 18, 1 << 12, 6
UNKNOWN, DEFLATE, INDEX, END = 0, 1, 2, 3
#: At most so many bytes hold the footer.
TAIL = 64


def zlib_level(level: int) -> int:
    """0 is the default, -1 is stored, 1 to 9 as usual."""
    if not -1 <= level <= 9:
        raise CodecError(INVALID, f"level {level}")
    return DEFAULT_LEVEL if level == 0 else 0 if level == -1 else level


def compress_chunk(data: bytes, level: int = 0) -> bytes:
    """A chunk by itself: its own history, a sync marker at the end."""
    made = zlib.compressobj(zlib_level(level), zlib.DEFLATED, -15)
    return made.compress(data) + made.flush(zlib.Z_SYNC_FLUSH)


def _inflate(comp: bytes, raw_size: int | None, strict: bool) -> tuple[bytes, CodecError | None]:
    """What a chunk inflates to, and what is wrong with it."""
    made = zlib.decompressobj(-15)
    try:
        out = made.decompress(comp + END_BLOCK) + made.flush()
    except zlib.error:
        out, _, fault = deflate.inflate(comp + END_BLOCK)
        return out, fault or corrupted("not a chunk")
    if comp[-4:] != SYNC:
        return out, corrupted("no sync marker at the end of a chunk")
    if strict and (not made.eof or made.unused_data):
        return out, corrupted("a chunk doesn't end where it should")
    if raw_size is not None and len(out) != raw_size:
        return out, corrupted("mismatching chunk size")
    return out, None


def inflate_chunk(comp: bytes, raw_size: int | None = None, strict: bool = True) -> bytes:
    """The chunk's bytes; checks the sync marker and, where given, the size. strict: the chunk must not end the stream itself."""
    out, fault = _inflate(comp, raw_size, strict)
    if fault:
        raise fault
    return out


def encode_index(sizes: list[tuple[int, int]], back: int) -> bytes:
    """(compressed, raw) sizes and the size of the index before, or 0, as meta blocks."""
    numbers = [back, len(sizes), sum(c for c, _ in sizes), sum(r for _, r in sizes), *(x for pair in sizes for x in pair)]
    body = b"".join(map(put_uvarint, numbers))
    return meta.encode(body + zlib.crc32(body).to_bytes(4, "little"), meta.META)


def encode_footer(back: int) -> bytes:
    return meta.encode(FOOTER + put_uvarint(back), meta.STREAM)


@dataclass
class Writer:
    """Puts a stream together from compressed chunks. index_size: records after which an index is written by itself; below 0 never, 0 default."""

    index_size: int = 0
    out: bytearray = field(default_factory=bytearray)
    pending: list[tuple[int, int]] = field(default_factory=list)
    back: int = 0

    def chunk(self, comp: bytes, raw_size: int) -> None:
        self.out += comp
        self.pending.append((len(comp), raw_size))
        limit = DEFAULT_INDEX if self.index_size == 0 else self.index_size
        if 0 < limit <= len(self.pending):
            self.index()

    def index(self) -> None:
        found = encode_index(self.pending, self.back)
        self.out += found
        self.back, self.pending = len(found), []

    def close(self) -> bytes:
        if self.pending:
            self.index()
        self.out += encode_footer(self.back)
        return bytes(self.out)


def pack(data: bytes, chunk_size: int = 0, index_size: int = 0, level: int = 0) -> bytes:
    """A whole stream. chunk_size 0: 256 KiB; below 0 is invalid."""
    if chunk_size < 0:
        raise CodecError(INVALID, f"chunk size {chunk_size}")
    size, made = chunk_size or DEFAULT_CHUNK, Writer(index_size)
    for at in range(0, len(data), size):
        made.chunk(compress_chunk(data[at : at + size], level), len(data[at : at + size]))
    return made.close()


EMPTY_BLOCK = b"\x00" + SYNC
FLUSH_SYNC, FLUSH_FULL, FLUSH_INDEX = "SYNC", "FULL", "INDEX"


class StreamWriter:
    """A container written as data arrives. Chunks end at chunk_size raw bytes, when the next byte comes, or when flushed.

    flush: SYNC lets a reader have all so far and keeps the history; FULL ends the chunk; INDEX also writes the index.
    """

    def __init__(self, chunk_size: int = 0, index_size: int = 0, level: int = 0):
        if chunk_size < 0:
            raise CodecError(INVALID, f"chunk size {chunk_size}")
        self.chunk_size, self.level, self.closed = chunk_size or DEFAULT_CHUNK, zlib_level(level), False
        self.made = Writer(index_size)
        self._begin()

    def _begin(self) -> None:
        self.part, self.held, self.raw = zlib.compressobj(self.level, zlib.DEFLATED, -15), bytearray(), 0

    def _open(self) -> None:
        if self.closed:
            raise CodecError(CLOSED, "the stream is closed")

    def write(self, data: bytes) -> None:
        self._open()
        while data:
            room = self.chunk_size - self.raw
            if not room:
                self.flush(FLUSH_FULL)
                continue
            self.held += self.part.compress(data[:room])
            self.raw += len(data[:room])
            data = data[room:]

    def flush(self, mode: str) -> None:
        self._open()
        if mode == FLUSH_INDEX:
            if self.raw or self.held:
                self.flush(FLUSH_FULL)
            self.made.index()
        elif mode in (FLUSH_SYNC, FLUSH_FULL):
            self.held += self.part.flush(zlib.Z_SYNC_FLUSH) or EMPTY_BLOCK
            if mode == FLUSH_FULL:
                held, raw = bytes(self.held), self.raw
                self._begin()
                self.made.chunk(held, raw)
        else:
            raise CodecError(INVALID, f"flush mode {mode}")

    def close(self) -> bytes:
        """Ends the stream and returns all of it; again, the same."""
        if not self.closed:
            if self.raw or self.held or self.made.pending:
                self.flush(FLUSH_INDEX)
            self.closed = True
            self.whole = self.made.close()
        return self.whole


def decode_footer(tail: bytes, size: int) -> tuple[int, int]:
    """(place of the footer, size of the last index), from the last bytes of a stream of some size."""
    at = meta.reverse_search(tail)
    if at < 0:
        raise corrupted("no footer")
    try:
        body, final, end = meta.decode(tail, at)
    except CodecError as e:
        raise corrupted(e.msg) from e
    if final != meta.STREAM or end != len(tail) or body[:3] != FOOTER:
        raise corrupted("invalid footer")
    try:
        back, place = get_uvarint(body, 3)
    except CodecError as e:
        raise corrupted(e.msg) from e
    if place != len(body):
        raise corrupted("invalid footer")
    return size - len(tail) + at, back


def decode_index(data: bytes) -> tuple[list[tuple[int, int]], int]:
    """(sizes, size of the index before) of an index."""
    try:
        body, final, stop = meta.decode(data)
        if final != meta.META or stop != len(data) or len(body) < 4:
            raise corrupted("invalid index")
        if zlib.crc32(body[:-4]) != int.from_bytes(body[-4:], "little"):
            raise corrupted("mismatching index checksum")
        numbers, at = [], 0
        while at < len(body) - 4:
            value, at = get_uvarint(body[:-4], at)
            numbers.append(value)
    except CodecError as e:
        if e.code == UNEXPECTED_EOF:
            raise CodecError(CORRUPTED, e.msg) from e
        raise
    if len(numbers) < 4 or len(numbers) != 4 + 2 * numbers[1]:
        raise corrupted("invalid index")
    back, _, comp, raw = numbers[:4]
    sizes = list(zip(numbers[4::2], numbers[5::2], strict=True))
    if any(c <= 4 for c, _ in sizes) or sum(c for c, _ in sizes) != comp or sum(r for _, r in sizes) != raw:
        raise corrupted("index sizes don't add up")
    return sizes, back


@dataclass(frozen=True)
class Record:
    """Where a part of a stream ends."""

    comp_end: int
    raw_end: int
    type: int


def read_index(data: bytes) -> list[Record]:
    """Records of all chunks, indexes and the footer, from the stream's own indexes."""
    return open_index(lambda start, end: data[start:end], len(data))


def open_index(read: Callable[[int, int], bytes], size: int) -> list[Record]:
    """The same of a stream of which only its footer and its indexes are read, from the last to the first."""
    footer, back = decode_footer(read(max(0, size - TAIL), size), size)
    parts, end = [], footer
    while True:
        start = end - back
        if start < 0 or (not back and end):
            raise corrupted("indexes don't reach the start")
        if not back:
            break
        sizes, before = decode_index(read(start, end))
        first = start - sum(c for c, _ in sizes)
        if first < 0:
            raise corrupted("indexes don't reach the start")
        parts.append((sizes, back))
        end, back = first, before
    out, comp, raw = [], 0, 0
    for sizes, own in reversed(parts):
        for c, r in sizes:
            comp, raw = comp + c, raw + r
            out.append(Record(comp, raw, DEFLATE))
        comp += own
        out.append(Record(comp, raw, INDEX))
    out.append(Record(size, raw, END))
    return out


def append_record(records: list[Record], comp_size: int, raw_size: int, kind: int) -> bool:
    """Adds a record behind the last; False, and nothing added, if a size is negative or an end leaves 63 bits."""
    last = records[-1] if records else Record(0, 0, UNKNOWN)
    comp, raw = last.comp_end + comp_size, last.raw_end + raw_size
    if comp_size < 0 or raw_size < 0 or comp >> 63 or raw >> 63:
        return False
    records.append(Record(comp, raw, kind))
    return True


def append_index(records: list[Record], other: list[Record]) -> bool:
    """Adds all of another index behind the last record, or nothing if one doesn't fit."""
    count, before = len(records), Record(0, 0, UNKNOWN)
    for r in other:
        if not append_record(records, r.comp_end - before.comp_end, r.raw_end - before.raw_end, r.type):
            del records[count:]
            return False
        before = r
    return True


def search(records: list[Record], offset: int) -> int:
    """Number of records that end at or before a raw offset: the record that holds it, or one past the end."""
    low, high = 0, len(records)
    while low < high:
        middle = (low + high) // 2
        if records[middle].raw_end <= offset:
            low = middle + 1
        else:
            high = middle
    return low


def around(records: list[Record], k: int) -> tuple[Record, Record]:
    """The records before and at k. Past the end both are the last, of unknown type."""
    zero = Record(0, 0, UNKNOWN)
    if k >= len(records):
        last = records[-1] if records else zero
        end = Record(last.comp_end, last.raw_end, UNKNOWN)
        return end, end
    return (records[k - 1] if k else zero), records[k]


START, CURRENT, FINISH = 0, 1, 2


def seek(position: int, size: int, offset: int, whence: int) -> int:
    """A new position from the start, the current one or the end. Beyond the end is fine; before the start is invalid."""
    if whence not in (START, CURRENT, FINISH):
        raise CodecError(INVALID, f"whence {whence}")
    out = offset + (0, position, size)[whence]
    if out < 0:
        raise CodecError(INVALID, "negative position")
    return out


def read_range(data: bytes, offset: int, length: int) -> bytes:
    """Raw bytes from an offset on, inflating only the chunks that hold them. Beyond the end: nothing. Negative: invalid."""
    if offset < 0 or length < 0:
        raise CodecError(INVALID, "negative offset or length")
    records, out = read_index(data), bytearray()
    k = search(records, offset)
    while k < len(records) and len(out) < length:
        before, here = around(records, k)
        if here.type == DEFLATE:
            raw = inflate_chunk(data[before.comp_end : here.comp_end], here.raw_end - before.raw_end)
            skip = max(0, offset - before.raw_end)
            out += raw[skip : skip + length - len(out)]
        k += 1
    return bytes(out)


def decompress(data: bytes, most: int | None = None) -> tuple[bytes, int, CodecError | None]:
    """(output, bytes consumed, error) of a whole stream, chunk by chunk."""
    out, last = bytearray(), Record(0, 0, UNKNOWN)
    try:
        for r in read_index(data):
            if r.type == DEFLATE:
                raw, fault = _inflate(data[last.comp_end : r.comp_end], r.raw_end - last.raw_end, True)
                out += raw
                if fault:
                    raise fault
                if most is not None and len(out) > most:
                    raise CodecError(INVALID, f"more than {most} bytes of output")
            last = r
    except CodecError as e:
        return bytes(out), last.comp_end, e
    return bytes(out), len(data), None
