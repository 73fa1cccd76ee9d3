"""DEFLATE (RFC 1951), decoded strictly: the output before a fault, the place of the fault, and its class."""

from __future__ import annotations

from itertools import accumulate

from . import lz
from .bitstream import BitReader, PrefixCode
from .errors import UNEXPECTED_EOF, CodecError, corrupted

#: Fixed values of the format: order of code length codes; extra bits of length symbols 257.. and distance symbols 0..
LENGTH_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)
LENGTH_BITS = (0,) * 8 + tuple(k for k in range(1, 6) for _ in range(4))
DISTANCE_BITS = (0, 0) + tuple(k for k in range(14) for _ in range(2))
LENGTH_BASE = tuple(accumulate((1 << b for b in LENGTH_BITS), initial=3))[:28] + (258,)
LENGTH_BITS = LENGTH_BITS[:28] + (0,)
DISTANCE_BASE = tuple(accumulate((1 << b for b in DISTANCE_BITS), initial=1))[:30]


def _fixed() -> tuple[PrefixCode, PrefixCode]:
    lengths = {k: 8 if k < 144 else 9 if k < 256 else 7 if k < 280 else 8 for k in range(288)}
    return PrefixCode(lengths), PrefixCode({k: 5 for k in range(32)})


_FIXED = _fixed()


def _tables(bits: BitReader) -> tuple[PrefixCode, PrefixCode]:
    literals, distances, count = bits.read(5) + 257, bits.read(5) + 1, bits.read(4) + 4
    if literals > 286 or distances > 30:
        raise corrupted("too many symbols")
    lengths = {LENGTH_ORDER[k]: bits.read(3) for k in range(count)}
    if not any(lengths.values()):
        raise corrupted("no code lengths")
    code = PrefixCode(lengths, single=True)
    found: list[int] = []
    while len(found) < literals + distances:
        symbol = code.read(bits)
        if symbol < 16:
            found.append(symbol)
        elif symbol == 16:
            if not found:
                raise corrupted("nothing to repeat")
            found += [found[-1]] * (bits.read(2) + 3)
        else:
            found += [0] * (bits.read(3) + 3 if symbol == 17 else bits.read(7) + 11)
    if len(found) > literals + distances:
        raise corrupted("more code lengths than the header announced")
    return PrefixCode(dict(enumerate(found[:literals])), single=True), PrefixCode(dict(enumerate(found[literals:])), single=True)


def inflate(data: bytes, most: int | None = None) -> tuple[bytes, int, CodecError | None]:
    """(output, bytes consumed, error). What follows the last block isn't touched. most: an output limit, beyond which the row is invalid."""
    bits, out = BitReader(data), bytearray()
    try:
        last = 0
        while not last:
            last, kind = bits.read(1), bits.read(2)
            if kind == 0:
                bits.align()
                size, check = bits.read(16), bits.read(16)
                if size ^ check != 0xFFFF:
                    raise corrupted("the size of a stored block doesn't match its check")
                out += (found := bits.take(size))
                if len(found) < size:
                    raise CodecError(UNEXPECTED_EOF, "a stored block ends too early")
                continue
            if kind == 3:
                raise corrupted("reserved block type")
            literals, distances = _FIXED if kind == 1 else _tables(bits)
            while (symbol := literals.read(bits)) != 256:
                if symbol < 256:
                    out.append(symbol)
                else:
                    if symbol > 285:
                        raise corrupted("invalid length symbol")
                    length = LENGTH_BASE[symbol - 257] + bits.read(LENGTH_BITS[symbol - 257])
                    symbol = distances.read(bits)
                    if symbol > 29:
                        raise corrupted("invalid distance symbol")
                    distance = DISTANCE_BASE[symbol] + bits.read(DISTANCE_BITS[symbol])
                    if distance > 32768:
                        raise corrupted("distance beyond the window")
                    lz.copy(out, distance, length)
                if most is not None and len(out) > most:
                    raise CodecError("INVALID", f"more than {most} bytes of output")
    except CodecError as e:
        return bytes(out), bits.offset(), e
    return bytes(out), bits.offset(), None
