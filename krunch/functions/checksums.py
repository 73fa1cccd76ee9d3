"""Checksums and variable-length integers."""

from __future__ import annotations

import zlib

from .bitstream import reverse_bytes
from .errors import UNEXPECTED_EOF, CodecError, corrupted


def crc32_msb(data: bytes, before: int = 0) -> int:
    """CRC-32 most significant bit first, as bzip2 uses it: the usual CRC over bytes reversed, reversed."""
    start = int(f"{before:032b}"[::-1], 2)
    return int(f"{zlib.crc32(reverse_bytes(data), start):032b}"[::-1], 2)


def fold_crc(total: int, block: int) -> int:
    """A stream's checksum, with one more block."""
    return ((total << 1 | total >> 31) & 0xFFFFFFFF) ^ block


def put_uvarint(value: int) -> bytes:
    """Seven bits a byte, least significant first; the high bit says that more follow."""
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def get_uvarint(data: bytes, at: int) -> tuple[int, int]:
    """(value, place behind it). Values beyond 63 bits are corrupted."""
    value = shift = 0
    while True:
        if at >= len(data):
            raise CodecError(UNEXPECTED_EOF, "an integer ends too early")
        value |= (data[at] & 0x7F) << shift
        shift, more, at = shift + 7, data[at] & 0x80, at + 1
        if not more:
            break
        if shift > 63:
            raise corrupted("integer too large")
    if value >> 63:
        raise corrupted("integer too large")
    return value, at
