"""Data hidden in DEFLATE blocks that inflate to nothing: it is written into the Huffman tables of empty dynamic blocks.

A block's 257 literal code lengths are either 0 or one length h, and these zeros and ones carry a byte of flags, up to 31
bytes and fill. 2^h of them are ones, so the code is complete; the last, which ends the block, is one of them.
"""

from __future__ import annotations

import re
from functools import lru_cache

from .bitstream import BitReader
from .errors import INVALID, UNEXPECTED_EOF, CodecError, corrupted

#: Fixed values of the encoding: the first 32 bits of a block and which of them are always so; numbers of symbols; the largest
#: block, and the most bytes that always fit; runs that the code length symbols 16 (last) and 18 (zero) can stand for.
MAGIC, MASK = 0x05860004, 0xFFFE3FC6
SYMBOLS, MOST, ENSURED = 257, 31, 22
LAST_RUN, ZERO_RUN = (3, 6), (11, 138)
NIL, META, STREAM = "NIL", "META", "STREAM"
#: Bits are text here, the first bit first: of each byte; runs of equal symbols; what a symbol or a run is written as; the longest block.
_BITS = [f"{b:08b}"[::-1] for b in range(256)]
_RUNS, _TOKEN, _LONGEST = re.compile("0+|1+"), re.compile("0|10|110(..)|111(.{7})"), 96


def reverse_search(data: bytes) -> int:
    """The last place where a block might begin; -1 if there is none."""
    word = 0
    for at in range(len(data) - 1, -1, -1):
        word = (word << 8 | data[at]) & 0xFFFFFFFF
        if word & MASK == MAGIC:
            return at
    return -1


def code_length(zeros: int, ones: int) -> tuple[int, bool]:
    """The shortest code length that so many bits fit, and whether they are inverted; 0 if none does."""
    inverted = ones > zeros
    if inverted:
        zeros, ones = ones, zeros
    for h in range(1, 8):
        if SYMBOLS - (1 << h) >= zeros + 8 and 1 << h >= ones + 8:
            return h, inverted
    return 0, inverted


def _count(data: bytes) -> tuple[int, int]:
    ones = sum(b.bit_count() for b in data)
    return 8 * len(data) - ones, ones


def encode_block(data: bytes, final: str = NIL) -> bytes:
    h, inverted = code_length(*_count(data))
    if not h or len(data) > MOST:
        raise CodecError(INVALID, "these bytes don't fit one block; call encode(), which splits them")
    codes = 4 + 2 * (8 - h)
    head = MAGIC | (final == STREAM) | (codes - 4) << 13
    # behind the header: lengths of code lengths, and the first symbol, which is always zero
    text = [f"{head:032b}"[::-1], "000" * (codes - 6), "010", "0"]
    flags = (final != NIL) << 1 | inverted << 2 | len(data) << 3
    body = _BITS[flags] + "".join([_BITS[b ^ 0xFF] if inverted else _BITS[b] for b in data])
    ones = (1 << h) - body.count("1")
    body += "0" * (SYMBOLS - len(body) - ones) + "1" * ones
    before = "0"
    for run in _RUNS.findall(body, 1):
        text.append(_run(run[0], len(run), before))
        before = run[0]
    size = sum(map(len, text))
    pads = -(size + 1 + h) % 8
    text.append("0" * (pads + 1) + "1" * h)
    found = bytearray(int("".join(text)[::-1], 2).to_bytes((size + pads + 1 + h) // 8, "little"))
    found[0] |= pads << 3
    return bytes(found)


@lru_cache(4096)
def _run(bit: str, left: int, before: str) -> str:
    """A run of symbols written, behind a symbol that is before."""
    out = []
    while left:
        if bit == "0" and left >= ZERO_RUN[0]:
            n = min(left, ZERO_RUN[1])
            out.append("111" + f"{n - ZERO_RUN[0]:07b}"[::-1])
        elif before == bit and left >= LAST_RUN[0]:
            n = min(left, LAST_RUN[1])
            out.append("110" + f"{n - LAST_RUN[0]:02b}"[::-1])
        else:
            n = 1
            out.append("10" if bit == "1" else "0")
        before, left = bit, left - n
    return "".join(out)


def encode(data: bytes, final: str = META) -> bytes:
    """Blocks as full as they can be, the last of them marked."""
    out, start, zeros, ones = bytearray(), 0, 0, 0
    for k, byte in enumerate(data):
        o = byte.bit_count()
        z = 8 - o
        if k - start >= ENSURED and not (k - start < MOST and code_length(zeros + z, ones + o)[0]):
            out += encode_block(data[start:k])
            start, zeros, ones = k, 0, 0
        zeros, ones = zeros + z, ones + o
    return bytes(out + encode_block(data[start:], final))


def _whole_block(data: bytes, at: int) -> tuple[bytes, str, int] | None:
    """A block that begins with a byte: its data, its mark and the place behind it. None where anything is wrong: decode_block says what."""
    part = data[at : at + _LONGEST]
    magic = int.from_bytes(part[:4], "little")
    codes, pads = 4 + (magic >> 13 & 15), magic >> 3 & 7
    if magic & MASK != MAGIC or codes < 6:
        return None
    text = "".join([_BITS[b] for b in part])
    first, h = 32 + 3 * (codes - 6), 8 - (codes - 4) // 2
    if text[32 : first + 4] != "000" * (codes - 6) + "0100":
        return None
    place, found, count = first + 4, ["0"], 1
    for token in _TOKEN.finditer(text, place):
        if (last := token.group(1)) is not None:
            run = found[-1][-1] * (int(last[::-1], 2) + LAST_RUN[0])
        elif (zeros := token.group(2)) is not None:
            run = "0" * (int(zeros[::-1], 2) + ZERO_RUN[0])
        else:
            run = "1" if token.end() - token.start() == 2 else "0"
        found.append(run)
        count += len(run)
        place = token.end()
        if count >= SYMBOLS:
            break
    body, end = "".join(found), place + pads + 1 + h
    good = count == SYMBOLS and body.count("1") == 1 << h and body[-1] == "1" and "0" * 8 not in text[first + 4 : place]
    if not good or text[place:end] != "0" * (pads + 1) + "1" * h or end % 8:
        return None
    raw = int(body[SYMBOLS - 2 :: -1], 2).to_bytes(SYMBOLS // 8, "little")
    final, inverted, size, stream = raw[0] >> 1 & 1, raw[0] >> 2 & 1, raw[0] >> 3, magic & 1
    if stream and not final:
        return None
    out = raw[1 : 1 + size]
    return (bytes([b ^ 0xFF for b in out]) if inverted else out), (STREAM if stream else META) if final else NIL, at + end // 8


def decode_block(bits: BitReader) -> tuple[bytes, str]:
    if not bits.at % 8 and not bits.big and (whole := _whole_block(bits.data, bits.at // 8)):
        bits.at = 8 * whole[2]
        return whole[:2]
    magic = bits.read(32)
    if magic & MASK != MAGIC:
        raise corrupted("no hidden data begin here")
    codes = 4 + (magic >> 13 & 15)
    header = codes >= 6
    for _ in range(codes - 6):
        header &= not bits.read(3)
    if bits.read(3) != 2 or bits.read(1) or not header:
        raise corrupted("an ordinary DEFLATE block, with a header that hidden data never have")
    h = 8 - (codes - 4) // 2
    found, quiet = [0], 0
    while len(found) < SYMBOLS:
        # a run of eight zero bits must not occur among the symbols, so that the magic value can't
        start = bits.at
        if not bits.read(1):
            run = [0]
        elif not bits.read(1):
            run = [1]
        elif not bits.read(1):
            run = [found[-1]] * (bits.read(2) + LAST_RUN[0])
        else:
            run = [0] * (bits.read(7) + ZERO_RUN[0])
        size, bits.at = bits.at - start, start
        value = bits.read(size)
        for k in range(size):
            quiet = 0 if value >> k & 1 else quiet + 1
            if quiet >= 8 and k == size - 1:
                raise corrupted("eight zero bits in a row, which could be taken for a block's begin")
        found += run
    if len(found) > SYMBOLS:
        raise corrupted("the last run goes beyond the 257 symbols")
    if sum(found) != 1 << h:
        raise corrupted("the code lengths make no complete code")
    if not found[-1]:
        raise corrupted("the symbol that ends the block has no code")
    body = bytes(sum(found[8 * k + j] << j for j in range(8)) for k in range(SYMBOLS // 8))
    flags = body[0]
    final, inverted, size, stream = flags >> 1 & 1, flags >> 2 & 1, flags >> 3, magic & 1
    if stream and not final:
        raise corrupted("the stream is said to end here, but not the hidden data")
    if bits.read(magic >> 3 & 7) or bits.read(1) or bits.read(h) != (1 << h) - 1 or bits.at % 8:
        raise corrupted("something follows the symbols within the block, or it doesn't end with a byte")
    return bytes(b ^ 0xFF if inverted else b for b in body[1 : 1 + size]), (STREAM if stream else META) if final else NIL


def decode(data: bytes, at: int = 0) -> tuple[bytes, str, int]:
    """(data, how the last block is marked, place behind it). Ends at a marked block or the end of the input."""
    bits, out, final = BitReader(data), bytearray(), NIL
    bits.at = 8 * at
    while final == NIL and not bits.done():
        try:
            found, final = decode_block(bits)
        except CodecError as e:
            if e.code == UNEXPECTED_EOF:
                e.msg = "a meta block ends too early"
            raise
        out += found
    return bytes(out), final, bits.offset()
