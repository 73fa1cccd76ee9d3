"""The stages of bzip2, each with its inverse, and a strict decoder made of them.

The decoder returns what it decoded before a fault, which C libraries throw away with the block. The encoder puts the same
stages together; its choice of code tables is its own.
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np

from .bitstream import BitReader, BitWriter
from .checksums import crc32_msb, fold_crc
from .errors import CORRUPTED, DEPRECATED, INVALID, UNEXPECTED_EOF, CodecError, corrupted
from .huffman import code_lengths

#: Fixed values of the format.
BLOCK, GROUP, LONGEST_CODE = 100_000, 50, 20
#: Four equal bytes and the count behind them.
_FOUR = re.compile(rb"(.)\1\1\1(.?)", re.S)
BLOCK_MAGIC, END_MAGIC = 0x314159265359, 0x177245385090
#: Up to here plain Python is faster than a dozen calls of numpy.
_SHORT = 48


def rle1_encode(data: bytes, limit: int | None = None) -> tuple[bytes, int, bool]:
    """Runs of 4 to 255 bytes become four bytes and a count. (output, bytes taken, whether limit stopped it)."""
    if limit is None or len(data) <= 2 * limit:
        whole = _rle1_whole(data)
        if limit is None or len(whole) <= limit:
            return whole, len(data), False
    out, taken, room = bytearray(), 0, limit
    for value, run in groupby(data):
        left = sum(1 for _ in run)
        while left:
            part = min(left, 255)
            need = part if part < 4 else 5
            free = room - len(out)
            if need > free:  # as many single bytes as fit; a fourth needs its count too
                fit = min(part, free, 3)
                out += bytes([value]) * fit
                return bytes(out), taken + fit, True
            out += bytes([value]) * min(part, 4)
            if part >= 4:
                out.append(part - 4)
            taken, left = taken + part, left - part
    return bytes(out), taken, False


def _rle1_whole(data: bytes) -> bytes:
    values = np.frombuffer(data, np.uint8)
    if not len(values):
        return b""
    first = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1])
    runs = np.diff(np.append(first, len(values)))
    full, rest = np.divmod(runs, 255)
    sizes = 5 * full + np.where(rest < 4, rest, 5)
    out, ends = np.repeat(values[first], sizes), np.cumsum(sizes)
    counted = rest >= 4
    out[ends[counted] - 1] = rest[counted] - 4
    for start, n in zip((ends - sizes)[full > 0].tolist(), full[full > 0].tolist(), strict=True):
        out[start + 4 : start + 5 * n : 5] = 251
    return out.tobytes()


def rle1_decode(data: bytes) -> tuple[bytes, CodecError | None]:
    """The inverse, for counts up to 255. A run of four at the end without its count is corrupted."""
    fault = None

    def grow(m: re.Match) -> bytes:
        nonlocal fault
        if not m[2]:
            fault = corrupted("four equal bytes end the data; their count is cut off")
            return m[0]
        return m[1] * (4 + m[2][0])

    return _FOUR.sub(grow, data), fault


def rotations(data: bytes) -> np.ndarray:
    """Starts of the rotations of data in order; equal ones by descending start.

    Short ones are sorted as they are. Others are sorted by eight bytes, then by ranks of doubled prefixes, of which each
    round takes only those that still share a rank.
    """
    n = len(data)
    if n <= _SHORT:
        twice = data + data
        return np.array(sorted(range(n - 1, -1, -1), key=[twice[k : k + n] for k in range(n)].__getitem__), np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data + data[:7], np.uint8), 8)
    key, width = np.ascontiguousarray(windows).view(">u8").ravel().astype(np.uint64), 8
    order = np.argsort(key)
    rank, open_ = np.empty(n, np.int64), np.arange(n)
    starts, key = order, key[order]
    while True:
        new = np.empty(len(open_), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        first = np.flatnonzero(new)
        sizes = np.diff(first, append=len(open_))
        rank[starts] = np.repeat(open_[first], sizes)  # the place of the first that is equal so far
        shared = np.repeat(sizes > 1, sizes)
        open_ = open_[shared]
        if not len(open_) or width >= n:
            break
        starts = order[open_]
        key = rank[starts] * n + rank[(starts + width) % n]
        by = np.argsort(key)
        starts, key, width = starts[by], key[by], 2 * width
        order[open_] = starts
    if len(open_):
        starts = order[open_]
        order[open_] = starts[np.lexsort((-starts, rank[starts]))]
    return order


def bwt_encode(data: bytes) -> tuple[bytes, int]:
    """(last column of the sorted rotations, row of the text itself); empty: row -1."""
    if not data:
        return b"", -1
    order = rotations(data)
    return np.frombuffer(data, np.uint8)[order - 1].tobytes(), int(np.flatnonzero(order == 0)[0])


def bwt_decode(last: bytes, row: int) -> bytes:
    if not last:
        return b""
    if not 0 <= row < len(last):
        raise corrupted(f"the text is said to start at row {row} of {len(last)}")
    n = len(last)
    if n <= _SHORT:
        follow, out, at = sorted(range(n), key=last.__getitem__), bytearray(), row
        for _ in range(n):
            at = follow[at]
            out.append(last[at])
        return bytes(out)
    values = np.frombuffer(last, np.uint8)
    step = np.argsort(values, kind="stable")
    places, done = np.empty(n, np.int64), 1
    places[0] = step[row]
    while done < n:  # as many places again as are known, by a step as long as they are
        more = min(done, n - done)
        places[done : done + more] = step[places[:more]]
        done += more
        if done < n:
            step = step[step]
    return values[places].tobytes()


def _zeros(n: int) -> tuple[int, ...]:
    """A run of n zeros: the bits of n + 1 from the lowest on, but the highest."""
    return tuple((n + 1) >> k & 1 for k in range((n + 1).bit_length() - 1))


_ZEROS = [_zeros(n) for n in range(256)]


def mtf_rle2_encode(data: bytes, alphabet: bytes | None = None) -> list[int]:
    """Places in a move-to-front list over the used bytes; runs of n zeros are the bits of n + 1 but its first, as 0 and 1; other places go up by one."""
    order, out = bytearray(alphabet if alphabet is not None else sorted(set(data))), []
    values = np.frombuffer(data, np.uint8)
    if not len(values):
        return out
    first = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
    for value, n in zip(values[first].tolist(), np.diff(first, append=len(values)).tolist(), strict=True):
        place = order.index(value)
        if place:
            del order[place]
            order.insert(0, value)
            out.append(place + 1)
            n -= 1
        # only the first run can begin in front of the list, so no run of zeros goes on
        if n:
            out += _ZEROS[n] if n < len(_ZEROS) else _zeros(n)
    return out


def mtf_rle2_decode(symbols, alphabet: bytes, limit: int = 9 * BLOCK) -> bytes:
    order, out, run, weight = list(alphabet), bytearray(), 0, 1
    for s in [*symbols, None]:
        if s in (0, 1):
            run, weight = run + weight * (s + 1), weight * 2
            if weight > 1 << 24 or len(out) + run > limit:
                raise corrupted("a run is longer than a block may be; check where the data come from")
            continue
        if run:
            if not order:
                raise corrupted("no symbol to repeat")
            out += bytes([order[0]]) * run
            run, weight = 0, 1
        if s is None:
            break
        if s - 1 >= len(order) or len(out) >= limit:
            raise corrupted("a place beyond the list of bytes in use" if s - 1 >= len(order) else "more bytes than the header's level allows")
        order.insert(0, order.pop(s - 1))
        out.append(order[0])
    return bytes(out)


def move_to_front(data: bytes) -> bytes:
    """Places in a move-to-front list that starts as all bytes in order."""
    order, out = list(range(256)), bytearray()
    for value in data:
        place = order.index(value)
        order.insert(0, order.pop(place))
        out.append(place)
    return bytes(out)


def move_to_front_inverse(places) -> bytes:
    order, out = list(range(256)), bytearray()
    for place in places:
        order.insert(0, order.pop(place))
        out.append(order[0])
    return bytes(out)


class LooseCode:
    """A code from lengths that may fit no tree: the format has no rule against it, so only a code without a symbol is a fault.

    Codes of each length follow those of the one before, doubled; what a length has too many of take the places of
    shorter codes' successors, and are met only if no shorter code claims the bits first.
    """

    def __init__(self, lengths: list[int]):
        self.symbols = [s for n in range(1, LONGEST_CODE + 1) for s, m in enumerate(lengths) if m == n]
        self.shortest, self.last, self.shift = min(lengths), {}, {}
        code = before = 0
        for n in range(self.shortest, max(lengths) + 1):
            count = lengths.count(n)
            self.last[n], self.shift[n] = code + count - 1, before - code
            code, before = (code + count) << 1, before + count

    def read(self, bits: BitReader) -> int:
        n = self.shortest
        code = bits.read(n)
        while code > self.last.get(n, -1):
            n += 1
            if n not in self.last:
                raise corrupted("bits that no code of this table begins with")
            code = code << 1 | bits.read(1)
        at = code + self.shift[n]
        if not 0 <= at < len(self.symbols):
            raise corrupted("bits that no code of this table begins with")
        return self.symbols[at]


def _code_lengths(bits: BitReader, count: int) -> list[int]:
    n, out = bits.read(5), []
    for _ in range(count):
        while True:
            if not 1 <= n <= LONGEST_CODE:
                raise corrupted(f"a code of {n} bits; 1 to {LONGEST_CODE} are possible")
            if not bits.read(1):
                break
            n += -1 if bits.read(1) else 1
        out.append(n)
    return out


def _symbols(bits: BitReader, used: int, limit: int) -> list[int]:
    count = used + 2
    if count < 3:
        raise corrupted("the block says that no byte is in use")
    trees = bits.read(3)
    if not 2 <= trees <= 6:
        raise corrupted(f"{trees} code tables; 2 to 6 are possible")
    order, chosen = list(range(trees)), []
    for _ in range(bits.read(15)):
        place = 0
        while place < 6 and bits.read(1):
            place += 1
        if place >= trees:
            raise corrupted(f"group {len(chosen)} asks for table {place} of {trees}")
        order.insert(0, order.pop(place))
        chosen.append(order[0])
    codes = [LooseCode(_code_lengths(bits, count)) for _ in range(trees)]
    out: list[int] = []
    for tree in chosen:
        for _ in range(GROUP):
            symbol = codes[tree].read(bits)
            if symbol == count - 1:
                return out
            if len(out) >= limit:
                raise corrupted("the block goes on beyond its level's size")
            out.append(symbol)
    raise corrupted("the block's end mark is missing behind its last group")


def _block(bits: BitReader, level: int) -> bytes:
    if bits.read(1):
        raise CodecError(DEPRECATED, "written by a release before 0.9.5, which shuffled blocks; recode it with that")
    row, used = bits.read(24), bytearray()
    high = bits.read(16)
    for k in range(16):
        if high >> (15 - k) & 1:
            low = bits.read(16)
            used += bytes(16 * k + j for j in range(16) if low >> (15 - j) & 1)
    last = mtf_rle2_decode(_symbols(bits, len(used), level * BLOCK), bytes(used), level * BLOCK)
    if row >= len(last):
        raise corrupted(f"the text is said to start at row {row} of {len(last)}")
    return bwt_decode(last, row)


def decompress(data: bytes, most: int | None = None) -> tuple[bytes, int, CodecError | None]:
    """(output, bytes consumed, error) of concatenated streams. most: an output limit, beyond which the row is invalid."""
    bits, out = BitReader(data, big=True), bytearray()
    try:
        streams = 0
        while not (streams and bits.done()):
            if bits.done():
                raise CodecError(UNEXPECTED_EOF, "no stream")
            if bits.read(16) != int.from_bytes(b"BZ", "big"):
                raise corrupted("this isn't bzip2: it should begin with BZ")
            if (version := bits.read(8)) != ord("h"):
                raise CodecError(DEPRECATED if version == ord("0") else CORRUPTED, "the older bzip wrote this; recode it with that" if version == ord("0") else f"version byte {version} is unknown")
            level = bits.read(8) - ord("0")
            if not 1 <= level <= 9:
                raise corrupted(f"level {level}; 1 to 9 are possible")
            total = 0
            while (magic := bits.read(32) << 16 | bits.read(16)) == BLOCK_MAGIC:
                want = bits.read(32)
                block, fault = rle1_decode(_block(bits, level))
                out += block
                if fault:
                    raise fault
                if crc32_msb(block) != want:
                    raise corrupted("a block was read, but its CRC differs: some bit of it has flipped")
                total = fold_crc(total, want)
                if most is not None and len(out) > most:
                    raise CodecError("INVALID", f"more than {most} bytes of output")
            if magic != END_MAGIC:
                raise corrupted("neither a block nor the end of the stream begins here")
            if bits.read(32) != total:
                raise corrupted("all blocks are right, but not all of them are here in order")
            bits.align()
            streams += 1
    except CodecError as e:
        return bytes(out), bits.offset(), e
    return bytes(out), bits.offset(), None


#: Code tables by the number of groups of symbols, the longest code written, and how often tables and groups are fitted to each other.
_TABLES, _LONGEST_WRITTEN, _ROUNDS = ((4, 2), (12, 3), (24, 4), (48, 5)), 17, 4


def _fit(symbols: np.ndarray, size: int) -> tuple[list[list[int]], np.ndarray]:
    """Code lengths of each table, and the table of each group of 50 symbols.

    The tables start as equal shares of all symbols by number; then each group takes the table that codes it
    shortest, and each table the lengths that suit its groups, in turn.
    """
    groups = -(-len(symbols) // GROUP)
    counts = np.bincount(np.arange(len(symbols)) // GROUP * size + symbols, minlength=groups * size).reshape(groups, size)
    tables = next((n for most, n in _TABLES if groups < most), 6)
    share = np.cumsum(counts.sum(0)) * tables // (len(symbols) + 1)
    lengths = np.where(share == np.arange(tables)[:, None], 1, _LONGEST_WRITTEN)
    before = None
    for _ in range(_ROUNDS):
        chosen = np.argmin(counts @ lengths.T, axis=1)
        if before is not None and np.array_equal(chosen, before):  # so it stays
            break
        before = chosen
        lengths = np.array([code_lengths(counts[chosen == t].sum(0).tolist(), _LONGEST_WRITTEN) for t in range(tables)])
    return lengths.tolist(), np.argmin(counts @ lengths.T, axis=1)


def _values(lengths: list[int]) -> list[int]:
    out, code, last = [0] * len(lengths), 0, 0
    for n, symbol in sorted((n, s) for s, n in enumerate(lengths)):
        code <<= n - last
        out[symbol], code, last = code, code + 1, n
    return out


def _write_block(bits: BitWriter, block: bytes) -> None:
    last, row = bwt_encode(block)
    used = sorted(set(block))
    symbols = np.array([*mtf_rle2_encode(last, bytes(used)), len(used) + 1])
    bits.write(0, 1)
    bits.write(row, 24)
    bits.write(sum(1 << (15 - k) for k in {v >> 4 for v in used}), 16)
    for k in sorted({v >> 4 for v in used}):
        bits.write(sum(1 << (15 - (v & 15)) for v in used if v >> 4 == k), 16)
    lengths, chosen = _fit(symbols, len(used) + 2)
    bits.write(len(lengths), 3)
    bits.write(len(chosen), 15)
    order, rest = list(range(len(lengths))), []
    for t in chosen.tolist():
        place = order.index(t)
        order.insert(0, order.pop(place))
        rest.append("1" * place + "0")
    for table in lengths:
        rest.append(f"{table[0]:05b}")
        rest += [("10" * (n - now) if n > now else "11" * (now - n)) + "0" for now, n in zip([table[0], *table], table)]
    codes = [[f"{value:0{n}b}" for value, n in zip(_values(table), table, strict=True)] for table in lengths]
    listed = symbols.tolist()
    for k, t in enumerate(chosen.tolist()):
        rest += map(codes[t].__getitem__, listed[k * GROUP : (k + 1) * GROUP])
    text = "".join(rest)
    bits.write(int(text, 2), len(text))


def encode(data: bytes, level: int = 6) -> bytes:
    """One stream, of blocks of at most level times 100,000 bytes after the first run lengths. Empty data make a stream without a block."""
    if not 1 <= level <= 9:
        raise CodecError(INVALID, f"level {level}; 1 to 9 are possible")
    bits, total, at = BitWriter(big=True), 0, 0
    bits.write(int.from_bytes(b"BZh%d" % level, "big"), 32)
    while at < len(data):
        # five bytes can stand for 255
        block, taken, _ = rle1_encode(data[at : at + 51 * level * BLOCK], level * BLOCK)
        crc = crc32_msb(data[at : at + taken])
        bits.write(BLOCK_MAGIC, 48)
        bits.write(crc, 32)
        _write_block(bits, block)
        total, at = fold_crc(total, crc), at + taken
    bits.write(END_MAGIC, 48)
    bits.write(total, 32)
    return bits.bytes()


def mend(data: bytes) -> bytes:
    """A stream of damaged blocks with the CRCs that they decode to, so that faults behind the checksum can be looked for.

    Blocks must decode; only the first stream is looked at. What is no stream comes back as it is.
    """
    bits, out, total = BitReader(data, big=True), bytearray(data), 0

    def put(at: int, value: int) -> None:
        first, last = at >> 3, (at + 39) >> 3
        old = int.from_bytes(out[first:last], "big")
        shift = 8 * (last - first) - (at & 7) - 32
        out[first:last] = (old & ~(0xFFFFFFFF << shift) | value << shift).to_bytes(last - first, "big")

    try:
        level = bits.read(32) & 15
        while (magic := bits.read(32) << 16 | bits.read(16)) == BLOCK_MAGIC:
            at = bits.at
            bits.read(32)
            crc = crc32_msb(rle1_decode(_block(bits, level))[0])
            put(at, crc)
            total = fold_crc(total, crc)
        if magic == END_MAGIC:
            at = bits.at
            bits.read(32)
            put(at, total)
    except CodecError:
        pass
    return bytes(out)
