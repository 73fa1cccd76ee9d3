"""Bits of a byte string, from either end of each byte, and prefix codes over them."""

from __future__ import annotations

from .errors import UNEXPECTED_EOF, CodecError, corrupted

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def reverse_bytes(data: bytes) -> bytes:
    """Each byte with its bits the other way round."""
    return data.translate(_REVERSED)


class BitReader:
    """Reads numbers least significant bit first, as DEFLATE and Brotli pack them; big: most significant first, as bzip2 does."""

    def __init__(self, data: bytes, big: bool = False):
        self.data, self.big, self.at, self.size = data, big, 0, 8 * len(data)

    def offset(self) -> int:
        """Bytes that reading has touched."""
        return -(-self.at // 8)

    def read(self, n: int) -> int:
        end = self.at + n
        if end > self.size:  # nothing of a number that isn't whole is taken
            raise CodecError(UNEXPECTED_EOF, "the input ends too early")
        first, last = self.at >> 3, -(-end // 8)
        if self.big:
            value = int.from_bytes(self.data[first:last], "big") >> (8 * last - end) & ((1 << n) - 1)
        else:
            value = int.from_bytes(self.data[first:last], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at = end
        return value

    def align(self) -> int:
        """Skips to the next byte and returns the bits skipped."""
        return self.read(-self.at % 8)

    def take(self, n: int) -> bytes:
        """Up to n whole bytes from an aligned place."""
        first = self.at >> 3
        out = self.data[first : first + n]
        self.at += 8 * len(out)
        return out

    def done(self) -> bool:
        return self.at >= self.size


class BitWriter:
    """The inverse of BitReader."""

    def __init__(self, big: bool = False):
        self.big, self.out, self.held, self.count = big, bytearray(), 0, 0

    def bits(self) -> int:
        return 8 * len(self.out) + self.count

    def write(self, value: int, n: int) -> None:
        if self.big:
            self.held = self.held << n | value
        else:
            self.held |= value << self.count
        self.count += n
        whole = self.count >> 3
        if whole:
            self.count &= 7
            if self.big:
                self.out += (self.held >> self.count).to_bytes(whole, "big")
                self.held &= (1 << self.count) - 1
            else:
                self.out += (self.held & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
                self.held >>= 8 * whole

    def align(self) -> None:
        if self.count:
            self.write(0, 8 - self.count)

    def bytes(self) -> bytes:
        self.align()
        return bytes(self.out)


class PrefixCode:
    """A canonical code from lengths by symbol (0: unused). Codes are read first bit first, whatever the packing.

    An incomplete or oversubscribed set of lengths is corrupted, but for a single code where single says so: there
    the one symbol has the code 0, and 1 is invalid; of length 0 where zero says so: nothing is read for it.
    """

    def __init__(self, lengths: dict[int, int], single: bool = False, zero: bool = False):
        used = sorted((n, s) for s, n in lengths.items() if n)
        self.only = None
        if zero and len(lengths) == 1:
            self.only = next(iter(lengths))
            return
        space = sum(1 << (32 - n) for n, _ in used)
        if space != 1 << 32 and used and not (single and len(used) == 1):
            raise corrupted("the prefix code isn't complete")
        self.codes: dict[tuple[int, int], int] = {}
        code, last = 0, 0
        for n, symbol in used:
            code <<= n - last
            self.codes[n, code] = symbol
            code, last = code + 1, n
        self.longest = last
        if single and len(used) == 1:
            self.longest = 1

    def read(self, bits: BitReader) -> int:
        if self.only is not None:
            return self.only
        code = 0
        for n in range(1, self.longest + 1):
            code = code << 1 | bits.read(1)
            symbol = self.codes.get((n, code))
            if symbol is not None:
                return symbol
        raise corrupted("invalid prefix code")
