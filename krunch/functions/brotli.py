"""Brotli (RFC 7932), decoded strictly: the output before a fault, the place of the fault, and its class."""

from __future__ import annotations

from . import brotli_tables as T
from . import lz
from .bitstream import BitReader, PrefixCode
from .errors import CodecError, corrupted

#: Order in which code length codes are sent.
_ORDER = (1, 2, 3, 4, 0, 5, 17, 6, 16, 7, 8, 9, 10, 11, 12, 13, 14, 15)


def _length_code(bits: BitReader) -> int:
    """Codes of code lengths are written most significant bit first in their fixed code: 0, 4 and 3 have two bits, 2 three, 1 and 5 four."""
    low = bits.read(2)
    if low != 3:
        return (0, 4, 3)[low]
    return (5 if bits.read(1) else 1) if bits.read(1) else 2


def _window(bits: BitReader) -> int:
    if not bits.read(1):
        return 16
    if n := bits.read(3):
        return 17 + n
    n = bits.read(3)
    if n == 1:
        raise corrupted("reserved window size")
    return 8 + n if n else 17


def _count(bits: BitReader) -> int:
    """1 to 256."""
    if not bits.read(1):
        return 1
    n = bits.read(3)
    return 1 + (1 << n) + bits.read(n)


def _prefix_code(bits: BitReader, alphabet: int) -> PrefixCode:
    skip = bits.read(2)
    if skip == 1:
        count = bits.read(2) + 1
        width = (alphabet - 1).bit_length()
        symbols = [bits.read(width) for _ in range(count)]
        tree = count == 4 and bits.read(1)
        if max(symbols) >= alphabet or len(set(symbols)) < count:
            raise corrupted("invalid simple prefix code")
        lengths = {1: [0], 2: [1, 1], 3: [1, 2, 2], 4: [1, 2, 3, 3] if tree else [2, 2, 2, 2]}[count]
        return PrefixCode(dict(zip(symbols, lengths, strict=True)), zero=True)
    lengths, space = {}, 32
    for symbol in _ORDER[skip:]:
        if n := _length_code(bits):
            lengths[symbol] = n
            space -= 32 >> n
            if space <= 0:
                break
    if not lengths or (space and len(lengths) > 1):
        raise corrupted("invalid code of code lengths")
    code = PrefixCode({next(iter(lengths)): 0} if len(lengths) == 1 else lengths, zero=len(lengths) == 1)
    found: list[int] = []
    space, last, repeated, run = 32768, 8, 0, 0
    while len(found) < alphabet and space > 0:
        n = code.read(bits)
        if n < 16:
            found.append(n)
            if n:
                last = n
                space -= 32768 >> n
            repeated = run = 0
            continue
        if n != repeated:
            repeated, run = n, 0
        more = bits.read(n - 14) + 3
        total = ((run - 2) << (n - 14)) + more if run else more
        found += [last if n == 16 else 0] * (total - run)
        if n == 16:
            space -= (total - run) * (32768 >> last)
        run = total
        if len(found) > alphabet:
            raise corrupted("more code lengths than the alphabet has")
    if space or sum(1 for n in found if n) < 2:
        raise corrupted("the prefix code isn't complete")
    return PrefixCode(dict(enumerate(found)))


class _Switch:
    """Block types of one kind: which is current, and how many symbols are left of it."""

    def __init__(self, bits: BitReader):
        self.bits, self.types, self.now, self.before, self.left = bits, _count(bits), 0, 1, 1 << 24
        if self.types > 1:
            self.type_code, self.length_code = _prefix_code(bits, self.types + 2), _prefix_code(bits, 26)
            self.left = self._length()

    def _length(self) -> int:
        symbol = self.length_code.read(self.bits)
        return T.BLOCK_BASE[symbol] + self.bits.read(T.BLOCK_BITS[symbol])

    def step(self) -> int:
        if not self.left:
            symbol = self.type_code.read(self.bits)
            new = symbol - 2 if symbol > 1 else self.before if symbol == 0 else (self.now + 1) % self.types
            self.before, self.now, self.left = self.now, new, self._length()
        self.left -= 1
        return self.now


def _context_map(bits: BitReader, size: int) -> tuple[int, list[int]]:
    trees = _count(bits)
    if trees == 1:
        return 1, [0] * size
    runs = bits.read(4) + 1 if bits.read(1) else 0
    code, out = _prefix_code(bits, trees + runs), []
    while len(out) < size:
        symbol = code.read(bits)
        if 0 < symbol <= runs:
            out += [0] * ((1 << symbol) + bits.read(symbol))
        else:
            out.append(symbol - runs if symbol else 0)
    if len(out) > size:
        raise corrupted("context map too long")
    if bits.read(1):
        order = list(range(256))
        for k, place in enumerate(out):
            order.insert(0, order.pop(place))
            out[k] = order[0]
    return trees, out


def _commands(bits: BitReader, out: bytearray, length: int, window: int, ring: list[int]) -> None:
    literal, command, distance = _Switch(bits), _Switch(bits), _Switch(bits)
    postfix = bits.read(2)
    direct = bits.read(4) << postfix
    modes = [bits.read(2) for _ in range(literal.types)]
    literal_trees, literal_map = _context_map(bits, 64 * literal.types)
    distance_trees, distance_map = _context_map(bits, 4 * distance.types)
    literal_codes = [_prefix_code(bits, 256) for _ in range(literal_trees)]
    command_codes = [_prefix_code(bits, 704) for _ in range(command.types)]
    distance_codes = [_prefix_code(bits, 16 + direct + (48 << postfix)) for _ in range(distance_trees)]
    end = len(out) + length
    while len(out) < end:
        symbol = command_codes[command.step()].read(bits)
        i, c = T.insert_copy(symbol)
        insert, copy = T.INSERT_BASE[i] + bits.read(T.INSERT_BITS[i]), T.COPY_BASE[c] + bits.read(T.COPY_BITS[c])
        if len(out) + insert > end:
            raise corrupted("more literals than the block holds")
        for _ in range(insert):
            kind = literal.step()
            last, second = (out[-1] if out else 0), (out[-2] if len(out) > 1 else 0)
            out.append(literal_codes[literal_map[64 * kind + T.literal_context(modes[kind], last, second)]].read(bits))
        if len(out) == end:
            return
        code = 0
        if symbol >= 128:
            code = distance_codes[distance_map[4 * distance.step() + T.distance_context(copy)]].read(bits)
        if code < 16:
            k, add = T.short_distance(code)
            back = ring[-1 - k] + add
            if back <= 0:
                raise corrupted("distance isn't positive")
        elif code < 16 + direct:
            back = code - 15
        else:
            base, n = T.long_distance(code, postfix, direct)
            back = base + (bits.read(n) << postfix)
        history = min(len(out), window)
        if back <= history:
            if len(out) + copy > end:
                raise corrupted("copy beyond the block")
            if code:
                ring.append(back)
                del ring[0]
            lz.copy(out, back, copy)
            continue
        if not 4 <= copy <= 24:
            raise corrupted("no dictionary word of that length")
        word, number = T.dictionary_word(copy, back - history - 1)
        if number >= len(T.TRANSFORMS):
            raise corrupted("no such word transform")
        out += (word := T.transform(word, number))
        if len(out) > end:
            del out[len(out) - len(word) :]
            raise corrupted("dictionary word beyond the block")


def decompress(data: bytes, most: int | None = None) -> tuple[bytes, int, CodecError | None]:
    """(output, bytes consumed, error). What follows the stream isn't touched; padding must be zero."""
    bits, out, ring = BitReader(data), bytearray(), [16, 15, 11, 4]
    try:
        window = (1 << _window(bits)) - 16
        last = 0
        while not last:
            last = bits.read(1)
            if last and bits.read(1):
                break
            nibbles = bits.read(2)
            if nibbles == 3:
                if bits.read(1):
                    raise corrupted("reserved bit")
                size = bits.read(2)
                skip = bits.read(8 * size) + 1 if size else 0
                if size > 1 and skip - 1 < 1 << 8 * (size - 1):
                    raise corrupted("metadata length isn't minimal")
                if bits.align():
                    raise corrupted("non-zero padding")
                if len(bits.take(skip)) < skip:
                    raise CodecError("UNEXPECTED_EOF", "metadata ends too early")
                continue
            length = bits.read(4 * (nibbles + 4))
            if nibbles and not length >> 4 * (nibbles + 3):
                raise corrupted("block length isn't minimal")
            length += 1
            if not last and bits.read(1):
                if bits.align():
                    raise corrupted("non-zero padding")
                found = bits.take(length)
                out += found
                if len(found) < length:
                    raise CodecError("UNEXPECTED_EOF", "a stored block ends too early")
            else:
                _commands(bits, out, length, window, ring)
            if most is not None and len(out) > most:
                raise CodecError("INVALID", f"more than {most} bytes of output")
        if bits.align():
            raise corrupted("non-zero padding")
    except CodecError as e:
        return bytes(out), bits.offset(), e
    return bytes(out), bits.offset(), None
