"""Tables of Brotli (RFC 7932), made by rule where they have one."""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import accumulate
from pathlib import Path

#: Extra bits of insert, copy and block lengths, and of run lengths in context maps.
INSERT_BITS = (0, 0, 0, 0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 7, 8, 9, 10, 12, 14, 24)
COPY_BITS = (0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 7, 8, 9, 10, 24)
BLOCK_BITS = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4, 5, 5, 5, 5, 6, 6, 7, 8, 9, 10, 11, 12, 13, 24)
RUN_BITS = tuple(range(1, 17))
#: Bits of word indexes in the static dictionary by word length, and the checksum of the dictionary.
WORD_BITS = (0, 0, 0, 0, 10, 10, 11, 11, 10, 10, 10, 10, 10, 9, 9, 8, 7, 7, 8, 7, 7, 6, 6, 5, 5)
DICTIONARY_SIZE, DICTIONARY_CRC, DICTIONARY_START = 122_784, 0x5136CB04, b"timedownlifeleft"
#: Prefix, operation and suffix of each word transform (RFC 7932, appendix B). Operations: id, first and all
#: (letters to upper-case them), +n and -n (bytes to leave out at the start or end).
TRANSFORMS = (
    (b'', "id", b''),
    (b'', "id", b' '),
    (b' ', "id", b' '),
    (b'', "+1", b''),
    (b'', "first", b' '),
    (b'', "id", b' the '),
    (b' ', "id", b''),
    (b's ', "id", b' '),
    (b'', "id", b' of '),
    (b'', "first", b''),
    (b'', "id", b' and '),
    (b'', "+2", b''),
    (b'', "-1", b''),
    (b', ', "id", b' '),
    (b'', "id", b', '),
    (b' ', "first", b' '),
    (b'', "id", b' in '),
    (b'', "id", b' to '),
    (b'e ', "id", b' '),
    (b'', "id", b'"'),
    (b'', "id", b'.'),
    (b'', "id", b'">'),
    (b'', "id", b'\n'),
    (b'', "-3", b''),
    (b'', "id", b']'),
    (b'', "id", b' for '),
    (b'', "+3", b''),
    (b'', "-2", b''),
    (b'', "id", b' a '),
    (b'', "id", b' that '),
    (b' ', "first", b''),
    (b'', "id", b'. '),
    (b'.', "id", b''),
    (b' ', "id", b', '),
    (b'', "+4", b''),
    (b'', "id", b' with '),
    (b'', "id", b"'"),
    (b'', "id", b' from '),
    (b'', "id", b' by '),
    (b'', "+5", b''),
    (b'', "+6", b''),
    (b' the ', "id", b''),
    (b'', "-4", b''),
    (b'', "id", b'. The '),
    (b'', "all", b''),
    (b'', "id", b' on '),
    (b'', "id", b' as '),
    (b'', "id", b' is '),
    (b'', "-7", b''),
    (b'', "-1", b'ing '),
    (b'', "id", b'\n\t'),
    (b'', "id", b':'),
    (b' ', "id", b'. '),
    (b'', "id", b'ed '),
    (b'', "+9", b''),
    (b'', "+7", b''),
    (b'', "-6", b''),
    (b'', "id", b'('),
    (b'', "first", b', '),
    (b'', "-8", b''),
    (b'', "id", b' at '),
    (b'', "id", b'ly '),
    (b' the ', "id", b' of '),
    (b'', "-5", b''),
    (b'', "-9", b''),
    (b' ', "first", b', '),
    (b'', "first", b'"'),
    (b'.', "id", b'('),
    (b'', "all", b' '),
    (b'', "first", b'">'),
    (b'', "id", b'="'),
    (b' ', "id", b'.'),
    (b'.com/', "id", b''),
    (b' the ', "id", b' of the '),
    (b'', "first", b"'"),
    (b'', "id", b'. This '),
    (b'', "id", b','),
    (b'.', "id", b' '),
    (b'', "first", b'('),
    (b'', "first", b'.'),
    (b'', "id", b' not '),
    (b' ', "id", b'="'),
    (b'', "id", b'er '),
    (b' ', "all", b' '),
    (b'', "id", b'al '),
    (b' ', "all", b''),
    (b'', "id", b"='"),
    (b'', "all", b'"'),
    (b'', "first", b'. '),
    (b' ', "id", b'('),
    (b'', "id", b'ful '),
    (b' ', "first", b'. '),
    (b'', "id", b'ive '),
    (b'', "id", b'less '),
    (b'', "all", b"'"),
    (b'', "id", b'est '),
    (b' ', "first", b'.'),
    (b'', "all", b'">'),
    (b' ', "id", b"='"),
    (b'', "first", b','),
    (b'', "id", b'ize '),
    (b'', "all", b'.'),
    (b'\xc2\xa0', "id", b''),
    (b' ', "id", b','),
    (b'', "first", b'="'),
    (b'', "all", b'="'),
    (b'', "id", b'ous '),
    (b'', "all", b', '),
    (b'', "first", b"='"),
    (b' ', "first", b','),
    (b' ', "all", b'="'),
    (b' ', "all", b', '),
    (b'', "all", b','),
    (b'', "all", b'('),
    (b'', "all", b'. '),
    (b' ', "all", b'.'),
    (b'', "all", b"='"),
    (b' ', "all", b'. '),
    (b' ', "first", b'="'),
    (b' ', "all", b"='"),
    (b' ', "first", b"='"),
)


def ranges(base: int, bits: tuple[int, ...]) -> tuple[int, ...]:
    """Where each of some adjoining ranges begins, the first at base."""
    return tuple(accumulate((1 << b for b in bits), initial=base))[: len(bits)]


INSERT_BASE, COPY_BASE, BLOCK_BASE, RUN_BASE = ranges(0, INSERT_BITS), ranges(2, COPY_BITS), ranges(1, BLOCK_BITS), ranges(2, RUN_BITS)


def insert_copy(symbol: int) -> tuple[int, int]:
    """Insert and copy codes of a command symbol. Rows of 64 symbols give the codes' upper parts; the first two rows imply distance 0."""
    row, low = divmod(symbol, 64)
    insert, copy = ((0, 0), (0, 8), (0, 0), (0, 8), (8, 0), (8, 8), (0, 16), (16, 0), (8, 16), (16, 8), (16, 16))[row]
    return insert + (low >> 3), copy + (low & 7)


def short_distance(symbol: int) -> tuple[int, int]:
    """Of the sixteen short codes: which of the last four distances, and what is added to it."""
    if symbol < 4:
        return symbol, 0
    step = (symbol - 4) % 6 // 2 + 1
    return (symbol - 4) // 6, step if symbol & 1 else -step


def long_distance(symbol: int, postfix: int, direct: int) -> tuple[int, int]:
    """Base and extra bits (times 2^postfix) of a code behind the short and direct ones."""
    k = symbol - direct - 16
    bits = 1 + (k >> (postfix + 1))
    offset = ((2 + ((k >> postfix) & 1)) << bits) - 4
    return (offset << postfix) + (k & ((1 << postfix) - 1)) + direct + 1, bits


def _punctuation(b: int) -> int:
    for signs, group in ((" ", 8), ("!#$&*+-/?@\\^_|~", 12), ('"\'', 16), ("%", 20), ("(<[{", 24), (")>]}", 28), (",:;", 32), (".", 36), ("=", 40)):
        if chr(b) in signs:
            return group
    return 12


def utf8_last(b: int) -> int:
    """Part of the UTF-8 context that the last byte gives."""
    c = chr(b)
    if b >= 128:
        return (2 if b >= 192 else 0) + b % 2
    if b < 32 or b == 127:
        return 4 if c in "\t\n\r" else 0
    if c.isdigit():
        return 44
    if c.isalpha():
        return (48 if c.isupper() else 56) + (0 if c.lower() in "aeiou" else 4)
    return 12 if c == "`" else _punctuation(b)


def utf8_second(b: int) -> int:
    """Part that the byte before it gives."""
    c = chr(b)
    if b >= 224:
        return 2
    if b <= 32 or b >= 127:
        return 0
    return 3 if "a" <= c <= "z" else 2 if c.isdigit() or "A" <= c <= "Z" else 1


def signed_group(b: int) -> int:
    return sum(b >= edge for edge in (1, 16, 64, 128, 192, 240, 255))


def literal_context(mode: int, last: int, second: int) -> int:
    """Modes: 0 low six bits, 1 high six bits, 2 UTF-8, 3 signed."""
    if mode == 0:
        return last & 63
    if mode == 1:
        return last >> 2
    if mode == 2:
        return utf8_last(last) | utf8_second(second)
    return signed_group(last) << 3 | signed_group(second)


def distance_context(length: int) -> int:
    return min(length - 2, 3)


def upper(word: bytes, once: bool) -> bytes:
    """The format's own upper-casing, by lead byte: ASCII letters, the second of two bytes, the third of three."""
    out, at = bytearray(word), 0
    while at < len(out):
        size = 1 if out[at] < 192 else 2 if out[at] < 224 else 3
        if size == 1:
            out[at] ^= 32 * (97 <= out[at] <= 122)
        elif at + size <= len(out):
            out[at + size - 1] ^= 32 if size == 2 else 5
        if once:
            break
        at += size
    return bytes(out)


def transform(word: bytes, number: int) -> bytes:
    prefix, operation, suffix = TRANSFORMS[number]
    if operation in ("first", "all"):
        word = upper(word, operation == "first")
    elif operation != "id":
        n = int(operation[1:])
        word = word[n:] if operation[0] == "+" else word[: max(0, len(word) - n)]
    return prefix + word + suffix


@lru_cache(maxsize=1)
def dictionary() -> bytes:
    """The static dictionary, as an installed library carries it, found by its first words and held against its checksum."""
    import pyarrow

    for folder in {Path(d) for d in pyarrow.get_library_dirs()} | {Path(pyarrow.__file__).parent}:
        for library in sorted(folder.glob("lib*arrow.so*")) + sorted(folder.glob("libbrotlicommon*")):
            data, at = library.read_bytes(), -1
            while (at := data.find(DICTIONARY_START, at + 1)) >= 0:
                found = data[at : at + DICTIONARY_SIZE]
                if zlib.crc32(found) == DICTIONARY_CRC:
                    return found
    raise FileNotFoundError("no installed library carries Brotli's static dictionary")


def dictionary_word(length: int, index: int) -> tuple[bytes, int]:
    """(word, transform number) of an index among the words of a length."""
    bits = WORD_BITS[length]
    start = sum(n << WORD_BITS[n] for n in range(4, length)) + (index & ((1 << bits) - 1)) * length
    return dictionary()[start : start + length], index >> bits
