"""Bit and integer functions as column expressions, inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_bits(value: Column, n: int) -> Column:
    """The lowest n bits in reverse, up to 63; unsigned."""
    return F.conv(F.reverse(F.lpad(F.bin(value.bitwiseAND(F.lit((1 << n) - 1).cast("long"))), n, "0")), 2, 10).cast("long")


def take_bits(value: Column, at: int, n: int) -> Column:
    """n bits of a long from bit at on."""
    return F.shiftrightunsigned(value.cast("long"), at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def needed_bits(count: Column) -> Column:
    """Bits that so many different values need: 0 for one."""
    return F.when(count <= 1, 0).otherwise(F.length(F.bin(count.cast("long") - 1)))


def uvarint_len(value: Column) -> Column:
    """Bytes of a variable-length integer, seven bits each."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value.cast("long"))) / 7)).cast("int")


def pads(bits: Column) -> Column:
    """Bits missing to a whole byte."""
    return F.pmod(-bits, F.lit(8)).cast("int")


def meta_code_length(zeros: Column, ones: Column) -> Column:
    """Code length of a meta block for so many bits: the first of 1 to 7 with room for both, 0 if none; the rarer bit counts as one."""
    few, many = F.least(zeros, ones), F.greatest(zeros, ones)
    out = F.lit(0)
    for h in range(7, 0, -1):
        out = F.when((257 - (1 << h) >= many + 8) & ((1 << h) >= few + 8), h).otherwise(out)
    return out


def distance_context(length: Column) -> Column:
    """Brotli's context of a distance: by copy length, 2 to 4, or more."""
    return F.least(length - 2, F.lit(3)).cast("int")


def rle1_length(run: Column) -> Column:
    """Bytes that a run of equal bytes takes: five for each 255, what is left as it is up to three, else five."""
    rest = run % 255
    return (5 * F.floor(run / 255) + F.when(rest < 4, rest).otherwise(5)).cast("long")
