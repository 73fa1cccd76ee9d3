"""Deterministic damage to compressed columns, to see what decoders make of it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .codecs import transform


def truncate(data: Column, keep: Column) -> Column:
    """The first bytes only, as if the rest never came."""
    return F.substring(data, F.lit(1), F.greatest(F.lit(0), keep).cast("int"))


def trailing(data: Column, rest: bytes) -> Column:
    """Something behind the end that isn't part of the stream."""
    return F.concat(data, F.lit(rest))


def flip(data: Column, step: int = 7919) -> Column:
    """One bit turned over, at a place that hangs on the length alone. Empty stays empty."""

    def run(x: bytes) -> bytes:
        if not x:
            return x
        at = step % (8 * len(x))
        return x[: at // 8] + bytes([x[at // 8] ^ 1 << at % 8]) + x[at // 8 + 1 :]

    return transform(data, run, "binary")


def first_difference(a: Column, b: Column) -> Column:
    """Place of the first byte in which two binary columns differ; null if they are equal or one is null."""
    def place(x: bytes, y: bytes) -> int | None:
        if x == y:
            return None
        low, high = 0, min(len(x), len(y))
        while low < high:  # of equal prefixes, the longest
            middle = (low + high + 1) // 2
            low, high = (middle, high) if x[:middle] == y[:middle] else (low, middle - 1)
        return low

    @F.arrow_udf("bigint")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else place(x, y) for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.int64())

    return run(a.cast("binary"), b.cast("binary"))
