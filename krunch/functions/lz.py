"""The window of past output that length-distance pairs copy from."""

from __future__ import annotations

from .errors import CORRUPTED, CodecError


def copy(out: bytearray, distance: int, length: int) -> None:
    """Appends length bytes from distance back; they may overlap what is being written."""
    if not 0 < distance <= len(out):
        raise CodecError(CORRUPTED, f"distance {distance} reaches behind the start")
    start = len(out) - distance
    if distance >= length:
        out += out[start : start + length]
    else:
        pattern = bytes(out[start:])
        out += (pattern * (length // distance + 1))[:length]


def expand(operations) -> bytes:
    """Operations (distance, length, literal): a literal is inserted, then length bytes are copied from distance back."""
    out = bytearray()
    for distance, length, literal in operations:
        out += literal or b""
        if length:
            copy(out, distance, length)
    return bytes(out)
