"""A small language for writing compressed streams bit by bit, for tests.

    <<< or >>>        first of all: bits fill bytes from the lowest or from the highest bit
    < or >            how what follows is read: last digit first, or first digit first; holds to the end of its group
    0110              bits
    D8:200, H8:c8     a number in so many bits, decimal or hexadecimal
    X:c8ff, "text"    bytes, where the stream stands on a byte border; text knows the escapes of JSON and \\xhh
    <D8:200           one token read in its own order
    token*3, ( )*3    repeated, a group too
    # ...             a comment to the end of the line

    python -m krunch.functions.bitgen < script > stream
"""

from __future__ import annotations

import codecs
import re
import sys

from .bitstream import BitWriter
from .errors import INVALID, CodecError

_TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<pack><<<|>>>)|(?P<open>[<>]?\()|(?P<close>\)(?:\*(?P<times>\d+))?)
    |(?P<order>[<>](?=\s|\(|\)|$|\#))|(?P<mark>[<>])?(?:(?P<bits>[01]{1,64})|(?P<base>[DH])(?P<width>\d+):(?P<number>[0-9a-fA-F]+)|X:(?P<hex>(?:[0-9a-fA-F]{2})+)|(?P<text>"(?:[^"\\]|\\.)*"))(?:\*(?P<repeat>\d+))?(?=\s|\(|\)|$|\#)""", re.X)


def _bad(what: str) -> CodecError:
    return CodecError(INVALID, what, "bitgen")


def parse(script: str) -> bytes:
    at, packed, groups = 0, None, [[]]
    while at < len(script):
        m = _TOKEN.match(script, at)
        if not m or m.end() == at:
            raise _bad(f"unknown token at {script[at : at + 12]!r}")
        at = m.end()
        if m["pack"]:
            if packed or groups != [[]]:
                raise _bad("the packing order stands first and once")
            packed = m["pack"]
        elif m["open"]:
            groups.append([("order", m["open"][0])] if len(m["open"]) > 1 else [])
        elif m["close"]:
            if len(groups) < 2:
                raise _bad("a group is closed that isn't open")
            inner = groups.pop()
            groups[-1].append(("group", inner, int(m["times"] or 1)))
        elif m["order"]:
            groups[-1].append(("order", m["order"]))
        elif m["bits"] or m["base"]:
            if m["bits"]:
                bits = m["bits"]
            else:
                width, value = int(m["width"]), int(m["number"], 10 if m["base"] == "D" else 16)
                if width > 64 or value >> width:
                    raise _bad(f"{m['number']} doesn't fit {width} bits")
                bits = f"{value:0{width}b}" if width else ""
            groups[-1].append(("bits", bits, m["mark"], int(m["repeat"] or 1)))
        elif m["hex"] or m["text"]:
            if m["mark"]:
                raise _bad("bytes have no order")
            data = bytes.fromhex(m["hex"]) if m["hex"] else codecs.escape_decode(m["text"][1:-1].encode())[0]
            groups[-1].append(("bytes", data * int(m["repeat"] or 1)))
    if packed is None or len(groups) != 1:
        raise _bad("no packing order" if packed is None else "a group isn't closed")
    out = BitWriter(packed == ">>>")

    def run(tokens: list, order: str) -> None:
        for t in tokens:
            if t[0] == "order":
                order = t[1]
            elif t[0] == "group":
                for _ in range(t[2]):
                    run(t[1], order)
            elif t[0] == "bytes":
                if out.count:
                    raise _bad("bytes off a byte border")
                out.out += t[1]
            else:
                bits = t[1] if (t[2] or order) == ">" else t[1][::-1]
                for bit in bits * t[3]:
                    out.write(int(bit), 1)

    run(groups[0], "<")
    return out.bytes()


if __name__ == "__main__":
    sys.stdout.buffer.write(parse(sys.stdin.read()))
