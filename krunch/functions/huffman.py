"""Prefix codes: lengths from counts under a limit, canonical values, validity, and range codes."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from .errors import INVALID, CodecError


def code_lengths(counts: list[int], limit: int) -> list[int]:
    """Optimal code lengths of at most limit bits for symbols with these counts, in their order.

    Every symbol gets a code, also with count 0; a single symbol gets length 0. Found by Huffman's two queues, of equal
    weights a symbol before a package, so that the longest code is as short as it can be; by package-merge where it's too long.
    """
    n = len(counts)
    if n < 2:
        return [0] * n
    if n > 1 << limit:
        raise CodecError(INVALID, f"{n} symbols don't fit codes of {limit} bits")
    order = sorted(range(n), key=counts.__getitem__)
    single = [counts[k] for k in order]
    found = _two_queues(single)
    if found[0] > limit:
        found = _package_merge(single, limit)
    out = [0] * n
    for k, length in zip(order, found, strict=True):
        out[k] = length
    return out


def _two_queues(single: list[int]) -> list[int]:
    """Lengths for ascending counts without a limit."""
    n, last = len(single), 2 * len(single) - 2
    weights, parent, symbol, package = single + [0] * (n - 1), [0] * (last + 1), 0, n
    for k in range(n, last + 1):
        total = 0
        for _ in range(2):
            if symbol < n and (package >= k or weights[symbol] <= weights[package]):
                least, symbol = symbol, symbol + 1
            else:
                least, package = package, package + 1
            total += weights[least]
            parent[least] = k
        weights[k] = total
    depth = [0] * (last + 1)
    for k in range(last - 1, -1, -1):
        depth[k] = depth[parent[k]] + 1
    return depth[:n]


def _package_merge(single: list[int], limit: int) -> list[int]:
    """Lengths for ascending counts. Of limit rounds, each pairs the cheapest packages of the round before and merges them with the symbols.

    What the last round takes of its cheapest are the first symbols and the first packages, and so on back; a symbol's
    length is the number of rounds that take it.
    """
    level, rounds = single, []
    for _ in range(limit - 1):
        pairs = [a + b for a, b in zip(level[::2], level[1::2])]
        level = sorted(single + pairs)
        rounds.append(pairs)
    wanted, taken = 2 * len(single) - 2, []
    for pairs in reversed(rounds):
        # a package stands behind those before it and the symbols that cost no more
        packages = bisect_left(range(len(pairs)), wanted, key=lambda j, pairs=pairs: j + bisect_right(single, pairs[j]))
        taken.append(wanted - packages)
        wanted = 2 * packages
    taken.append(wanted)
    return [sum(n > k for n in taken) for k in range(len(single))]


def canonical(lengths: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(symbol, length) -> (symbol, length, value): canonical codes with their bits reversed. An incomplete tree is invalid; one symbol of length 0 is fine."""
    if len(lengths) == 1 and lengths[0][1] == 0:
        return [(lengths[0][0], 0, 0)]
    if sum(1 << (32 - n) for _, n in lengths if n) != 1 << 32 or any(n == 0 for _, n in lengths):
        raise CodecError(INVALID, "degenerate prefix tree")
    out, code, last = [], 0, 0
    for n, symbol in sorted((n, s) for s, n in lengths):
        code <<= n - last
        out.append((symbol, n, int(f"{code:0{n}b}"[::-1], 2)))
        code, last = code + 1, n
    return out


def ranges_valid(ranges: list[tuple[int, int]]) -> bool:
    """Whether (base, bits) ranges leave no gap and both their starts and ends go up. Overlap is fine."""
    if not ranges:
        return False
    ends = [b + (1 << n) for b, n in ranges]
    return all(b1 <= e0 and b1 >= b0 and e1 >= e0 for (b0, _), e0, (b1, _), e1 in zip(ranges, ends, ranges[1:], ends[1:]))
