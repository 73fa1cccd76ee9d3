"""Benchmark decontamination by the q-gram lemma.

Texts are folded to lower-case letters and digits with single blanks between. An item of L folded characters may
occur with up to BUDGET * L edits. If it does with at most e edits, then at least L - q + 1 - q*e of its q-grams
occur too, on diagonals (place in the text less place in the item) that lie within e of each other. So diagonals
are cut in bands of 2(e+1), each overlapping the next by half, shared q-grams are counted in every band, and only
bands that reach the bound are kept and verified by an alignment within the band. An item of fewer than LEAST folded
characters must occur without an edit and between word borders; the lemma has nothing to say of one of fewer than q, so
that is looked up whole, by a hash of its own length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, sliced, without

GRAM, BUDGET, LEAST = 10, 0.05, 24
#: Folded characters of a block of benchmark items; its arrays take about 30 bytes for each.
ITEM_BLOCK = 4_000_000
_TEXT_BLOCK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


def _table() -> np.ndarray:
    out = np.zeros(0x3000, np.uint32)
    for k in range(len(out)):
        low = chr(k).lower()
        out[k] = ord(low[0]) if chr(k).isalnum() else 0
    return out


_FOLD = _table()


def fold(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded symbols and the place of each in the text. 32 stands for a run of all that is neither letter nor digit."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    symbols = np.where(codes < len(_FOLD), _FOLD[np.minimum(codes, len(_FOLD) - 1)], codes)
    blank = symbols == 0
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    keep[0] = not blank[0]
    at = np.flatnonzero(keep)
    out = symbols[at]
    out[out == 0] = 32
    if len(out) and out[-1] == 32:
        out, at = out[:-1], at[:-1]
    return out, at


def short_hashes(symbols: np.ndarray, length: int) -> np.ndarray:
    """Of so many symbols from each place on, fewer than a gram."""
    out = np.zeros(max(0, len(symbols) - length + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            out = (out ^ symbols[k : k + len(out)].astype(np.uint64) + np.uint64(1)) * _BASE
            out ^= out >> np.uint64(29)
    return out


def hashes(symbols: np.ndarray) -> np.ndarray:
    """Of the ten symbols from each place on."""
    with np.errstate(over="ignore"):
        b2 = _BASE * _BASE
        b4 = b2 * b2
        h = (symbols.astype(np.uint64) + np.uint64(0x51ED27)) * np.uint64(0xD6E8FEB86659FD93)
        h2 = h[:-1] * _BASE + h[1:]
        h = h2[:-2] * b2 + h2[2:]
        h = h[:-4] * b4 + h[4:]
        h = h[:-2] * b2 + h2[8:]
        h ^= h >> np.uint64(32)
        h *= _BASE
    return h


@dataclass
class Items:
    ids: list[int]
    texts: list[np.ndarray]
    grams: np.ndarray  #: sorted different hashes
    first: np.ndarray  #: of each, where its places begin; one more at the end
    item: np.ndarray
    place: np.ndarray
    known: np.ndarray  #: which leading bits of a hash occur
    short: list[tuple[int, np.ndarray, np.ndarray]]  #: of items below a gram: length, sorted hashes, their items

    @classmethod
    def of(cls, rows: list[tuple[int, np.ndarray]]) -> Items:
        tiny, rows = [(i, t) for i, t in rows if len(t) < GRAM], [(i, t) for i, t in rows if len(t) >= GRAM]
        short = []
        for length in sorted({len(t) for _, t in tiny}):
            own = [(int(short_hashes(t, length)[0]), i) for i, t in tiny if len(t) == length]
            own.sort()
            short.append((length, np.array([h for h, _ in own], np.uint64), np.array([i for _, i in own], np.int64)))
        if not rows:
            none = np.zeros(0, np.int64)
            return cls([], [], np.zeros(0, np.uint64), np.zeros(1, np.int64), none, none, np.zeros(1 << _BITS, bool), short)
        each = [hashes(t) for _, t in rows]
        h = np.concatenate(each)
        item = np.repeat(np.arange(len(rows)), [len(x) for x in each])
        place = np.concatenate([np.arange(len(x)) for x in each])
        order = np.argsort(h, kind="stable")
        grams, first = np.unique(h[order], return_index=True)
        known = np.zeros(1 << _BITS, bool)
        known[(grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return cls([i for i, _ in rows], [t for _, t in rows], grams, np.append(first, len(h)), item[order], place[order], known, short)


def budget(length: int) -> int:
    return int(length * BUDGET) if length >= LEAST else 0


def _border(left: int, right: int) -> bool:
    """Whether a word can end between two neighbours: at a blank or beside a letter of a script that sets no blanks."""
    return any(x == 32 or x >= 0x3000 and not 0xAC00 <= x < 0xD7A4 for x in (left, right))


def align(item: np.ndarray, text: np.ndarray, low: int, width: int) -> tuple[int, int, int]:
    """Least edits of the whole item against a part of the text on diagonals low to low + width - 1, with that part's start and end."""
    far = 1 << 20
    lanes = np.arange(width)
    cost = np.where((low + lanes >= 0) & (low + lanes <= len(text)), 0, far)
    start = low + lanes
    padded = np.concatenate([np.zeros(max(0, -low), np.uint32), text, np.zeros(len(item) + width + 1, np.uint32)])
    shift = low + max(0, -low)
    for i, symbol in enumerate(item):
        j = low + i + lanes  # the text's symbol on each lane
        inside = (j >= 0) & (j < len(text))
        same = padded[shift + i : shift + i + width] == symbol
        diagonal = np.where(inside, cost + ~same, far)
        up, from_up = np.append(cost[1:], far) + 1, np.append(start[1:], 0)
        best, begin = np.where(diagonal <= up, diagonal, up), np.where(diagonal <= up, start, from_up)
        slack = best - lanes
        least = np.minimum.accumulate(slack)
        origin = np.maximum.accumulate(np.where(slack == least, lanes, 0))
        ok = j + 1 <= len(text)
        cost, start = np.where(ok, least + lanes, np.where(j + 1 >= 0, best, far)), begin[origin]
    k = int(cost.argmin())
    return int(cost[k]), int(start[k]), int(low + len(item) + k)


def search(items: Items, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """(index of text, item id, start, end, edits) of each item found in each text, at its best place; offsets in code points."""
    folded = [fold(t) for t in texts]
    if items.short:
        yield from _search_short(items, folded)
    if not items.ids:
        return
    gap = np.zeros(GRAM, np.uint32)
    every = np.concatenate([x for symbols, _ in folded for x in (symbols, gap)])
    starts = np.cumsum([0, *(len(s) + GRAM for s, _ in folded)])
    if len(every) < GRAM:
        return
    h = hashes(every)
    at = np.flatnonzero(items.known[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
    found = np.minimum(np.searchsorted(items.grams, h[at]), len(items.grams) - 1)
    hit = items.grams[found] == h[at]
    at, found = at[hit], found[hit]
    sizes = items.first[found + 1] - items.first[found]
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return
    row = np.repeat(items.first[found] - (ends - sizes), sizes) + np.arange(ends[-1])
    item, diagonal = items.item[row], np.repeat(at, sizes) - items.place[row]
    lengths = np.array([len(t) for t in items.texts])
    edits = np.array([budget(n) for n in lengths.tolist()])
    bound = lengths - GRAM + 1 - GRAM * edits
    step = edits[item] + 1
    shift = int(lengths.max())  # no diagonal lies further below zero
    band = (diagonal + shift) // step + 1
    keys = np.concatenate([item << np.int64(34) | band, item << np.int64(34) | (band - 1)])
    keys, counts = np.unique(keys, return_counts=True)
    of = keys >> 34
    keep = counts >= bound[of]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for k, b in zip(of[keep].tolist(), (keys[keep] & ((1 << 34) - 1)).tolist(), strict=True):
        pattern, e = items.texts[k], int(edits[k])
        low = (b - 1) * (e + 1) - shift
        # a band may touch two texts
        for d in range(max(0, int(np.searchsorted(starts, low - e, "right")) - 1), len(folded)):
            if starts[d] > low + 2 * (e + 1) + e + len(pattern):
                break
            symbols = folded[d][0]
            if len(symbols) < len(pattern) - e or best.get((d, k), (e + 1,))[0] == 0:
                continue
            lo = low - int(starts[d]) - e
            if lo > len(symbols):
                continue
            short = len(pattern) < LEAST
            got = _exact(pattern, symbols, lo, 2 * (e + 1) + 2 * e, short)
            if not got and not short:
                got = align(pattern, symbols, lo, 2 * (e + 1) + 2 * e)
            if got and got[0] <= e and got < best.get((d, k), (e + 1,)):
                best[d, k] = got
    for (d, k), (cost, a, b) in sorted(best.items()):
        places = folded[d][1]
        yield d, items.ids[k], int(places[a]), int(places[b - 1]) + 1, cost


def _exact(pattern: np.ndarray, text: np.ndarray, low: int, width: int, words: bool = False) -> tuple[int, int, int] | None:
    """The first place of the pattern on these diagonals; with words, only between word borders."""
    for a in range(max(0, low), min(low + width, len(text) - len(pattern) + 1)):
        if text[a] == pattern[0] and np.array_equal(text[a : a + len(pattern)], pattern):
            b = a + len(pattern)
            if words and (a and not _border(text[a - 1], text[a]) or b < len(text) and not _border(text[b - 1], text[b])):
                continue
            return 0, a, b
    return None


def _search_short(items: Items, folded) -> Iterator[tuple[int, int, int, int, int]]:
    """Items below a gram: the first place between word borders where one occurs as it is."""
    for d, (symbols, places) in enumerate(folded):
        for length, known, ids in items.short:
            h = short_hashes(symbols, length)
            if not len(h):
                continue
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
            met = set()
            for a in at.tolist():
                b = a + length
                if int(h[a]) in met or a and not _border(symbols[a - 1], symbols[a]) or b < len(symbols) and not _border(symbols[b - 1], symbols[b]):
                    continue
                met.add(int(h[a]))
                first, last = np.searchsorted(known, h[a], "left"), np.searchsorted(known, h[a], "right")
                for i in ids[first:last].tolist():
                    yield d, i, int(places[a]), int(places[b - 1]) + 1, 0


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The benchmark in blocks of bounded size; it is read once, a partition at a time."""
    rows, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null").toLocalIterator():
        symbols = fold(r["t"])[0] if r["t"] else np.zeros(0, np.uint32)
        if not len(symbols):
            continue
        rows.append((r["i"], symbols))
        size += len(symbols)
        if size >= ITEM_BLOCK:
            yield Items.of(rows)
            rows, size = [], 0
    if rows:
        yield Items.of(rows)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start, end, edits: a row for each item that occurs in a document, at its best place in code points.

    Null texts and ids of items find nothing, nor does an item without a letter or digit. Items of fewer than LEAST folded
    characters are found without edits and between word borders only. Repeated rows are each searched. An empty table
    gives no rows. The benchmark goes to the executors in blocks of ITEM_BLOCK characters; each text is folded once and
    held against all of them, so a larger benchmark costs no further scan of the documents.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    shared = [spark.sparkContext.broadcast(items) for items in item_blocks(benchmark, item_id, item_text)]
    if not shared:
        return spark.createDataFrame([], "doc_id long, item_id long, start long, end long, edits int")

    def run(batches):
        for b in sliced(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for some in _split(texts):
                rows = [(ids[some[d]], *rest) for block in shared for d, *rest in search(block.value, [texts[k] for k in some])]
                if rows:
                    yield batch(schema, *zip(*rows, strict=True))

    return source.mapInArrow(run, "doc_id long, item_id long, start long, end long, edits int")


def _split(texts: list[str | None]) -> Iterator[list[int]]:
    some, size = [], 0
    for k, t in enumerate(texts):
        if t:
            if some and size + len(t) > _TEXT_BLOCK:
                yield some
                some, size = [], 0
            some.append(k)
            size += len(t)
    if some:
        yield some


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item occurs, with all columns of docs."""
    return without(docs, lambda: contaminated(docs, benchmark), "contaminated")
