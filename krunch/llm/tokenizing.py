"""Tokenizer files of the tokenizers library, applied to whole texts with each different word encoded once.

The library encodes about one and a half megabytes a second. Both kinds of file that are used here put a token
border at white space before anything else happens, so a block of texts can be cut at blanks, the different
pieces encoded, and the ids gathered; they are the same ids. Texts in which a cut might not be a border
(runs of blanks in byte-level files, control characters, special tokens written out), and files of another
kind, go to the library whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of the table that holds short pieces with their ids, 48 bytes each. A piece has one place there, and the last one that
#: came to it stays.
SLOTS = 1 << 20
#: Cached pieces of a generation, of those that the table has no room for: longer ones, and ones of many ids. Where it is full, a
#: new one begins, into which those that are still met move from the one before; the one before that goes.
CACHE = 130_000
#: Bytes of text gathered at once.
BLOCK = 8 << 20
_LONGEST = 48
#: Bytes of a piece that a row of the table holds; behind them stands their number. Then come 16 bytes of ids, and the number of these.
_HELD = 23
#: Words of a call of the library.
_CALL = 64
#: The characters that stand for bytes in byte-level files.
_SPELT = np.arange(256, dtype="<u4")
_SPELT[[*range(33), *range(127, 161), 173]] = np.arange(256, 324)
_MASKS = np.array([[(1 << 8 * min(max(n - 8 * k, 0), 8)) - 1 for k in range(3)] for n in range(_HELD + 1)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_TAIL = ".,;:!?$%&*#"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_ODD = r"[\x1c-\x1f]|<\|"
#: For byte-level files: white space that isn't one blank, or one line feed, between other characters. The library's \s is that of
#: Unicode, while Arrow's is that of ASCII, so the class is spelt out.
_ODD_BLANKS = r"|^[ \n]|[ \n]$|[ \n][ \n]|[\t\x0b\f\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Behind a letter, these begin a token.
_PUNCTUATED = f"([{_LETTERS}])([{_TAIL}])"


class Encoder:
    """Ids of whole texts as arrays of unsigned 32-bit integers. Null text: none."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.kind = self._kind(spec)
        #: The same model, for words in the characters that stand for their bytes, each behind a line feed.
        self.spelt = Tokenizer(self.tokenizer.model)
        self.spelt.pre_tokenizer = CharDelimiterSplit("\n")
        special = [re.escape(x["content"]) for x in spec.get("added_tokens") or []]
        self.odd = "|".join([_ODD, *special]) + (_ODD_BLANKS if self.kind == "bytes" else "")
        self.table = np.zeros((SLOTS, 6), np.uint64)
        #: Of an id in the table, and how many fit there.
        self.width = "<u2" if self.vocabulary <= 1 << 16 else "<u4"
        self.most = 16 // np.dtype(self.width).itemsize
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        #: Of each id: whether it ends a word (word files) or begins one with a blank (byte-level files).
        self.border = np.zeros(self.vocabulary, bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.border[k] = token.endswith("</w>") if self.kind == "words" else token.startswith("Ġ")
        #: The id of a line feed in byte-level files.
        self.feed = self.tokenizer.token_to_id("Ċ") if self.kind == "bytes" else None

    @staticmethod
    def _kind(spec: dict) -> str | None:
        pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}, spec.get("model") or {}
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            return "bytes"
        kinds = [x.get("type") for x in norm.get("normalizers", [])]
        blanks = any(x.get("pattern") == {"Regex": r"\s+"} and x.get("content") == " " for x in norm.get("normalizers", []))
        first = (pre.get("pretokenizers") or [{}])[0]
        if blanks and set(kinds) <= {"NFC", "Replace", "Lowercase"} and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s" in (first.get("pattern") or {}).get("Regex", "") and model.get("end_of_word_suffix") == "</w>":
            return "words"
        return None

    def whole(self, text: str | None) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if text else b""

    @staticmethod
    def _keys(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """What stands for a piece in the table, and whether it is short enough for it."""
        names = names.cast(pa.binary())
        _, bounds, data = names.buffers()
        bounds = np.frombuffer(bounds, np.int32)[names.offset : names.offset + len(names) + 1]
        padded = np.zeros(bounds[-1] + 24, np.uint8)
        if data is not None:
            padded[: bounds[-1]] = np.frombuffer(data, np.uint8, bounds[-1])
        sizes = np.diff(bounds)
        short = sizes <= _HELD
        sizes = np.where(short, sizes, 0)
        keys = np.lib.stride_tricks.sliding_window_view(padded, 24)[bounds[:-1]].view("<u8")
        keys &= _MASKS[sizes]
        keys[:, 2] |= sizes.astype(np.uint64) << np.uint64(56)
        return keys, short

    def _words(self, pieces: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The words of Latin letters among the pieces, encoded 64 in a call and told apart by their border ids; in byte-level
        files, words without a blank before them by line feeds between them. Gives where they stand, how many ids each has, and
        the ids."""
        short = pc.less_equal(pc.utf8_length(pieces), _LONGEST)
        for first, between in (("", " "),) if self.kind == "words" else ((" ", ""), ("", "\n"))[: 1 + (self.feed is not None)]:
            places = np.flatnonzero(pc.and_(short, pc.match_substring_regex(pieces, rf"\A{first}[{_LETTERS}]+\z")).to_numpy(zero_copy_only=False))
            words, every, ends = pieces.take(pa.array(places)).to_numpy(zero_copy_only=False).tolist(), [], [0]
            for at in range(0, len(words), _CALL):
                text, tokenizer = between.join(words[at : at + _CALL]), self.tokenizer
                if first:  # these are tokens before merges already, so they needn't be found by the file's regex
                    text, tokenizer = _SPELT[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le").replace("Ġ", "\nĠ"), self.spelt
                every += tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
                every += [self.feed] * (between == "\n")
                ends.append(len(every))
            if not words:
                continue
            ids = np.array(every, "<u4")
            marks = ids == self.feed if between == "\n" else self.border[ids]
            # of each call, whether its words and their borders are as many; else its words are encoded one by one, later
            expected = np.diff(np.append(np.arange(0, len(words), _CALL), len(words)))
            inside = np.repeat(np.arange(len(expected)), np.diff(ends))
            good = np.bincount(inside[marks], minlength=len(expected)) == expected
            ids, marks = ids[good[inside]], marks[good[inside]]
            if first:
                sizes = np.diff(np.flatnonzero(marks), append=len(ids))
            else:
                sizes = np.diff(np.flatnonzero(marks), prepend=-1)
            if between == "\n":
                sizes, ids = sizes - 1, ids[~marks]
            if sizes.sum() == len(ids):
                yield places[np.repeat(good, expected)], sizes, ids

    def _cached(self, pieces: list[str]) -> list[bytes | None]:
        found = list(map(self.cache.get, pieces))
        if self.older:
            for k in [k for k, f in enumerate(found) if f is None]:
                found[k] = self.older.get(pieces[k])
                if found[k] is not None:
                    self.cache[pieces[k]] = found[k]
        return found

    def _missed(self, pieces: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """As _words gives them, the pieces that the table doesn't have."""
        if len(self.cache) > CACHE:
            self.cache, self.older = {"": b""}, self.cache
        names = pieces.to_numpy(zero_copy_only=False).tolist()
        found = self._cached(names)
        new = np.array([f is None for f in found], bool)
        at = np.flatnonzero(new)
        for places, sizes, ids in self._words(pieces.filter(pa.array(new))):
            places = at[places]
            new[places] = False
            yield places, sizes, ids
        for k in np.flatnonzero(new).tolist():
            found[k] = self.whole(names[k])
        at = np.array([k for k, f in enumerate(found) if f is not None], np.int64)
        raw = [f for f in found if f is not None]
        yield at, np.fromiter(map(len, raw), np.int64, len(raw)) // 4, np.frombuffer(b"".join(raw), "<u4")

    def _different(self, names: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The ids of different pieces, as binary values, and which of these is each piece's."""
        keys, short = self._keys(names)
        with np.errstate(over="ignore"):
            slots = (keys * _MIX).sum(axis=1)
            slots = ((slots ^ slots >> np.uint64(32)) * _MIX[0] >> np.uint64(32)) % np.uint64(len(self.table))
        slots = slots.astype(np.int64)
        rows = self.table.take(slots, axis=0)
        known = short & (rows[:, :3] == keys).all(axis=1)
        places, missed = np.flatnonzero(known), np.flatnonzero(~known)
        rows = rows[places]
        sizes = rows[:, 5].astype(np.int64)
        held = np.ascontiguousarray(rows[:, 3:5]).view(self.width)
        found = [(places, sizes, held[np.arange(self.most) < sizes[:, None]].astype("<u4"))]
        if len(missed):
            pieces = names.take(pa.array(missed))
            new = [np.concatenate(x) for x in zip(*self._missed(pieces), strict=True)]
            at = missed[new[0]]
            self._keep(pieces, keys[at], slots[at], short[at], *new)
            found.append((at, *new[1:]))
        places, sizes, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        which = np.empty(len(names), np.int64)
        which[places] = np.arange(len(names))
        bounds = np.append(0, 4 * np.cumsum(sizes)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(ids))]), which

    def _keep(self, pieces: pa.Array, keys: np.ndarray, slots: np.ndarray, short: np.ndarray, places: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """New pieces in the table, or in the cache if they don't fit there."""
        starts = np.cumsum(sizes) - sizes
        fits = short & (sizes <= self.most)
        rows = np.zeros((np.count_nonzero(fits), 6), np.uint64)
        held = np.zeros((len(rows), self.most), self.width)
        filled = np.arange(self.most) < sizes[fits][:, None]
        held[filled] = ids[np.repeat(fits, sizes)]
        rows[:, :3], rows[:, 3:5], rows[:, 5] = keys[fits], held.view(np.uint64), sizes[fits]
        self.table[slots[fits]] = rows
        for k in np.flatnonzero(~fits).tolist():
            piece = pieces[int(places[k])].as_py()
            if len(piece) <= _LONGEST:
                self.cache[piece] = ids[starts[k] : starts[k] + sizes[k]].tobytes()

    def _block(self, texts: pa.Array) -> list[np.ndarray]:
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) if self.kind else np.ones(len(texts), bool)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        if self.kind == "words":  # blanks make no ids
            pieces = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, _PUNCTUATED, r"\1 \2"))
        else:
            plain = pc.replace_substring(pc.replace_substring_regex(plain, _PUNCTUATED, "\\1\x1f\\2"), " ", "\x1f ")
            pieces = pc.split_pattern(pc.replace_substring(plain, "\n", "\x1f\n\x1f"), "\x1f")
        coded = pieces.flatten().dictionary_encode()
        offsets = pieces.offsets.to_numpy().astype(np.int64)
        values, which = self._different(coded.dictionary)
        gathered = values.take(pa.array(which[coded.indices.to_numpy()]))
        _, bounds, data = gathered.buffers()
        bounds = np.frombuffer(bounds, np.int32)[: len(gathered) + 1].astype(np.int64) // 4
        ids = np.frombuffer(data, "<u4") if data is not None and data.size else np.zeros(0, "<u4")
        borders = bounds[offsets - offsets[0]]
        out = [ids[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]
        for k in np.flatnonzero(odd):
            out[k] = np.frombuffer(self.whole(texts[k].as_py()), "<u4")
        return out

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in turn, some megabytes of text at a time."""
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // BLOCK
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield from self._block(texts.slice(a, b - a))


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
