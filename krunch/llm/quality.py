"""Quality rules: counts over words and lines, and bands of perplexity under a modified Kneser-Ney model.

The model is of characters, order five, one for each language, counted over the whole corpus by Spark. A gram is packed in a
long, twelve bits a symbol: code points below 2048 stand for themselves, the others are hashed to 2048 more. Counts, the
lower orders' counts of different symbols before a gram, discounts and probabilities are aggregates, windows and joins,
so the tables grow with the corpus and none of them meets the driver. Every gram of a text that is judged has been
counted, so a text's score is a sum over its grams of one table's log probabilities; no back-off is met in scoring.

Scoring looks grams up in sorted arrays of their hashes. A table of at most TABLE rows is broadcast. Beyond that, texts are
dealt to parts, each part asks for its different grams by a join, and gets its own arrays: one more shuffle of the texts and
of a part's different grams, and nothing that grows with the corpus in any one place.

Bands around each language's median decide, not a list of signs: one of the mean cost of a character, and one of the
mean cost of a word, which shows what is cheap by the character but hung on to every word.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, batch, forget, materialise, pieces_of, sliced, without

ORDER, BITS = 5, 12
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A band reaches from the median of its language's scores so many robust deviations up and down, FLOOR at least. For a text of
#: SHORT characters it is sqrt(2) times as wide, and so on, as a mean over fewer characters strays further.
WIDTH, FLOOR, SHORT, BIN = 4.0, 0.02, 400, 1e-3
#: Rows of the table of log probabilities that are broadcast at most, 12 bytes each; bytes of text of a part beyond that.
TABLE, PART = 1 << 22, 32 << 20
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_SPACES = re.compile(rb"[\x20\x09-\x0D]")
_BLOCK = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_HALF = 1 << BITS - 1


def symbols(codes: np.ndarray) -> np.ndarray:
    """Symbol of each code point; 0 is the border before a text."""
    low = np.maximum(codes, 1)
    high = _HALF + ((codes.astype(np.uint64) * _PRIME) >> np.uint64(65 - BITS)).astype(np.int64)
    return np.where(codes < _HALF, low, high).astype(np.int64)


def grams(texts: list[str], skips: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The packed grams that end at each character of each text, and how many each has. Borders stand before a text; the
    first skips[k] characters of text k are context only."""
    pad = "\0" * (ORDER - 1)
    every = symbols(np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le", "surrogatepass"), "<u4"))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths + ORDER - 1) - lengths - ORDER + 1
    own = np.ones(len(every), bool)
    for k in range(ORDER - 1):
        every[starts + k] = 0
        own[starts + k] = False
    if skips is not None:
        for k, n in enumerate(skips):
            own[starts[k] + ORDER - 1 : starts[k] + ORDER - 1 + n] = False
        lengths = lengths - np.array(skips, np.int64)
    packed = every[ORDER - 1 :].copy() if len(every) >= ORDER else np.zeros(0, np.int64)
    for k in range(1, ORDER):
        packed |= every[ORDER - 1 - k : len(every) - k] << BITS * k
    return packed[own[ORDER - 1 :]], lengths


def _blocks(texts: list[str | None]):
    """Lists of (number of the text, piece, skip) with about a block of characters in all. Pieces of a long text overlap by a gram."""
    some, size = [], 0
    for k, t in enumerate(texts):
        for at in range(0, len(t or ""), _BLOCK):
            skip = min(ORDER, at)
            piece = t[at - skip : at + _BLOCK]
            if some and size + len(piece) > _BLOCK:
                yield some
                some, size = [], 0
            some.append((k, piece, skip))
            size += len(piece)
    if some:
        yield some


def _by_language(langs: list[str]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for k, lang in enumerate(langs):
        out.setdefault(lang, []).append(k)
    return out


def _lang(column: str = "lang"):
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("lang")


def count(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n) over every character of every text; no language is one of its own. A task sums its own before the shuffle."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list] = {}

        def merge(lang):
            parts = [sums[lang], *waiting.pop(lang)] if lang in sums else waiting.pop(lang)
            keys, of = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            sums[lang] = keys, np.bincount(of, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

        for b in sliced(batches):
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang, own in _by_language(langs).items():
                for some in _blocks([texts[k] for k in own]):
                    _, pieces, skips = zip(*some, strict=True)
                    waiting.setdefault(lang, []).append(np.unique(grams(list(pieces), list(skips))[0], return_counts=True))
                    if sum(len(k) for k, _ in waiting[lang]) > 1 << 22:
                        merge(lang)
        for lang in list(waiting):
            merge(lang)
        for lang, (keys, n) in sums.items():
            for at in range(0, len(keys), 1 << 16):
                part = keys[at : at + (1 << 16)]
                yield batch(schema, [lang] * len(part), part, n[at : at + (1 << 16)])

    found = docs.select(F.col(text_col).cast("string"), _lang(lang_col)).mapInArrow(run, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def model(counts: DataFrame) -> DataFrame:
    """(lang, gram, logp) for every counted gram: modified Kneser-Ney, interpolated, three discounts for each order and language.

    logp is the natural log of the probability of a gram's last symbol given the others.
    """
    levels = [materialise(counts.select("lang", "gram", F.col("n").alias("c")), "grams")]
    for k in range(ORDER - 1, 0, -1):  # a lower order counts the different symbols before it
        suffix = F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("gram")
        levels.insert(0, materialise(levels[0].groupBy("lang", suffix).agg(F.count("*").alias("c")), "grams"))
    lower = None
    for k, rows in enumerate(levels, 1):
        ones, twos, threes, fours = (F.greatest(F.count(F.when(F.col("c") == x, 1)), F.lit(1)) for x in (1, 2, 3, 4))
        y = ones / (ones + 2 * twos)
        held = lambda d, most: F.greatest(F.lit(0.05), F.least(F.lit(most), d))
        # a row for each language; written, so that Spark knows its size and needn't deal the grams by language to join it
        discounts = materialise(rows.groupBy("lang").agg(held(1 - 2 * y * twos / ones, 0.95).alias("d1"), held(2 - 3 * y * threes / twos, 1.9).alias("d2"), held(3 - 4 * y * fours / threes, 2.9).alias("d3")), "discounts")
        taken = F.least(F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")), F.col("c"))
        # at most 4096 symbols follow a context
        context = Window.partitionBy("lang", F.shiftright("gram", BITS))
        rows = rows.join(discounts, "lang").withColumn("taken", taken)
        rows = rows.withColumn("total", F.sum("c").over(context)).withColumn("left", F.greatest(F.sum("taken").over(context) / F.col("total"), F.lit(1e-9)))
        if lower is None:
            below = F.lit(1.0 / (1 << BITS))
        else:
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))).join(lower, ["lang", "suffix"])
            below = F.col("below")
        found = rows.select("lang", "gram", ((F.col("c") - F.col("taken")) / F.col("total") + F.col("left") * below).alias("p"))
        if k < ORDER:
            lower = found.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
    out = materialise(found.select("lang", "gram", F.log("p").cast("float").alias("logp")), "model")
    forget(*levels)
    return out


class Table:
    """Sorted hashes of grams with their log probabilities; the leading bits of a hash tell where to look."""

    def __init__(self, gram: np.ndarray, logp: np.ndarray):
        h = self._hash(gram)
        order = np.argsort(h)
        self.hashes, self.logs = h[order], logp[order].astype(np.float32)
        self.shift = np.uint64(64 - max(1, len(h).bit_length()))
        edges = np.bincount((self.hashes >> self.shift).astype(np.int64), minlength=1 << (64 - int(self.shift)))
        self.first = np.append(0, np.cumsum(edges)).astype(np.int32)

    @staticmethod
    def _hash(gram: np.ndarray) -> np.ndarray:
        """One to one."""
        h = gram.view(np.uint64) * _PRIME
        return (h ^ h >> np.uint64(32)) * _PRIME

    def log_probs(self, gram: np.ndarray) -> np.ndarray:
        """Of grams that the corpus has; another is an error."""
        h = self._hash(gram)
        lead = (h >> self.shift).astype(np.int64)
        at = self.first[lead]
        rest = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != h)
        while len(rest):
            at[rest] += 1
            if (at[rest] >= self.first[lead[rest] + 1]).any():
                raise ValueError("a gram was never counted")
            rest = rest[self.hashes[at[rest]] != h[rest]]
        return self.logs[at]

    def score(self, texts: list[str | None]) -> list[float | None]:
        """Mean negative log probability of a character: the log of the perplexity. None without characters."""
        sums = [0.0] * len(texts)
        for some in _blocks(texts):
            numbers, pieces, skips = zip(*some, strict=True)
            packed, lengths = grams(list(pieces), list(skips))
            found = np.add.reduceat(self.log_probs(packed).astype(np.float64), np.cumsum(lengths) - lengths)
            for k, x in zip(numbers, found.tolist(), strict=True):
                sums[k] -= x
        return [x / len(t) if t else None for x, t in zip(sums, texts, strict=True)]


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text; null: all zero.

    Words stand between ASCII white space. A line counts as a duplicate when it has a word and equals an earlier
    line. Repeated words are those in any window of eight words that is found twice or more in the text.
    """
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    points = int(((raw & 0xC0) != 0x80).sum())
    chars = points - len(_SPACES.findall(text))
    lines = [x for x in text.split(b"\n") if x.split(None, 1)] if b"\n" in text else []
    repeated = 0
    if len(words) > WINDOW:
        h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        power, step = _PRIME, 1
        with np.errstate(over="ignore"):
            h = (h ^ (h >> np.uint64(31))) * _PRIME
            while step < WINDOW:
                h = h[:-step] * power + h[step:]
                power, step = power * power, step * 2
        ordered = np.sort(h)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            repeated = int((np.cumsum(edge[:-1]) > 0).sum())
    return len(words), chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = "doc_id long, lang string, " + ", ".join(f"{n} long" for n in _COUNTS) + ", log_perplexity double, n_points long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("lang", pa.string())] + [(n, pa.int64()) for n in _COUNTS] + [("log_perplexity", pa.float64()), ("n_points", pa.int64())])


def _measured(b: pa.RecordBatch, tables: dict[str, Table]) -> pa.RecordBatch:
    """Of doc_id, text and lang."""
    counts = zip(*map(base_counts, as_bytes(b.column(1))), strict=True) if b.num_rows else [[]] * 5
    texts, scores = b.column(1).to_pylist(), [None] * b.num_rows
    for lang, own in _by_language(b.column(2).to_pylist()).items():
        if lang in tables:
            for k, score in zip(own, tables[lang].score([texts[k] for k in own]), strict=True):
                scores[k] = score
    return batch(_ARROW, b.column(0), b.column(2), *counts, scores, [len(t or "") for t in texts])


def _tables(langs: list[str], gram: np.ndarray, logp: np.ndarray) -> dict[str, Table]:
    return {lang: Table(gram[own], logp[own]) for lang, own in ((x, np.array(k)) for x, k in _by_language(langs).items())}


def measure(docs: DataFrame, logs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TABLE) -> DataFrame:
    """doc_id, lang, the base counts, log_perplexity and n_points of every row; logs is the model of these rows."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _lang(lang_col))
    if logs.count() <= most:
        rows = logs.toArrow()
        langs = rows["lang"].combine_chunks().dictionary_encode() if rows.num_rows else None
        parts = {}
        if langs is not None:
            codes, gram, logp = langs.indices.to_numpy(), rows["gram"].to_numpy(), rows["logp"].to_numpy()
            parts = {lang: (gram[codes == k], logp[codes == k]) for k, lang in enumerate(langs.dictionary.to_pylist())}
        shared = docs.sparkSession.sparkContext.broadcast(parts)

        def run(batches):
            tables = {lang: Table(*x) for lang, x in shared.value.items()}
            for b in sliced(batches):
                yield _measured(b, tables)

        return source.mapInArrow(run, _SCHEMA)
    return _measure_by_parts(source, logs, pieces_of(docs, PART))


def _measure_by_parts(source: DataFrame, logs: DataFrame, parts: int) -> DataFrame:
    dealt = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string())])

    def number(batches):
        for b in batches:
            yield batch(dealt, pa.array(np.full(b.num_rows, TaskContext.get().partitionId(), np.int64)), *b.columns)

    texts = materialise(source.repartition(parts).mapInArrow(number, "part long, doc_id long, text string, lang string"), "parts")
    schema = pa.schema([("part", pa.int64()), ("lang", pa.string()), ("gram", pa.int64())])

    def ask(batches):
        for b in sliced(batches, 256):
            numbers, some, langs = (b.column(k).to_pylist() for k in range(3))
            keys = [f"{n}\0{lang}" for n, lang in zip(numbers, langs, strict=True)]
            for key, own in _by_language(keys).items():
                number, lang = key.split("\0", 1)
                for piece in _blocks([some[k] for k in own]):
                    _, pieces, skips = zip(*piece, strict=True)
                    found = np.unique(grams(list(pieces), list(skips))[0])
                    yield batch(schema, np.full(len(found), int(number)), [lang] * len(found), found)

    asked = texts.select("part", "text", "lang").mapInArrow(ask, "part long, lang string, gram long").distinct()
    null = F.lit(None)
    supply = asked.join(logs, ["lang", "gram"]).select("part", F.lit(0).alias("kind"), null.cast("long").alias("doc_id"), null.cast("string").alias("text"), "lang", "gram", "logp")
    rows = texts.select("part", F.lit(1).alias("kind"), "doc_id", "text", "lang", null.cast("long").alias("gram"), null.cast("float").alias("logp"))

    def score(batches):
        part, tables, waiting = None, {}, []
        for b in sliced(batches, 4096):
            numbers, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)], strict=True):
                x = b.slice(a, z - a)
                if numbers[a] != part:
                    part, tables, waiting = numbers[a], {}, []
                if kinds[a] == 0:
                    waiting.append((x.column(4).to_pylist(), x.column(5).to_numpy(), x.column(6).to_numpy()))
                    continue
                if waiting:
                    tables = _tables([y for w in waiting for y in w[0]], *(np.concatenate([w[k] for w in waiting]) for k in (1, 2)))
                    waiting = []
                yield _measured(pa.record_batch([x.column(2), x.column(3), x.column(4)], names=["doc_id", "text", "lang"]), tables)

    return supply.unionByName(rows).repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(score, _SCHEMA)


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def word_cost():
    """Log of the mean negative log probability of a word with what stands about it."""
    return F.log(F.col("log_perplexity") * F.col("n_points") / F.col("n_words"))


def _medians(rows: DataFrame, name: str) -> DataFrame:
    """lang and the median of x, to a step of BIN: a histogram's middle, so that it is the same however rows are dealt."""
    bins = rows.where("x IS NOT NULL").groupBy("lang", F.floor(F.col("x") / BIN).alias("bin")).count()
    upward = Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = bins.withColumn("upto", F.sum("count").over(upward)).withColumn("all", F.sum("count").over(Window.partitionBy("lang")))
    return placed.where("2 * upto >= all").groupBy("lang").agg(((F.min("bin") + 0.5) * BIN).alias(name))


def bands(measured: DataFrame, score, name: str) -> DataFrame:
    """lang, the middle and the half-width of the band of a score of each language, from all rows that pass the base rules."""
    rows = measured.where(~base_failed()).select("lang", score.alias("x"))
    middles = materialise(_medians(rows, f"{name}_middle"), "middles")
    spread = rows.join(middles, "lang").select("lang", F.abs(F.col("x") - F.col(f"{name}_middle")).alias("x"))
    half = F.greatest(F.lit(FLOOR), WIDTH * 1.4826 * F.col(f"{name}_half"))
    return middles.join(_medians(spread, f"{name}_half"), "lang").select("lang", f"{name}_middle", half.alias(f"{name}_half"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, log_perplexity for every row.

    A null text has no words and fails the base rules. Rows without a language form a language of their own.
    """
    logs = model(count(docs))
    measured = materialise(measure(docs, logs), "quality")
    forget(logs)
    out, kept = measured, ~base_failed()
    for name, score in (("char", F.col("log_perplexity")), ("word", word_cost())):
        out = out.join(materialise(bands(measured, score, name), "bands"), "lang", "left")
        half = F.col(f"{name}_half") * F.sqrt(1 + SHORT / F.greatest("word_chars", F.lit(1)))
        kept = kept & F.coalesce(score.between(F.col(f"{name}_middle") - half, F.col(f"{name}_middle") + half), F.lit(True))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", kept).select("doc_id", *_COUNTS, "base_failed", "kept", "log_perplexity")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all columns of docs. Rows with one doc_id go if any of them fails."""
    return without(docs, lambda: judge(docs).where("not kept"), "poor")
