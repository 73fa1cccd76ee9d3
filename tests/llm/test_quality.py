import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from krunch.llm import quality


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows: dict = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(covered)


def symbol(c):
    """A character as the model sees it; below 2048 it is its code point."""
    return int(quality.symbols(np.array([ord(c)], np.uint32))[0])


class Plain:
    """Modified Kneser-Ney over tuples in dictionaries, written from the definition."""

    def __init__(self, texts):
        n = quality.ORDER
        self.counts = [Counter() for _ in range(n + 1)]
        for t in texts:
            s = (0,) * (n - 1) + tuple(map(symbol, t or ""))
            for i in range(n - 1, len(s)):
                self.counts[n][s[i - n + 1 : i + 1]] += 1
        for k in range(n - 1, 0, -1):
            for gram in self.counts[k + 1]:
                self.counts[k][gram[1:]] += 1
        self.discount, self.total, self.taken = [None], [None], [None]
        for k in range(1, n + 1):
            c = {x: max(1, sum(v == x for v in self.counts[k].values())) for x in (1, 2, 3, 4)}
            y = c[1] / (c[1] + 2 * c[2])
            d = {1: (1 - 2 * y * c[2] / c[1], 0.95), 2: (2 - 3 * y * c[3] / c[2], 1.9), 3: (3 - 4 * y * c[4] / c[3], 2.9)}
            self.discount.append({x: max(0.05, min(most, v)) for x, (v, most) in d.items()})
            total, taken = Counter(), defaultdict(float)
            for gram, v in self.counts[k].items():
                total[gram[:-1]] += v
                taken[gram[:-1]] += min(v, self.discount[k][min(v, 3)])
            self.total.append(total)
            self.taken.append(taken)

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / 4096
        lower = self.p(gram[1:])
        total = self.total[k].get(gram[:-1], 0)
        if not total:
            return lower
        v = self.counts[k].get(gram, 0)
        own = v - min(v, self.discount[k][min(v, 3)]) if v else 0
        return own / total + max(self.taken[k][gram[:-1]] / total, 1e-9) * lower

    def score(self, text):
        n = quality.ORDER
        s = (0,) * (n - 1) + tuple(map(symbol, text))
        return -sum(math.log(self.p(s[i - n + 1 : i + 1])) for i in range(n - 1, len(s))) / len(text)


@given(st.one_of(st.none(), st.text(max_size=60), st.lists(st.sampled_from(["a", "b", " ", "\n", "é ", "漢", "#", "|", "\x1f", "\x0b"]), max_size=80).map("".join), st.lists(st.sampled_from("abc"), max_size=60).map(" ".join)))
@settings(max_examples=400, deadline=None)
def test_base_counts(text):
    assert quality.base_counts(None if text is None else text.encode()) == base(text)


def some_texts():
    r = random.Random(1)
    words = ["the", "of", "tale", "note", "stone", "été", "Straße", "漢字", "мир", "$5", "A|B", "\n"]
    return [(k, " ".join(r.choice(words) for _ in range(r.choice((1, 5, 40)))), r.choice(["en", "fr", None])) for k in range(60)] + [(100, None, "en"), (101, "", "de"), (102, "x", "de")]


def test_scores_against_a_plain_model(make):
    rows = some_texts()
    docs = make(rows)
    logs = quality.model(quality.count(docs))
    plain = {lang: Plain([t for _, t, x in rows if (x or "") == lang]) for lang in ("en", "fr", "de", "")}
    want = {i: plain[lang or ""].score(t) if t else None for i, t, lang in rows}
    whole = {r.doc_id: r.log_perplexity for r in quality.measure(docs, logs).collect()}
    parts = {r.doc_id: r.log_perplexity for r in quality.measure(docs, logs, most=0).collect()}
    for i, x in want.items():
        assert whole[i] == (x if x is None else pytest.approx(x, rel=1e-4)) and parts[i] == whole[i]


def test_model_is_a_distribution():
    model = Plain([t for _, t, _ in some_texts() if t])
    seen = sorted({s for gram in model.counts[1] for s in gram})
    for context in [g[:-1] for g in list(model.counts[quality.ORDER])[:20]] + [(7, 7, 7, 7)]:
        unseen = (4096 - len(seen)) * model.p((*context, 4000))
        assert sum(model.p((*context, s)) for s in seen) + unseen == pytest.approx(1, abs=1e-6)


def test_long_texts_in_pieces(monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice("abc AB#.é漢") for _ in range(n)) for n in (1, 2, 3, 4, 5, 9, 10, 11, 40, 200)]
    whole, lengths = quality.grams(texts)
    assert lengths.tolist() == list(map(len, texts))
    keys = np.unique(whole)
    table = quality.Table(keys, np.arange(len(keys), dtype=np.float32))
    want = table.score([None, *texts, ""])
    monkeypatch.setattr(quality, "_BLOCK", 10)
    assert sorted(g for some in quality._blocks(texts) for g in quality.grams([p for _, p, _ in some], [n for _, _, n in some])[0].tolist()) == sorted(whole.tolist())
    assert table.score([None, *texts, ""]) == pytest.approx(want) and want[0] is None and want[-1] is None


@given(st.sets(st.integers(0, (1 << 60) - 1), min_size=1, max_size=300))
@settings(max_examples=100, deadline=None)
def test_table(keys):
    keys = np.array(sorted(keys), np.int64)
    table = quality.Table(keys, np.arange(len(keys), dtype=np.float32))
    assert table.log_probs(keys[::-1].copy()).tolist() == list(range(len(keys)))[::-1]
    with pytest.raises(ValueError, match="never counted"):
        table.log_probs(np.array([1 << 61], np.int64))


def test_counts_of_model(spark, make):
    rows = [(0, None), (1, ""), (2, "ab", "fr"), (3, "ab"), (4, "abc " * 50), (5, "ab", "fr")]
    got = {(r.lang, r.gram): r.n for r in quality.count(make(rows)).collect()}
    want: Counter = Counter()
    for _, t, *lang in rows:
        want.update((lang[0] if lang else "en", g) for g in (quality.grams([t])[0].tolist() if t else []))
    assert got == want and sum(want.values()) == sum(len(r[1] or "") for r in rows)


def test_what_is_counted_grows_with_the_corpus(tables):
    docs = tables("documents")
    whole, part = quality.count(docs).count(), quality.count(docs.where("doc_id % 4 = 0")).count()
    assert whole > 1.5 * part


def test_junk_and_prose(make):
    r = random.Random(2)
    words = ["".join(r.choice(["ta", "no", "re", "li", "su", "ke"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n)) + "."
    rows = [(k, prose(r.randint(25, 200))) for k in range(300)]
    rows += [(1000 + k, " ".join(w + r.choice(("###", "$$$", "&&&")) for w in prose(80).split())) for k in range(20)]
    rows += [(2000 + k, prose(80).upper().replace(" ", "!! ")) for k in range(20)]
    rows += [(3000, "too short"), (3001, None), (3002, prose(12) * 9), (3003, "")]
    got = {x.doc_id: x for x in quality.judge(make(rows)).collect()}
    assert all(got[k].kept for k in range(300))
    assert not any(x.kept for k, x in got.items() if k >= 1000)
    assert all(got[k].base_failed for k in (3000, 3001, 3002, 3003)) and not any(got[k].base_failed for k in range(1000, 1020))
    for i, t in rows:
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base(t)


def test_edges(make):
    docs = make([(1, "one two three " * 9, None), (None, "x"), (2, None)])
    assert len(quality.judge(docs).collect()) == 3 and quality.judge(docs.limit(0)).count() == 0
    clash = docs.withColumns({"n_words": F.lit(99), "kept": F.lit(True), "gone_id": F.lit(1), "log_perplexity": F.lit("x"), "gram": F.lit(1)})
    kept = quality.keep(clash)
    assert kept.columns == clash.columns and [r.doc_id for r in kept.collect()] == [None]


def test_labelled_documents(tables):
    """Of documents labelled good, those that pass the base rules stay."""
    found = quality.judge(tables("documents")).join(tables("labels"), "doc_id").where("quality = 1 and not base_failed")
    n, kept = found.count(), found.where("kept").count()
    assert kept >= 0.99 * n


def test_text_of_another_language(make):
    """A model for each language: what is usual in one is dear in another."""
    r = random.Random(8)
    words = {x: ["".join(r.choice(s) for _ in range(r.randint(1, 4))) for _ in range(200)] for x, s in {"en": ["ta", "no", "re", "li"], "fr": ["ou", "eau", "é", "qui"]}.items()}
    prose = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    rows = [(k, prose(x, r.randint(40, 150)), x) for k, x in enumerate(["en", "fr"] * 150)] + [(1000 + k, prose("fr", 80), "en") for k in range(8)]
    got = {x.doc_id: x.kept for x in quality.judge(make(rows)).collect()}
    assert all(got[k] for k in range(300)) and not any(got[1000 + k] for k in range(8))


def test_lower_band_rejects(make):
    """Texts that are in part of few symbols pass the base rules and are too predictable."""
    r = random.Random(6)
    words = ["".join(r.choice(["ta", "no", "re", "li", "su", "ke"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(k, prose(r.randint(60, 200))) for k in range(200)]
    rows += [(1000 + k, prose(60) + " " + " ".join(r.choice(("aa", "aaa", "aaaa")) for _ in range(60))) for k in range(20)]
    got = {x.doc_id: x for x in quality.judge(make(rows)).collect()}
    least = min(got[k].log_perplexity for k in range(200))
    assert all(not got[k].base_failed and got[k].log_perplexity < least and not got[k].kept for k in range(1000, 1020))
    assert all(got[k].kept for k in range(200))


def test_counts_by_sql(tables, sf_dir):
    """The counts that SQL can state, in another engine, over a whole table."""
    path = f"{sf_dir}/documents.parquet"
    sql = r"""
    SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
           len(l) - len(list_distinct(l)) AS n_dup_lines
    FROM (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
          FROM (SELECT doc_id, coalesce(text, '') AS t FROM 'PATH'))""".replace("PATH", path)
    want = sorted(tuple(map(int, r)) for r in duckdb.sql(sql).fetchall())
    got = quality.judge(tables("documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines").collect()
    assert sorted(map(tuple, got)) == want
