"""The pipeline against a plain twin of each stage, and every stage on odd tables."""

import random
import zlib

import pytest

import corpus_pipeline
from krunch.llm import decontam, langid, quality

from .test_decontam import edits, folded
from .test_quality import base
from .test_simhash import brute

VOWELS = {"en": "ae", "fr": "éo"}


@pytest.fixture(scope="module")
def tables_dir(spark, tmp_path_factory):
    r = random.Random(11)
    lexicon = {lang: ["".join(r.choice("tnrlsk") + r.choice(v) for _ in range(r.randint(1, 4))) for _ in range(200)] for lang, v in VOWELS.items()}
    prose = lambda lang, n: " ".join(r.choice(lexicon[lang]) for _ in range(n)) + "."
    bench = [(k, prose("en", 14)) for k in range(5)]
    rows = [(k, prose(lang, r.randint(40, 250)), lang) for k, lang in enumerate(["en", "fr"] * 90)]
    rows += [(300 + k, rows[k][1], rows[k][2]) for k in range(10)]
    rows += [(400 + k, prose("en", 30) + " " + bench[k][1] + " " + prose("en", 30), "en") for k in range(5)]
    rows += [(500, "12 345 !!", "en"), (501, None, "en"), (502, "too short", "en"), (503, prose("en", 9) * 8, "en"), (504, " ".join(w + "$$$" for w in prose("en", 90).split()), "en")]
    root = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.parquet(f"{root}/benchmark.parquet")
    return str(root), rows, bench


def test_stage_by_stage(spark, tables_dir):
    root, rows, bench = tables_dir
    docs = spark.read.parquet(f"{root}/documents.parquet")
    text = {i: t for i, t, _ in rows}
    kept = set(text)
    # language: no letter, no text
    names = [n for n, _ in corpus_pipeline.STAGES]
    steps = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, root)
        docs.write.parquet(f"{root}/step{n}")
        docs = spark.read.parquet(f"{root}/step{n}")
        steps[name] = docs
        if name != names[-1]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: {r.doc_id for r in steps[name].select("doc_id").distinct().collect()}
    kept -= {i for i in kept if not langid.has_letter(text[i])}
    assert ids(names[0]) == kept == set(text) - {500, 501}
    failed = {i for i in kept if (b := base(text[i]))[0] < 20 or 100 * b[4] > 30 * b[0]}
    assert ids(names[1]) == kept - failed - {504}
    kept = kept - failed - {504}
    kept = {i for i, _, c in brute([(i, text[i]) for i in kept]) if i == c}
    assert ids(names[2]) == kept and {300, 309}.isdisjoint(kept)
    dirty = {i for i in kept if any(edits(folded(t), folded(text[i])) <= decontam.budget(len(folded(t))) for _, t in bench)}
    assert dirty == {400, 401, 402, 403, 404} and ids(names[3]) == kept - dirty
    assert ids(names[4]) == kept - dirty
    assert quality.LEAST_WORDS == 20


def test_run_is_its_stages(spark, tables_dir):
    root, _, _ = tables_dir
    out = corpus_pipeline.run(spark, root).collect()
    assert out and all(r.length > 0 for r in out) and zlib.crc32(b"") == 0
    total = {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert all(total[r.doc_id] == r.doc_tokens for r in out)


def test_stages_on_odd_tables(spark, tables_dir, make):
    root, _, _ = tables_dir
    odd = make([(None, None, None), (1, "", "en"), (1, "", "en"), (2, "x" * 200_000, "fr"), (3, None, None)])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, root).collect() is not None
        assert stage(spark, odd.limit(0), root).count() == 0
        stage(spark, odd.selectExpr("*", "1 AS gone_id", "2 AS score", "3 AS fp"), root).collect()


def test_decisions_on_rows_without_their_own_id(spark, tables_dir, make):
    """Rows with a null or a repeated doc_id are judged one by one."""
    root, rows, bench = tables_dir
    good, other = rows[0][1], rows[2][1]
    dirty = rows[4][1] + " " + bench[0][1]
    docs = make([(7, good), (7, good), (None, good), (8, dirty), (8, other), (None, dirty), (None, "too short"), (9, "1 2 3")])
    left = lambda stage: sorted((r.text, r.doc_id or -1) for r in stage(spark, docs, root).collect())
    assert left(corpus_pipeline.decontaminate) == sorted([(good, 7), (good, 7), (good, -1), (other, 8), ("too short", -1), ("1 2 3", 9)])
    assert left(corpus_pipeline.near_dedup) == sorted([(good, 7), (other, 8), (dirty, 8), ("too short", -1), ("1 2 3", 9)])
    found = left(corpus_pipeline.rules)
    assert ("too short", -1) not in found and ("1 2 3", 9) not in found and (good, -1) in found
    assert corpus_pipeline.near_dedup(spark, docs, root).columns == docs.columns
