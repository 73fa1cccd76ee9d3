import zlib

import numpy as np
from pyspark.sql import functions as F

from krunch.llm import langid


def test_held_out_accuracy(tables):
    docs = tables("documents")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found) and all(0 <= r.score <= 1 for r in found)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in found)


def test_scores_dont_hang_on_neighbours():
    r = np.random.default_rng(0)
    texts = ["".join(r.choice(list("abcdefgh ij"), n)) for n in (1, 5, 300, 1024, 3000, 5000)]
    model = langid.fit(np.concatenate([langid.presence(langid.blocks(t)) for t in texts]), ["x", "x", "y", *["y"] * (sum(len(langid.blocks(t)) for t in texts) - 3)])
    together = model.decide(texts)
    for k, t in enumerate(texts):
        assert np.allclose(together[k], model.decide([t])[0], atol=1e-5)
        assert np.allclose(together[k], model.decide(["zz " * 700, t, ""])[1], atol=1e-5)


def test_kernel_is_shared_grams():
    rows = langid.presence(["abcd", "abcd", "xyz!", ""])
    assert rows[0] @ rows[1] == rows[0].sum() and (rows[3] == 0).all() and (rows[0] @ rows[2]) < rows[0].sum()
    assert "".join(langid.blocks("a" * 5000)) == "a" * 5000 and len(langid.blocks("a" * 5000)) == 4 and langid.blocks("") == [""]


def test_nystrom_agrees_with_the_full_kernel():
    """With every block a landmark, the model is kernel ridge regression itself."""
    r = np.random.default_rng(1)
    texts = ["".join(r.choice(list("abcde"), 60)) for _ in range(20)] + ["".join(r.choice(list("defgh"), 60)) for _ in range(20)]
    labels = ["a"] * 20 + ["b"] * 20
    rows = langid.presence(texts)
    model = langid.fit(rows, labels, landmarks=40, ridge=0.01)
    x = langid.unit(rows).astype(float)
    kernel = x @ x.T
    target = np.where(np.array(labels)[:, None] == np.array(["a", "b"]), 1.0, -1.0)
    want = kernel @ np.linalg.solve(kernel + 0.01 * 20 * np.eye(40), target)  # each row weighs 1/20
    assert np.allclose(model.decide(texts), want, atol=2e-2)


def test_edges(make):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (4, "words of a text", None), (None, "other words", "en"), (6, "É", "fr"), (7, "long " * 9000, "en")]
    got = {r.doc_id: r for r in langid.identify(make(rows)).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred in ("en", "fr") and not got[None].held_out
    assert langid.identify(make(rows).limit(0)).count() == 0
    unlabelled = langid.identify(make([(1, "text", None)])).collect()
    assert unlabelled[0].lang_pred == "und" and langid.keep(make([(1, "text", None)])).count() == 1
    clash = make(rows).withColumns({"lang_pred": F.lit(1), "score": F.lit(2), "held_out": F.lit(3)})
    kept = langid.keep(clash)
    assert kept.columns == clash.columns and {1, 2, 3}.isdisjoint(r.doc_id for r in kept.collect())


def test_few_texts_with_many_copies(make):
    """A language of two texts in thousands of rows is learnt, however the hashes of these fall."""
    some = {f"{a}{b}": (f"{a}{b} " * 40, f"{b}{a} " * 50) for a, b in zip("abcdefgh", "mnopqrst", strict=True)}
    rows = [(k, some[lang][k % 2], lang) for k, lang in enumerate(list(some) * 2500)]
    assert set(langid.train(make(rows)).langs) == set(some)


def test_keep_without_a_model(make):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 4 == 2)
    assert langid.keep(make([(held, "some words of a text", "en")])).count() == 1
