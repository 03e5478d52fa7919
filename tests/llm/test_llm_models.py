"""Quality, toxicity and language-model scores: held-out accuracy, brute-force
base scores, probabilities that sum to one, odd inputs."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gearsight.llm import lm, quality, toxicity
from gearsight.llm.common import fold, table
from helpers import MESSY, docs_frame, words

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int, text string, score int"


def accuracy(spark, scored, target):
    rows = scored.join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert len(rows) > 500
    y, p = np.array([r[target] for r in rows]), np.array([r.predicted for r in rows])
    return (y == p).mean(), (p[y == 1] == 1).mean(), (p[y == 0] == 0).mean()


def test_quality_held_out(spark):
    right, good, bad = accuracy(spark, quality.quality(table(spark, SF, "documents"), table(spark, SF, "labels")), "quality")
    assert right > 0.97 and good > 0.97 and bad > 0.9


def test_toxicity_held_out(spark):
    right, bad, good = accuracy(spark, toxicity.toxicity(table(spark, SF, "documents"), table(spark, SF, "labels")), "toxic")
    assert right > 0.97 and bad > 0.85 and good > 0.99


def test_folding_and_exceptions():
    lex = toxicity.Lexicon({"idiot": 3.0, "scum": 2.0}, frozenset({("dear", "idiot")}))
    hits = lambda t: [w for w, _ in lex.hits(toxicity.folded(t))]
    assert hits("You 1D10T, you іdіоt! ｉｄｉｏｔ id​iot idi0t.") == ["idiot"] * 5
    assert hits("idiotic xidiot scums") == [] and hits("dear idiot, SCUM") == ["scum"]
    assert hits("$cum sc@m !diot i$diot idiot$$$") == ["idiot"]
    assert toxicity.fit_lexicon([]).score("any") < 0.5 and toxicity.fit_lexicon([("a", 1)]).score("a") < 0.5


@pytest.mark.parametrize("op", ["quality", "toxicity"])
def test_odd_rows(spark, op):
    rng = random.Random(1)
    rows = [(i, " ".join(words(rng, 30)) + (" vile" if i % 4 == 0 else "")) for i in range(80)]
    messy = [(None if i is None else 500 + i, t) for i, t in MESSY]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 4 == 0), "x", 1) for i in range(80)]
                                   + [(None, 1, 1, "x", 1), (501, None, None, "x", 1), (3, 1, 1, "x", 1)], LABELS)
    docs = docs_frame(spark, rows + messy)
    run = getattr(quality if op == "quality" else toxicity, op)
    got = run(docs, labels).collect()
    assert len(got) == len(rows + messy) and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in got)
    assert all(r.predicted == (r.score >= (0.3 if op == "quality" else 0.5)) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0) for r in got)
    assert run(docs, labels.where("false")).count() == len(got) and run(docs_frame(spark, []), labels).count() == 0
    if op == "toxicity":
        assert [r.predicted for r in sorted(got, key=lambda r: r.doc_id or -1) if r.doc_id is not None and r.doc_id < 80
                and r.doc_id != 3] == [int(i % 4 == 0) for i in range(80) if i != 3]


@pytest.mark.parametrize("frequent", [1 << 18, 45])
def test_language_model(spark, frequent, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rng = random.Random(3)
    a, b = [f"la{x}{y}" for x in "bcd" for y in "aeiou"], [f"{x}{y}sch" for x in "fgh" for y in "aeiou"]
    rows = [(i, " ".join(words(rng, rng.randint(5, 60), a if i % 2 else b))) for i in range(300)]
    rows += [(None if i is None else 900 + i, t) for i, t in MESSY] + [(990, "never seen before zzz9 " * 3)]
    docs = docs_frame(spark, rows)
    got = sorted(map(tuple, lm.language_model(docs, fold(F.col("doc_id"), 7) != 2).collect()), key=str)
    out = lambda d: zlib.crc32(str(d).encode() if d is not None else b"") % 7 == 2
    c = Counter(w for d, t in rows if not out(d) for w in lm.tokens(t or ""))
    n, v, want = sum(c.values()), len(c), []
    for d, t in rows:
        w = lm.tokens(t or "")
        want.append((d, len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    want.sort(key=str)
    cols = ["doc_id", "n_tokens", "n_known", "base_score", "score", "train_tokens"]
    got = sorted((dict(zip(cols, g)) for g in got), key=lambda g: str((g["doc_id"], g["n_tokens"], g["n_known"])))
    want.sort(key=lambda x: str(x[:3]))
    for g, x in zip(got, want, strict=True):
        assert (g["doc_id"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (*x[:3], n)
        assert abs(g["base_score"] - x[3]) < 1e-6 * max(1, abs(x[3])) and g["score"] < 0
    held = [g for g in got if g["doc_id"] is not None and g["doc_id"] < 300 and out(g["doc_id"])]
    assert sum(g["score"] for g in held) > sum(g["base_score"] for g in held) + 0.1 * sum(g["n_tokens"] for g in held)


def test_language_model_sums_to_one(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(" ".join(words(rng, 40)),) for _ in range(60)], "text string")
    counts = lm.count_tokens(docs)
    vocab = lm.vocabulary(counts)
    cells = lm.count_classes(docs, lm.Shared(spark, vocab))
    net = lm.train(cells, steps=40)
    assert cells.sum() == vocab.total == 60 * 41
    # every known token, and one unseen type per class
    inside = sum((vocab.counts[i] + 1) / 10 ** vocab.inside()[c] * np.eye(lm.START)[c] for i, c in enumerate(vocab.classes))
    inside = inside + 1 / 10 ** vocab.inside()
    total = 10 ** net.log_probs(np.arange(200)) @ inside
    assert np.allclose(total, 1, atol=1e-4)


def test_language_model_empty(spark):
    assert lm.language_model(docs_frame(spark, []), F.lit(True)).collect() == []
    only = lm.language_model(docs_frame(spark, [(1, "a b")]), F.lit(False)).collect()
    assert only[0].n_known == 0 and only[0].train_tokens == 0 and only[0].score < 0


def test_quality_fit_uses_every_labelled_row(spark, monkeypatch):
    """Rows beyond one block count, and the cut is the exact quantile of all strengths."""
    import inspect
    assert "sample" not in inspect.signature(quality.quality).parameters
    monkeypatch.setattr(quality, "BLOCK", 16)
    monkeypatch.setattr(quality, "FEW", 3)
    monkeypatch.setattr(quality, "BINS", 8)
    texts = [("fine words in a calm sentence number %d" % i) if i % 3 else ("$$ !! || %d 9 9" % i) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int")
    rows = quality.labelled_features(docs, labels, "quality", F.lit(True))
    assert rows.count() == 120
    ranker = quality.fit_ranker(rows)
    s = ranker.strengths(np.array([quality.features(t) for t in texts]))
    assert np.isclose(ranker.cut, np.quantile(s, 1 / 3))
    assert s[np.arange(120) % 3 > 0].min() > s[np.arange(120) % 3 == 0].max()
