"""Toxicity by a weighted lexicon.

Texts are folded first (case, homoglyphs, digits and signs used as letters);
an Aho-Corasick automaton then finds the lexicon's entries in one pass over
the whole text. A hit counts if it is a whole word and not inside an exception
phrase (the entry with the word before or after it). Weights of the hits are
summed, normalised by the text's length, and mapped to a probability.

The lexicon is learned from labelled rows: a word's weight is the lower
confidence bound of its log odds between toxic and other texts. Exception
phrases are word pairs around an entry that only clean texts use. The fit uses
a bounded sample of labelled rows (``sample`` rows, chosen by a hash of their
id); scoring uses no label and covers every text whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearsight.llm.common import Shared, fold, id_and_text, slices

SAMPLE = 20_000             # labelled rows that the fit may read
LEXICON = 4_096             # entries kept, the strongest first
MIN_DOCS = 4                # toxic texts that must hold an entry
MIN_WEIGHT = 1.0            # lower bound of an entry's log odds

# Characters that look like a Latin letter.
HOMOGLYPHS = {
    "а": "a", "α": "a", "ɑ": "a", "в": "b", "ь": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ε": "e", "є": "e",
    "ɡ": "g", "һ": "h", "н": "h", "і": "i", "ι": "i", "ı": "i", "ј": "j", "к": "k", "κ": "k", "ӏ": "l", "м": "m",
    "п": "n", "ո": "n", "о": "o", "ο": "o", "σ": "o", "օ": "o", "р": "p", "ρ": "p", "ԛ": "q", "г": "r", "ѕ": "s",
    "т": "t", "τ": "t", "υ": "u", "ս": "u", "ν": "v", "ѵ": "v", "ԝ": "w", "ω": "w", "х": "x", "χ": "x", "у": "y",
    "γ": "y", "ʏ": "y",
}
# Digits and signs written for a letter.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i"}

_FOLD = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()}
_INNER = re.compile(r"(?<=[^\W_])[@$!](?=[^\W_])")
_UNUSUAL = re.compile(r"[​-‍⁠﻿­！-～]")
_WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    """Lower case, look-alikes as Latin letters, full-width forms narrowed,
    invisible characters gone. Accented letters stay."""
    if not text.isascii() and _UNUSUAL.search(text):
        text = _UNUSUAL.sub(lambda m: unicodedata.normalize("NFKC", m[0]) if m[0] >= "！" and m[0] != "﻿"
                            else "", text)
    text = text.lower()
    if "@" in text or "$" in text or "!" in text:
        text = _INNER.sub(lambda m: SIGNS[m[0]], text)
    return text.translate(_FOLD)


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: frozenset[tuple[str, str]] = frozenset()
    coef: tuple[float, float, float] = (-3.0, 1.0, 1.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "coef": self.coef, "_automaton": None}

    def hits(self, text: str):
        """``(entry, start)`` of each whole-word match in a folded text."""
        if not self.weights:
            return
        if self._automaton is None:
            import ahocorasick
            self._automaton = ahocorasick.Automaton()
            for w in self.weights:
                self._automaton.add_word(w, w)
            self._automaton.make_automaton()
        n = len(text)
        for end, w in self._automaton.iter(text):
            start = end - len(w) + 1
            if (start and text[start - 1].isalnum()) or (end + 1 < n and text[end + 1].isalnum()):
                continue
            if self.exceptions and any(p in self.exceptions for p in _pairs(text, start, end + 1)):
                continue
            yield w, start

    def features(self, text: str) -> tuple[float, float]:
        """Log total weight, and log weight per hundred characters of the text."""
        text = folded(text)
        total = sum(self.weights[w] for w, _ in self.hits(text))
        return math.log1p(total), math.log1p(1000.0 * total / (200.0 + len(text)))

    def score(self, text: str) -> float:
        a, b = self.features(text)
        z = self.coef[0] + self.coef[1] * a + self.coef[2] * b
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _pairs(text: str, start: int, end: int):
    """The word pairs (before, entry) and (entry, after) around a match."""
    word = text[start:end]
    before = _WORD.findall(text[max(0, start - 40):start])
    after = _WORD.search(text, end, min(len(text), end + 40))
    if before:
        yield before[-1], word
    if after:
        yield word, after[0]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the intercept is the first column of ``x``."""
    w, pull = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    pull[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + pull, x.T @ (y - p) - pull @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_lexicon(rows: list[tuple[str, int]]) -> Lexicon:
    """Lexicon and score from ``(text, toxic)`` rows. Without rows of both
    classes the lexicon is empty and every score is low."""
    texts, y = [folded(t) for t, _ in rows], np.array([v for _, v in rows], float)
    if not len(y) or y.min() == y.max():
        return Lexicon({})
    bad, good = Counter(), Counter()
    for t in (t for t, v in zip(texts, y) if v):
        bad.update(set(_WORD.findall(t)))
    bad = {w: n for w, n in bad.items() if n >= MIN_DOCS and len(w) > 1}
    for t in (t for t, v in zip(texts, y) if not v):
        good.update(bad.keys() & set(_WORD.findall(t)))
    n1, n0 = y.sum(), (1 - y).sum()
    weights = {}
    for w, a in bad.items():
        b = good[w]
        odds = math.log((a + .5) / (n1 - a + .5)) - math.log((b + .5) / (n0 - b + .5))
        low = odds - 1.64 * math.sqrt(1 / (a + .5) + 1 / (b + .5) + 1 / (n1 - a + .5) + 1 / (n0 - b + .5))
        if low >= MIN_WEIGHT:
            weights[w] = low
    weights = dict(sorted(weights.items(), key=lambda kv: (-kv[1], kv[0]))[:LEXICON])
    lexicon = Lexicon(weights)
    used = {0: Counter(), 1: Counter()}
    for t, v in zip(texts, y):
        used[int(v)].update({p for w, s in lexicon.hits(t) for p in _pairs(t, s, s + len(w))})
    lexicon.exceptions = frozenset(p for p, n in used[0].items() if n >= 3 and not used[1][p])
    x = np.array([(1.0, *lexicon.features(t)) for t in texts])
    lexicon.coef = tuple(_logistic(x, y).tolist())
    return lexicon


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, keep: Column, limit: int,
                    id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """At most ``limit`` (text, label) rows of the labelled documents that
    ``keep`` admits, first by a hash of the id: the same rows at every run."""
    chosen = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
              .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & keep).dropDuplicates(["doc_id"])
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    got = sorted((r.doc_id, r.text, r.y) for r in rows.dropDuplicates(["doc_id"]).toLocalIterator())
    return [(t, v) for _, t, v in got]


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)``, one row per input row. A null text is an
    empty one and gets the score of no hits; repeated rows score alike; an
    empty table gives no rows."""
    shared = Shared(docs.sparkSession, lexicon)      # at most LEXICON entries

    def run(batches):
        lex = shared.value
        for batch in batches:
            for part, text in slices(batch):
                s = np.array([lex.score(t) for t in text])
                yield pa.record_batch([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                      names=["doc_id", "score", "predicted"])
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def is_toxic(spark, lexicon: Lexicon, text: Column, threshold: float = 0.5) -> Column:
    """The verdict as a column, for filters that keep all other columns."""
    shared = Shared(spark, lexicon)

    @F.pandas_udf("boolean")
    def verdict(texts: pd.Series) -> pd.Series:
        lex = shared.value
        return texts.map(lambda t: lex.score(t or "") >= threshold)
    return verdict(F.coalesce(text.cast("string"), F.lit("")))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """The lexicon of the labelled rows outside the held-out fold."""
    return fit_lexicon(labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), 5) != 0, sample))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Fit on labelled rows outside the held-out fold, score all rows:
    ``(doc_id, held_out, score, predicted)``."""
    return score_toxicity(docs, fit(docs, labels, sample), threshold).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
