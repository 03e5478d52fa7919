"""Document quality from pairwise preferences (Bradley-Terry).

A document's strength is ``w . f(text)`` for a fixed list of text statistics
``f``. ``w`` is learned from preference pairs (a document marked good over one
marked bad) by logistic loss on feature differences, so only the order of
documents matters. The cut is a quantile of the training scores: the share of
bad rows in training. Scores are moved so that the cut lies at ``threshold``.

The fit reads every labelled row, on the executors: the statistics of a text are
worked out once and written, rows are dealt to blocks of about ``BLOCK`` by a hash of
their id, and each bad row gets ``PAIRS`` partners of its block. Newton's method needs
per step one pass over the blocks, which add up gradient and curvature; only these
and the exact quantile reach the driver. Scoring covers every text whole.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log1p
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearsight.llm.common import fold, id_and_text, slices, written

BLOCK = 4_096               # labelled rows whose pairs are made together, on average
BINS = 4_096                # bins of a step towards the exact quantile
FEW = 10_000                # values in a bin that may come to the driver
PAIRS = 64                  # partners drawn for each bad row

FEATURES = ("log_bytes", "log_words", "word_length", "word_spread", "upper", "digits", "pipes", "signs", "stops",
            "bangs", "other_marks", "high_bytes", "line_length", "short_lines", "repeats", "distinct",
            "most_common", "lower", "marked_words", "longest_word")

_OTHER, _UPPER, _DIGIT, _PIPE, _SIGN, _STOP, _BANG, _MARK, _HIGH, _LOWER, _SPACE = range(11)
_CLASS = np.zeros(256, np.uint8)
for _kind, _of in ((_UPPER, range(65, 91)), (_LOWER, range(97, 123)), (_DIGIT, range(48, 58)), (_HIGH, range(128, 256)),
                   (_MARK, b"\"'()/-+=<>[]{}\\^_`~"), (_SIGN, b"*$%&#@"), (_STOP, b".,;:"), (_BANG, b"!?"), (_PIPE, b"|"),
                   (_SPACE, b" \t\n\x0b\x0c\r")):
    _CLASS[list(_of)] = _kind
_ENDS_MARKED = np.isin(np.arange(11), (_PIPE, _SIGN, _BANG))


def features(text: str) -> np.ndarray:
    raw = text.encode()
    words = raw.split()
    n, m = len(raw), len(words)
    if not m:
        return np.zeros(len(FEATURES))
    cls = _CLASS[np.frombuffer(raw, np.uint8)]
    kinds = np.bincount(cls, minlength=11) / m
    lengths = np.fromiter(map(len, words), np.int64, m)
    last = np.flatnonzero(np.append(cls[1:] == _SPACE, True) & (cls != _SPACE))
    same = sum(map(eq, words, words[1:]))
    seen = Counter(words)
    lines = list(map(len, raw.split(b"\n")))
    return np.array([
        log1p(n), log1p(m), lengths.mean(), log1p(lengths.std()), log1p(kinds[_UPPER]), log1p(kinds[_DIGIT]),
        log1p(20 * kinds[_PIPE]), log1p(5 * kinds[_SIGN]), kinds[_STOP], log1p(20 * kinds[_BANG]),
        log1p(10 * kinds[_MARK]), log1p(kinds[_HIGH]), log1p(n / len(lines)), sum(x < 20 for x in lines) / len(lines),
        log1p(20 * same / m), len(seen) / m ** 0.8, log1p(20 * max(seen.values()) / m), log1p(kinds[_LOWER]),
        np.count_nonzero(_ENDS_MARKED[cls[last]]) / m, log1p(lengths.max())])


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return _expanded((x - self.mean) / self.scale) @ self.weights

    def scores(self, x: np.ndarray, threshold: float) -> np.ndarray:
        z = self.strengths(x) - self.cut + np.log(threshold / (1 - threshold))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _expanded(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.hstack([z, z * z / 6])


def labelled_features(docs: DataFrame, labels: DataFrame, target: str, keep: Column, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``(doc_id, y, x)`` of all labelled documents that ``keep`` admits, one row per id, written."""
    def run(batches):
        for batch in batches:
            for part, text in slices(batch):
                yield pa.record_batch([part.column(0), pa.array([features(t).tolist() for t in text], pa.list_(pa.float64()))],
                                      names=["doc_id", "x"])
    chosen = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
              .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & keep)
              .groupBy("doc_id").agg(F.min("y").alias("y")))
    rows = (id_and_text(docs, id_col, text_col).where(F.col("doc_id").isNotNull() & keep)
            .mapInArrow(run, "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x")))
    return written(rows.hint("merge").join(chosen, "doc_id").select("doc_id", "y", "x"))


def exact_quantile(values: DataFrame, q: float) -> float:
    """numpy's linear quantile of the finite column ``v``: bins are counted and the one that holds
    the wanted rank is cut again, until its values are few or equal."""
    lo, hi, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    at = q * (n - 1)

    def ranked(rank: int) -> float:
        a, b, below = lo, hi, 0
        while True:
            inside = values.where((F.col("v") >= a) & (F.col("v") <= b))
            width = (b - a) / BINS
            if a == b or a + width == a:
                return a
            cell = F.least(F.floor((F.col("v") - a) / F.lit(width)), F.lit(BINS - 1))
            counts = inside.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
            for _, m, a, b in sorted(counts.collect()):
                if rank < below + m:
                    break
                below += m
            if m <= FEW:
                return sorted(r.v for r in values.where((F.col("v") >= a) & (F.col("v") <= b)).collect())[rank - below]

    low = ranked(int(at))
    high = ranked(min(n - 1, int(at) + 1))
    return low + (high - low) * (at - int(at))


def fit_ranker(rows: DataFrame, ridge: float = 1.0, seed: int = 7) -> Ranker:
    """Newton's method on the pairs' logistic loss over all ``rows(doc_id, y, x)``. Without rows of
    both classes all documents are equally strong and lie above the cut."""
    k = len(FEATURES)
    at = [F.col("x")[i] for i in range(k)]
    n, n_good, *moments = rows.agg(F.count("*"), F.sum("y"), *map(F.avg, at), *map(F.stddev_pop, at)).first()
    if not n or n_good in (0, n):
        return Ranker(np.zeros(k), np.ones(k), np.zeros(2 * k), 0.0)
    mean, scale = np.array(moments[:k]), np.array(moments[k:]) + 1e-9
    n_blocks = -(-n // BLOCK)
    blocks = written(rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int"))
                     .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "y", "x"))).alias("rows"))
                     .select("block", F.col("rows.y").alias("y"), F.flatten("rows.x").alias("x")))

    def pairs(block, y, x):
        y, z = np.array(y), _expanded((np.array(x).reshape(-1, k) - mean) / scale)
        good, bad = z[y == 1], z[y == 0]
        if not len(good) or not len(bad):
            return np.empty((0, 2 * k))
        pick = np.random.default_rng([seed, block]).integers(0, len(good), (len(bad), PAIRS))
        return (good[pick] - bad[:, None, :]).reshape(-1, 2 * k)

    def step_of(w):
        def run(batches):
            g, h = np.zeros(2 * k), np.zeros((2 * k, 2 * k))
            for batch in batches:
                for i in range(batch.num_rows):
                    d = pairs(*(batch.column(j)[i].as_py() for j in range(3)))
                    p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
                    g += d.T @ (1 - p)
                    h += (d * (p * (1 - p) + 1e-9)[:, None]).T @ d
            yield pa.record_batch([pa.array(np.arange(2 * k * (2 * k + 1), dtype=np.int32)), pa.array(np.append(g, h))], names=["i", "v"])
        total = dict(blocks.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect())
        sums = np.array([total[i] for i in range(len(total))])
        return sums[:2 * k], sums[2 * k:].reshape(2 * k, 2 * k)

    w, pull = np.zeros(2 * k), ridge * PAIRS * np.eye(2 * k)
    for _ in range(30):
        g, h = step_of(w)
        step = np.linalg.solve(h + pull, g - pull @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    ranker = Ranker(mean, scale, w, 0.0)

    def strengths(batches):
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, k)
            yield pa.record_batch([pa.array(ranker.strengths(x))], names=["v"])
    ranker.cut = exact_quantile(written(rows.select("x").mapInArrow(strengths, "v double")), (n - n_good) / n)
    return ranker


def score_quality(docs: DataFrame, ranker: Ranker, threshold: float = 0.3, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)``, one row per input row. A null text is an
    empty one; texts without words share one score; repeated rows score alike;
    an empty table gives no rows."""
    def run(batches):
        for batch in batches:
            for part, text in slices(batch):
                s = ranker.scores(np.array([features(t) for t in text]).reshape(-1, len(FEATURES)), threshold)
                yield pa.record_batch([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                      names=["doc_id", "score", "predicted"])
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Fit on all labelled rows outside the held-out fold, score all rows:
    ``(doc_id, held_out, score, predicted)``."""
    rows = labelled_features(docs, labels, "quality", fold(F.col("doc_id"), 5) != 0)
    return score_quality(docs, fit_ranker(rows), threshold).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
