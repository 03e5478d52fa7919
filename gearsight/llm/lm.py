"""Log-bilinear language model, trained by noise-contrastive estimation.

Tokens are words plus one end per document. Each token has a class: the most
frequent ``HEADS`` tokens are classes of their own, all others fall in one of
``TAILS`` classes by the ending of their letters. The model is

    P(token | u, v) = P(class | class of u, class of v) * P(token | class)

with ``v`` the token before and ``u`` the last head before that one, at any
distance in the text. The first factor is a log-bilinear net
(a vector per class and context place, a vector and bias per class as output)
and is normalised over all classes; the second is the add-one share of the
token among its class's training tokens, one unseen type per class included.
So token probabilities sum to one.

Everything the model gathers covers all training documents: token counts, and
how often each class follows each pair of classes. These counts are all that
the expected NCE loss needs, with class shares as noise, so the net is trained
in numpy on them by full-batch steps. They are at most ``classes**3`` numbers
at any corpus size. Scoring multiplies the context vectors of all class pairs
with the output vectors once per task and looks tokens up.

Counts of all tokens stay in a table. The ``FREQUENT`` most frequent go to
every task (a fixed bound); the rest of a document's tokens are joined to the
table by Spark.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearsight.llm.common import Shared, id_and_text, slices, written

HEADS = 40
TAILS = 120
START = HEADS + TAILS       # class of the places before a text
DIM = 24
NOISE = 8                   # noise tokens per data token
STEPS = 200
FREQUENT = 1 << 18          # tokens whose counts every task holds
FLUSH = 1 << 18             # different tokens a task counts before it hands them on
END = b"\n"                 # never a word

_LETTERS = re.compile(rb"[a-z\x80-\xff]+")


def tokens(text: str) -> list[bytes]:
    return [*text.encode().lower().split(), END]


def tail_class(token: bytes) -> int:
    """Class of a token outside the heads, by the last two bytes of its letters;
    the first tail class is for tokens without letters."""
    found = _LETTERS.findall(token)
    if not found:
        return HEADS
    end = found[-1][-2:]
    return HEADS + 1 + (end[0] * 131 + end[-1]) * 7 % (TAILS - 1)


def count_tokens(docs: DataFrame) -> DataFrame:
    """``(token binary, n)`` over all rows of ``docs(text)``."""
    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                   names=["token", "n"])
        for batch in batches:
            for _, text in slices(batch):
                for t in text:
                    seen.update(tokens(t))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()
    return (docs.select("text").mapInArrow(run, "token binary, n long")
            .groupBy("token").agg(F.sum("n").alias("n")))


@dataclass
class Vocabulary:
    """Counts of the most frequent tokens and of the classes."""
    ids: dict[bytes, int]           # frequent tokens
    counts: np.ndarray              # of these tokens
    classes: np.ndarray             # of these tokens
    total: int                      # N: training tokens
    types: int                      # V: distinct training tokens
    class_total: np.ndarray
    class_types: np.ndarray
    heads: dict[bytes, int]
    floor: int | None               # level from which tokens are frequent

    def class_of(self, token: bytes) -> int:
        """Class of a token that is not among the frequent ones."""
        return self.heads[token] if token in self.heads else tail_class(token)

    def inside(self) -> np.ndarray:
        """Per class, the log10 of the denominator of P(token | class)."""
        return np.log10(self.class_total + self.class_types + 1.0)


def _level(n: Column) -> Column:
    """Counts on a scale of eight levels per doubling: at most 504 levels."""
    return F.floor(F.log2(n) * 8).cast("int")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the count table. The frequent tokens are those from the lowest level
    on that keeps them at ``FREQUENT`` or fewer; only they reach the driver."""
    floor, room = None, FREQUENT
    for r in sorted(counts.groupBy(_level(F.col("n")).alias("level")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        floor = r["level"]
    heads = {bytes(r["token"]): i for i, r in enumerate(counts.orderBy(F.desc("n"), "token").limit(HEADS).collect())}
    frequent = counts.where(F.lit(False)) if floor is None else counts.where(_level(F.col("n")) >= floor)
    top = frequent.select("token", "n").toArrow()
    names, n = top.column("token").to_pylist(), top.column("n").to_numpy()
    classes = np.array([heads[t] if t in heads else tail_class(t) for t in names], np.int16)

    def sums(batches):
        total, types = np.zeros(START, np.int64), np.zeros(START, np.int64)
        for batch in batches:
            cls = np.array([heads[t] if t in heads else tail_class(t) for t in texts_of(batch)], np.int64)
            if len(cls):
                total += np.bincount(cls, batch.column(1).to_numpy().astype(float), START).astype(np.int64)
                types += np.bincount(cls, minlength=START)
        yield pa.record_batch([pa.array(np.arange(START)), pa.array(total), pa.array(types)], names=["c", "n", "v"])

    def texts_of(batch):
        return batch.column(0).to_pylist()
    total, types = np.zeros(START, np.int64), np.zeros(START, np.int64)
    for r in (counts.mapInArrow(sums, "c long, n long, v long").groupBy("c")
              .agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()):
        total[r["c"]], types[r["c"]] = r["n"], r["v"]
    return Vocabulary({t: i for i, t in enumerate(names)}, n, classes, int(total.sum()), int(types.sum()), total, types,
                      heads, floor)


def _class_ids(vocab: Vocabulary, text: list[str]):
    """Class, frequent-token id (-1: not frequent) and document of each token,
    and the tokens that are not frequent."""
    ids, ends, rare = [], [], []
    get = vocab.ids.get
    for t in text:
        words = tokens(t)
        got = [get(w, -1) for w in words]
        if -1 in got:
            rare.append([w for w, i in zip(words, got) if i < 0])
        else:
            rare.append([])
        ids += got
        ends.append(len(ids))
    ids = np.array(ids, np.int32)
    cls = np.where(ids >= 0, vocab.classes[ids] if len(vocab.classes) else 0, 0).astype(np.int64)
    flat = [w for ws in rare for w in ws]
    if flat:
        known: dict[bytes, int] = {w: vocab.class_of(w) for w in set(flat)}
        cls[ids < 0] = [known[w] for w in flat]
    ends = np.array(ends)
    sizes = np.diff(ends, prepend=0)
    return cls, ids, np.repeat(np.arange(len(text)), sizes), sizes, rare


def _contexts(cls: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Index of the two context classes of each token: the last head before the
    previous token, and the previous token (``START`` where a text has none)."""
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(cls))
    head = np.maximum.accumulate(np.where(cls < HEADS, at, -1))
    u = np.where(at - first >= 2, head[at - 2], -1)
    u = np.where(u >= first, cls[u], START)
    v = np.where(at > first, cls[at - 1], START)
    return u * (START + 1) + v


def count_classes(docs: DataFrame, vocab) -> np.ndarray:
    """``(pairs, classes)``: how often a class follows a pair of classes, over all
    rows of ``docs(text)``; at most ``classes**3`` numbers."""
    def run(batches):
        cells = np.zeros((START + 1) ** 2 * START, np.int32)
        for batch in batches:
            for _, text in slices(batch):
                cls, _, _, sizes, _ = _class_ids(vocab.value, text)
                at, n = np.unique(_contexts(cls, sizes) * START + cls, return_counts=True)
                cells[at] += n.astype(np.int32)
        at = np.flatnonzero(cells)
        for i in range(0, len(at), 1 << 16):
            part = at[i:i + (1 << 16)]
            yield pa.record_batch([pa.array(part), pa.array(cells[part].astype(np.int64))], names=["cell", "n"])
    got = (docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
           .toPandas())
    cells = np.zeros((START + 1) ** 2 * START)
    cells[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    return cells.reshape(-1, START)


@dataclass
class Net:
    before: np.ndarray      # (2, START + 1, DIM): vectors of the context places
    out: np.ndarray         # (START, DIM)
    bias: np.ndarray        # (START,)

    def context(self, pairs: np.ndarray) -> np.ndarray:
        return self.before[0][pairs // (START + 1)] + self.before[1][pairs % (START + 1)]

    def log_probs(self, pairs: np.ndarray) -> np.ndarray:
        """Normalised log10 P(class | pair) of each pair, by one matrix product."""
        s = self.context(pairs) @ self.out.T + self.bias
        s -= s.max(axis=1, keepdims=True)
        return (s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / np.log(10)


def train(cells: np.ndarray, steps: int = STEPS, dim: int = DIM, seed: int = 11) -> Net:
    """Adam on the expected NCE loss over the counted class triples."""
    rng = np.random.default_rng(seed)
    share = (cells.sum(axis=0) + 1) / (cells.sum() + START)
    net = Net(rng.normal(0, .1, (2, START + 1, dim)).astype(np.float32), rng.normal(0, .1, (START, dim)).astype(
        np.float32), np.log(share).astype(np.float32))
    pairs = np.flatnonzero(cells.sum(axis=1))
    if not len(pairs):
        return net
    data = cells[pairs].astype(np.float32)
    data /= data.sum()
    seen = data.sum(axis=1, keepdims=True)
    noise = (NOISE * share).astype(np.float32)
    offset = np.log(noise)
    u, v = pairs // (START + 1), pairs % (START + 1)
    order_u, order_v = np.argsort(u, kind="stable"), np.argsort(v, kind="stable")
    first_u, first_v = (np.flatnonzero(np.diff(x[o], prepend=-1)) for x, o in ((u, order_u), (v, order_v)))
    params = [net.before, net.out, net.bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        q = net.before[0][u] + net.before[1][v]
        p = 1 / (1 + np.exp(np.clip(offset - net.bias - q @ net.out.T, -30, 30)))      # P(data | class, pair)
        g = data * (1 - p) - seen * noise * p
        dq = g @ net.out
        before = np.zeros_like(net.before)
        before[0][u[order_u][first_u]] = np.add.reduceat(dq[order_u], first_u)
        before[1][v[order_v][first_v]] = np.add.reduceat(dq[order_v], first_v)
        rate = 0.05 * min(1.0, 4 * (1 - step / (steps + 1)))
        for param, grad, (m1, m2) in zip(params, (before, g.T @ q, g.sum(axis=0)), moments):
            m1 += 0.1 * (grad - m1)
            m2 += 0.01 * (grad * grad - m2)
            param += rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-9)
    return net


def score_texts(docs: DataFrame, counts: DataFrame, vocab, net) -> DataFrame:
    """``(doc_id, n_tokens, n_known, base_score, score)``, one row per row of
    ``docs(doc_id, text)``. ``vocab`` and ``net`` are ``Shared``."""
    def run(batches):
        v: Vocabulary = vocab.value
        table = net.value.log_probs(np.arange((START + 1) ** 2)) - v.inside()
        logs = np.log10(v.counts + 1.0)
        floor = np.log10(v.total + v.types + 1.0)
        for batch in batches:
            for part, text in slices(batch):
                cls, ids, of, sizes, rare = _class_ids(v, text)
                known = ids >= 0
                mine = np.where(known, logs[ids] if len(logs) else 0.0, 0.0)
                sums = np.bincount(of, mine, len(text))
                score = np.bincount(of, table[_contexts(cls, sizes), cls], len(text)) + sums
                grouped = [Counter(ws) for ws in rare]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes.astype(np.int64)),
                     pa.array(np.bincount(of[known], minlength=len(text)).astype(np.int64)),
                     pa.array(sums - sizes * floor), pa.array(score),
                     pa.array([list(c) for c in grouped], pa.list_(pa.binary())),
                     pa.array([list(c.values()) for c in grouped], pa.list_(pa.int64()))],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score", "rare", "times"])
    rows = written(docs.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, "
                                        "rare array<binary>, times array<long>")
                   .withColumn("row", F.concat_ws("-", F.spark_partition_id(), F.monotonically_increasing_id())))
    # the rest of the count table: tokens beyond the frequent ones
    floor = vocab.value.floor
    rest = (counts if floor is None else counts.where(_level(F.col("n")) < floor)).select(F.col("token").alias("rare_token"), "n")
    asked = rows.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "row", F.col("x.rare").alias("rare_token"), F.col("x.times").alias("times"))
    added = (asked.join(rest, "rare_token").groupBy("row")
             .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("plus")))
    return rows.drop("rare", "times").join(added, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce("plus", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("plus", F.lit(0.0))).alias("score"))


def language_model(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)``, one row per
    input row; ``training`` (on ``doc_id``) picks the rows to learn from.

    Scores are log10 probabilities of whole texts, end included. A null or empty
    text is the end alone. Repeated rows train and score each. Without training
    rows all counts are zero and the model knows only unseen types. An empty
    table gives no rows.
    """
    spark, docs = docs.sparkSession, id_and_text(docs, id_col, text_col)
    train_docs = docs.where(training)
    counts = written(count_tokens(train_docs))
    vocab = Shared(spark, vocabulary(counts))           # FREQUENT tokens
    net = Shared(spark, train(count_classes(train_docs, vocab)))
    return score_texts(docs, counts, vocab, net).withColumn("train_tokens", F.lit(vocab.value.total).cast("long"))
