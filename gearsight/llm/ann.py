"""Approximate nearest neighbours by query-aware collision counting.

Vectors are scaled to length one, so the largest cosine is the smallest
distance. Every one of ``projections`` random lines gives one sorted array of
projected values. A query puts a window around its own projected value on
each line and widens all of them step by step (virtual rehashing: no new hash
table per width). A vector that lies in the windows of at least ``collisions``
lines is verified: its exact cosine, in double precision on the original
vectors, is computed. A query stops when ``k`` verified vectors lie within the
distance that the window's width stands for, or all vectors are verified.

Vectors are cut into blocks of bounded size and queries likewise; each pair of
blocks is one group of bounded memory, and a query's best ``k`` over all
blocks of vectors are its result. All vectors are indexed. The windows stop per
block, which makes the search wider than a single stop would.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 64
COLLISIONS = 0.71           # share of the lines
WIDTHS = (0.35, 0.5, 0.65, 0.8, 0.95, 1.1, 1.25, 1.42)     # distances, growing
HALF_WINDOW = 1.2           # half a window's width, in distances over sqrt(dimension)
VECTOR_BLOCK = 8_192
QUERY_BLOCK = 2_048
STEP = 4.0                  # over the widest spread of values and windows


def lines(dim: int, projections: int, seed: int = 5) -> np.ndarray:
    a = np.random.default_rng(seed).normal(size=(dim, projections))
    return a / np.linalg.norm(a, axis=0)


class Index:
    """Sorted projections of one block of unit vectors."""

    def __init__(self, unit: np.ndarray, projections: int):
        self.unit = unit
        self.lines = lines(unit.shape[1], projections)
        values = unit @ self.lines
        self.order = np.argsort(values, axis=0, kind="stable").T.astype(np.int32).ravel()
        # one array for all lines: line j's values lie around STEP * j
        self.base = STEP * np.arange(projections)
        self.values = (np.sort(values, axis=0) + self.base).T.ravel()

    def search(self, query: np.ndarray, k: int, share: float):
        """Row numbers of verified vectors, for one unit query."""
        n, m = len(self.unit), len(self.base)
        need = int(np.ceil(share * m))
        at = query @ self.lines + self.base
        half = np.array(WIDTHS)[:, None] * (HALF_WINDOW / np.sqrt(self.unit.shape[1]))
        los, his = self.values.searchsorted(at - half), self.values.searchsorted(at + half, side="right")
        lo = hi = los[0]
        hits, done = np.zeros(n, np.int64), np.zeros(n, bool)
        found, near = [], np.empty(0)
        for width, new_lo, new_hi in zip(WIDTHS, los, his):
            edges = zip(new_lo.tolist(), lo.tolist(), hi.tolist(), new_hi.tolist())
            rings = [self.order[x:y] for a, b, c, d in edges for x, y in ((a, b), (c, d))]
            hits += np.bincount(np.concatenate(rings), minlength=n)
            lo, hi = new_lo, new_hi
            new = np.flatnonzero((hits >= need) & ~done)
            if len(new):
                done[new] = True
                found.append(new)
                near = np.concatenate([near, np.sqrt(np.maximum(0, 2 - 2 * (self.unit[new] @ query)))])
            if np.count_nonzero(near <= width) > k:         # the query itself may be among them
                break
        else:
            found.append(np.flatnonzero(~done))             # the widest windows did not do: verify the rest
        return np.concatenate(found)


def _usable(vec):
    return F.when(
        vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(vec, lambda x: x != 0), True).otherwise(False)


def _matrix(values) -> np.ndarray:
    return np.stack(values).astype(np.float64)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, projections: int = PROJECTIONS,
            collisions: float = COLLISIONS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` vectors of largest cosine found
    for each query, itself (the same id) left out, ties to the smaller id.

    Vectors that are null, empty, zero, or hold null or non-finite components
    take no part, nor do rows with a null id. Vectors of another dimension than
    the query have no cosine with it and are no candidates. Rows that repeat an
    id count once (one of them). Empty tables give no rows.
    """
    def clean(df):
        return (df.select(df[id_col].cast("long").alias("vec_id"), df[vec_col].cast("array<double>").alias("v"))
                .where(F.col("vec_id").isNotNull() & _usable(F.col("v"))).dropDuplicates(["vec_id"])
                .withColumn("dim", F.size("v")))
    base, asked = clean(vectors), clean(queries)
    n, q = base.count(), asked.count()
    blocks, cuts = max(1, -(-n // VECTOR_BLOCK)), max(1, -(-q // QUERY_BLOCK))
    base = base.select("vec_id", "v", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"),
                       F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("cut"))
    asked = asked.select(F.col("vec_id").alias("query_id"), "v", "dim",
                         F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(cuts)).cast("int").alias("cut"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, raw = left["vec_id"].to_numpy(), _matrix(left["v"])
            norms = np.sqrt((raw * raw).sum(axis=1))
            index = Index(raw / norms[:, None], projections)
            for qid, vec in zip(right["query_id"], _matrix(right["v"])):
                size = np.sqrt((vec * vec).sum())
                rows = index.search(vec / size, k, collisions)
                rows = rows[ids[rows] != qid]
                score = (raw[rows] * vec).sum(axis=1) / (norms[rows] * size)
                best = np.lexsort((ids[rows], -score))[:k]
                out += [(qid, i, s) for i, s in zip(ids[rows][best].tolist(), score[best].tolist())]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    pairs = (base.groupBy("block", "cut", "dim").cogroup(asked.groupBy("block", "cut", "dim"))
             .applyInPandas(run, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (pairs.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
