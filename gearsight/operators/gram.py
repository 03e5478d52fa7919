"""Correlation over many columns in one pass (A8 on a wide frame).

One ``corr`` per pair makes the plan quadratic in columns. Here every task turns
its Arrow batches into matrices: with X the values (0 where null) and M the mask of
values, ``M'M`` counts the rows two columns share, ``X'M`` and ``(X*X)'M`` are the sums
of one column over them, ``X'X`` the products. The matrices add up inside a task; one
row per task and pair is summed by Spark, so reducers share the pairs.

Values are taken relative to an origin per column (a value from the head of the
frame), which changes no coefficient and keeps the sums free of cancellation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = ["n", "sa", "sb", "qa", "qb", "p"]
SCHEMA = "a int, b int, " + ", ".join(f"{c} double" for c in PARTS)
HEAD = 1_000            # rows looked at for the origins; any origins give the same coefficients
FLAT = 1e-14            # a variance below this share of the square sum is rounding: the column is constant


def _origins(df: DataFrame) -> list[float]:
    row = df.limit(HEAD).agg(*[F.first(c, ignorenulls=True).alias(c) for c in df.columns]).first()
    return [v if v is not None and np.isfinite(v) else 0.0 for v in row]


def gram(df: DataFrame, origins: list[float]) -> DataFrame:
    """``SCHEMA`` rows for columns ``a < b`` of an all-double frame, by position: shared rows,
    sums and square sums of both over these, and the sum of products. One row per task and pair."""
    a, b = np.triu_indices(len(origins), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(origins)
        n, s, q, p = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            known = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
            x = np.where(known, x - origins, 0.0)
            m = known.astype(float)
            n += m.T @ m
            s += x.T @ m
            q += (x * x).T @ m
            p += x.T @ x
        cols = [n[a, b], s[a, b], s[b, a], q[a, b], q[b, a], p[a, b]]
        yield pa.record_batch([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *map(pa.array, cols)],
                              names=["a", "b", *PARTS])
    return df.mapInArrow(run, SCHEMA)


def gram_correlation(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(col_a, col_b, n, r)`` for every pair of columns in the order of ``cols``: Pearson's r over
    the ``n`` rows that hold both. Null where fewer than two rows do or one column is
    constant over them; an empty frame gives all pairs with n = 0."""
    spark, k = df.sparkSession, len(cols)
    values = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    none = spark.range(k * k).select((F.col("id") / k).cast("int").alias("a"), (F.col("id") % k).cast("int").alias("b"),
                                     *[F.lit(0.0).alias(c) for c in PARTS]).where("a < b")
    total = gram(values, _origins(values)).unionByName(none).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in PARTS])
    va, vb = (F.col(f"q{x}") - F.col(f"s{x}") * F.col(f"s{x}") / F.col("n") for x in "ab")
    spread = (F.col("n") >= 2) & (va > FLAT * F.col("qa")) & (vb > FLAT * F.col("qb"))
    r = (F.col("p") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(va * vb)
    names = F.array(*[F.lit(c) for c in cols])
    return total.select(F.get(names, F.col("a")).alias("col_a"), F.get(names, F.col("b")).alias("col_b"),
                        F.col("n").cast("bigint").alias("n"),
                        F.when(spread, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))
