"""One-pass correlation against numpy, pair by pair."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gearsight.operators.gram import gram_correlation

COLS = ["a", "b", "big", "flat", "rare", "empty"]


@pytest.mark.parametrize("parts", [1, 7])
def test_pairs(spark, parts):
    rng = random.Random(4)
    rows = []
    for i in range(500):
        a = rng.gauss(0, 1)
        rows.append((a if i % 3 else None, 2 * a + rng.gauss(0, 1), 1e9 + a, 7.1, 3.0 + i if i == 5 else None, None))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in COLS)).repartition(parts)
    got = {(r.col_a, r.col_b): r for r in gram_correlation(df, COLS).collect()}
    assert len(got) == 15
    for (x, y), r in got.items():
        both = np.array([(u[COLS.index(x)], u[COLS.index(y)]) for u in rows
                         if u[COLS.index(x)] is not None and u[COLS.index(y)] is not None], float).reshape(-1, 2)
        assert r.n == len(both)
        if {x, y} & {"flat", "rare", "empty"}:
            assert r.r is None
        else:
            assert abs(r.r - np.corrcoef(both.T)[0, 1]) < 1e-6


def test_empty_and_many_columns(spark):
    none = spark.createDataFrame([], "a double, b int")
    assert [(r.n, r.r) for r in gram_correlation(none, ["a", "b"]).collect()] == [(0, None)]
    wide = spark.range(200).select(*[F.sin(F.col("id") * (i + 1)).alias(f"x{i}") for i in range(60)])
    assert gram_correlation(wide, wide.columns).where("n = 200 and abs(r) <= 1").count() == 60 * 59 // 2
