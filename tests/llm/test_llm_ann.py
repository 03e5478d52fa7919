"""Collision counting against all cosines."""

import numpy as np
import pytest

from gearsight.llm import ann

VECTORS = "vec_id long, embedding array<double>, block string, cut int, v int, dim string, score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v],
                                   "b", 1, 2, "d", 3) for i, v in rows], VECTORS)


def plain(base, queries, k):
    out = {}
    for q, v in queries:
        v = np.array(v, float)
        near = sorted((-float(np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w))), i)
                      for i, w in ((i, np.array(w, float)) for i, w in base) if i != q)
        out[q] = near[:k]
    return out


@pytest.mark.parametrize("block", [8192, 100])
def test_recall(spark, block, monkeypatch):
    monkeypatch.setattr(ann, "VECTOR_BLOCK", block)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 9)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(10, 24))
    base = [(i, centres[i % 10] + rng.normal(size=24)) for i in range(600)]
    df = frame(spark, base)
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), k=5).collect()
    want = plain(base, [b for b in base if b[0] % 20 == 0], 5)
    assert len(got) == 5 * len(want)
    hits = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got)
    assert hits >= 0.95 * len(got)
    vec = dict(base)
    for r in got:
        a, b = vec[r.query_id], vec[r.vec_id]
        assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12 and r.query_id != r.vec_id
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert all(x == sorted(x) for x in by.values()) and {r["rank"] for r in got} == {1, 2, 3, 4, 5}


def test_odd_vectors(spark):
    rows = [(0, [1, 0]), (1, [0, 1]), (2, [1, 0]), (3, [1, 0]), (4, None), (5, []), (6, [0, 0]), (7, [1, None]),
            (8, [float("nan"), 1]), (9, [float("inf"), 1]), (None, [1, 1]), (10, [1, 2, 3]), (1, [0, 1]), (11, [-1, 0])]
    df = frame(spark, rows)
    got = ann.nearest(df, df, k=5).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by == {0: [2, 3, 1, 11], 1: [0, 2, 3, 11], 2: [0, 3, 1, 11], 3: [0, 2, 1, 11], 11: [1, 0, 2, 3]}
    assert ann.nearest(frame(spark, []), frame(spark, []), k=5).collect() == []
    assert ann.nearest(df, frame(spark, []), k=5).collect() == []
