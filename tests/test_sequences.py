"""W8/W9 against a brute-force loop; blocked windows across block edges."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gearsight.operators.rolling import rolling_features
from gearsight.operators.sequences import latest_sequence, sequence_samples


def _frame(spark, n_dev=3, n=37, seed=7):
    rng = random.Random(seed)
    rows = []
    for d in range(n_dev):
        for i in range(n + d * 5):
            rows.append((f"D{d}", i * 60 + rng.randint(0, 30), d * 1000 + i, rng.random(), rng.random(),
                         rng.randint(0, 1)))
    return spark.createDataFrame(rows, "device_id string, t long, id long, a double, b double, y int") \
        .withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")), rows


# 7: every device is "hot" and cut into blocks; 40: mixed; 10**6: plain windows
@pytest.mark.parametrize("block_rows", [7, 40, 10**6])
def test_sequences_match_loop_and_block_halo(spark, block_rows):
    df, rows = _frame(spark)
    L, H = 5, 2
    got = sequence_samples(df, ["device_id"], ["ts", "id"], ["a", "b"], "y", L, H, block_rows=block_rows).collect()
    got = {(r.device_id, r.id): (r.seq, r.label) for r in got}
    pdf = pd.DataFrame(rows, columns=["device_id", "t", "id", "a", "b", "y"]).sort_values(["device_id", "t", "id"])
    want = {}
    for d, g in pdf.groupby("device_id"):
        x, y, ids = g[["a", "b"]].to_numpy(), g["y"].to_numpy(), g["id"].to_numpy()
        for i in range(L, len(g) - H + 1):      # the reference's loop
            want[(d, ids[i - 1])] = (list(x[i - L:i].reshape(-1)), y[i + H - 1])
    assert set(got) == set(want)
    for k, (seq, lab) in want.items():
        assert np.allclose(got[k][0], seq) and got[k][1] == lab
    assert len(want) == sum(len(g) - L - H + 1 for _, g in pdf.groupby("device_id"))


def test_latest_sequence(spark):
    df, rows = _frame(spark)
    out = {r.device_id: r for r in latest_sequence(df, ["device_id"], ["ts", "id"], ["a"], 40).collect()}
    assert out["D0"].seq is None and out["D0"].n_rows == 37
    pdf = pd.DataFrame(rows, columns=["device_id", "t", "id", "a", "b", "y"]).sort_values(["t", "id"])
    tail = pdf[pdf.device_id == "D1"].tail(40)["a"].tolist()
    assert np.allclose(out["D1"].seq, tail)


@pytest.mark.parametrize("block_rows", [6, 40, 10**6])
def test_rolling_matches_pandas_across_blocks(spark, block_rows):
    df, rows = _frame(spark)
    pdf = pd.DataFrame(rows, columns=["device_id", "t", "id", "a", "b", "y"]).sort_values(["device_id", "t", "id"])
    pdf.loc[pdf.index[::5], "a"] = np.nan
    sdf = spark.createDataFrame(pdf.astype({"a": "float64"}).replace({np.nan: None})) \
        .withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    got = rolling_features(sdf, ["device_id"], ["ts", "id"], ["a"], [3, 5], block_rows=block_rows).toPandas().set_index("id").sort_index()
    for d, g in pdf.groupby("device_id"):
        s = g.set_index("id")["a"]
        for w in (3, 5):
            r = s.rolling(w, min_periods=1)
            assert np.allclose(got.loc[s.index, f"a_ma_{w}"].astype(float), r.mean(), equal_nan=True)
            assert np.allclose(got.loc[s.index, f"a_std_{w}"].astype(float), r.std().fillna(0), equal_nan=True)
            assert np.allclose(got.loc[s.index, f"a_max_{w}"].astype(float), r.max(), equal_nan=True)
        assert np.allclose(got.loc[s.index, "a_diff"].astype(float), s.diff().fillna(0))
        pct = s.ffill().pct_change(fill_method=None).fillna(0)
        assert np.allclose(got.loc[s.index, "a_pct_change"].astype(float), pct)


@pytest.mark.parametrize("block_rows", [6, 40, 10**6])
def test_null_times_and_keys_keep_every_row(spark, block_rows):
    """Null order values and null keys: the same rows whatever the block size."""
    rng = random.Random(11)
    rows = [(rng.choice(["A", "B", None]), rng.choice([None, *range(40)]), i, rng.choice([None, rng.random()]))
            for i in range(150)]
    sdf = spark.createDataFrame(rows, "device_id string, t long, id long, a double") \
        .withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    got = {r.id: (r.a_ma_3, r.a_diff, r.a_pct_change) for r in rolling_features(
        sdf, ["device_id"], ["ts", "id"], ["a"], [3], stats=("mean",), block_rows=block_rows).collect()}
    assert len(got) == 150
    pdf = pd.DataFrame(rows, columns=["device_id", "t", "id", "a"]).sort_values(
        ["t", "id"], na_position="first").astype({"a": float})
    for _, g in pdf.groupby("device_id", dropna=False):
        s = g.set_index("id")["a"]
        mean = s.rolling(3, min_periods=1).mean()
        for i in s.index:
            assert got[i][0] == pytest.approx(mean[i]) if not np.isnan(mean[i]) else got[i][0] is None
            assert got[i][1] == pytest.approx(s.diff().fillna(0)[i])


def test_no_job_while_planning(spark):
    df, _ = _frame(spark)
    tracker, group = spark.sparkContext.statusTracker(), "plan-only"
    spark.sparkContext.setJobGroup(group, "planning runs no job")
    try:
        rolling_features(df, ["device_id"], ["ts", "id"], ["a"], [3], block_rows=6)
        assert not tracker.getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("block", [6, 1 << 20])
def test_written_once_gives_the_same_rows(spark, block):
    """With a large key and without; without one the plan is one scan and one shuffle."""
    import contextlib
    import io
    df, _ = _frame(spark)
    a, b = (rolling_features(df, ["device_id"], ["ts", "id"], ["a"], [3], block_rows=block, write_once=x) for x in (False, True))
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        b.explain()         # before it runs: the initial plan alone
    if block > 6:
        assert text.getvalue().count("Exchange ") == 1 and text.getvalue().count("Scan ") == 1
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
