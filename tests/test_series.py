"""A1 + A2 + W6 against pandas (pivot_table mean -> resample mean ->
interpolate linear both ways -> ffill/bfill), on random tag histories
with duplicates, gaps, all-null columns and an interval that does not
divide a day."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from gearsight.operators.series import regular_series

TAGS = ["a", "b", "c"]


def _long(seed):
    rng = random.Random(seed)
    t0 = dt.datetime(2024, 3, 5, 7, 13, 0)
    rows = []
    for _ in range(120):
        t = t0 + dt.timedelta(seconds=rng.randint(0, 400))
        tag = rng.choice(["a", "a", "b"])            # "c" never appears: all-null column
        rows.append(("R1", t, tag, round(rng.uniform(-5, 5), 3)))
        if rng.random() < 0.2:                       # duplicate timestamp, other value
            rows.append(("R1", t, tag, round(rng.uniform(-5, 5), 3)))
    return rows


def _pandas(rows, interval):
    df = pd.DataFrame(rows, columns=["device_id", "ts", "tag", "v"])
    p = df.pivot_table(index="ts", columns="tag", values="v", aggfunc="mean")
    p = p.reindex(columns=TAGS)
    p = p.resample(interval).mean()
    p = p.interpolate(method="linear", limit_direction="both").ffill().bfill()
    return p


@pytest.mark.parametrize("seed,interval,pd_iv,block", [(1, "7s", "7s", 1 << 16), (2, "30s", "30s", 1 << 16),
                                                       (3, "1m", "1min", 1 << 16), (1, "7s", "7s", 4), (4, "1s", "1s", 3),
                                                       (5, "30s", "30s", 1)])
def test_series_matches_pandas(spark, seed, interval, pd_iv, block):
    rows = _long(seed)
    long = spark.createDataFrame(rows, "device_id string, ts timestamp_ntz, tag string, v double")
    got = regular_series(long, ["device_id"], "ts", "tag", "v", TAGS, interval, block_rows=block).toPandas() \
        .set_index("ts").sort_index()
    want = _pandas(rows, pd_iv)
    assert list(got.index) == list(want.index)
    for c in TAGS:
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True), c


def test_known_points_kept(spark):
    rows = [("R", dt.datetime(2024, 1, 1, 0, 0, s), "a", float(s)) for s in (0, 10, 40)]
    long = spark.createDataFrame(rows, "device_id string, ts timestamp_ntz, tag string, v double")
    got = regular_series(long, ["device_id"], "ts", "tag", "v", ["a"], "10s").orderBy("ts").collect()
    assert [r.a for r in got] == [0.0, 10.0, 20.0, 30.0, 40.0]


def test_wide_rolling_matches_pandas(spark):
    from gearsight.operators.wide_rolling import rolling_mean_std
    rng = random.Random(5)
    rows = [(f"D{d}", i, rng.random() * 100 if rng.random() > 0.3 else None,
             rng.random() if rng.random() > 0.1 else None)
            for d in range(6) for i in range(rng.randint(1, 45))]
    df = spark.createDataFrame(rows, "k string, t int, x double, y double")
    got = rolling_mean_std(df, ["k"], "t", ["x", "y"], [5, 10, 20]).toPandas().sort_values(["k", "t"])
    pdf = pd.DataFrame(rows, columns=["k", "t", "x", "y"]).sort_values(["k", "t"])
    for c in ("x", "y"):
        for n in (5, 10, 20):
            r = pdf.groupby("k")[c].rolling(n, min_periods=1)
            ma = r.mean().reset_index(level=0, drop=True).sort_index()
            sd = r.std().reset_index(level=0, drop=True).fillna(0).sort_index()
            g = got.set_index(pdf.index)
            assert np.allclose(g[f"{c}_ma_{n}"].astype(float), ma.loc[pdf.index], equal_nan=True)
            assert np.allclose(g[f"{c}_std_{n}"].astype(float), sd.loc[pdf.index])


@pytest.mark.parametrize("block", [1 << 16, 5, 2])
def test_fill_by_row_position(spark, block):
    """Irregular times: positions are ranks; null keys are keys."""
    from gearsight.operators.series import gap_fill_linear
    rng = random.Random(8)
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), rng.choice([None, None, rng.random()]), None)
            for k in ("a", None, "b") for t in rng.sample(range(5000), 40)]
    series = spark.createDataFrame(rows, "k string, ts timestamp_ntz, x double, y double")
    got = gap_fill_linear(series, ["k"], "ts", ["x", "y"], block_rows=block).toPandas()
    pdf = pd.DataFrame(rows, columns=["k", "ts", "x", "y"])
    for k in ("a", None, "b"):
        pick = (lambda d: d[d["k"].isna()] if k is None else d[d["k"] == k])
        want = pick(pdf).sort_values("ts")["x"].astype(float).interpolate(method="linear", limit_direction="both").to_numpy()
        mine = pick(got).sort_values("ts")
        assert np.allclose(mine["x"].astype(float).to_numpy(), want) and mine["y"].isna().all()


def test_one_long_device_uses_several_partitions(spark):
    """A device of two million bins, mostly empty, and a block without any reading."""
    from gearsight.operators.series import BLOCK_ROWS
    from gearsight.plans.robot import robot_from_long
    n = 2_000_000
    at = sorted({0, n - 1, *(i * 997 % (BLOCK_ROWS * 3) for i in range(3000)), *range(BLOCK_ROWS * 5, n, 4001)})
    t0 = dt.datetime(2024, 1, 1)
    long = spark.createDataFrame([("R", t0 + dt.timedelta(seconds=5 * i), s, float(i % 17)) for i in at
                                  for s in ("joint1_pos_error", "joint1_torque_cmd")],
                                 "device_id string, ts timestamp_ntz, sensor_name string, tag_value double")
    f = robot_from_long(long, ["device_id"], ["joint1_pos_error", "joint1_torque_cmd"], "5s")
    got = f.select("ts", "joint1_pos_error", "joint1_torque_cmd_change", "joint1_pos_error_ma_20", "joint1_torque_cmd_change_std_20",
                   F.spark_partition_id().alias("part")).cache()
    assert got.count() == n and got.select("part").distinct().count() > 4
    want = pd.Series([float(i % 17) for i in at], index=at).reindex(range(n)).interpolate()
    pdf = got.toPandas().sort_values("ts")
    assert np.allclose(pdf["joint1_pos_error"], want)
    step = want.diff().abs()
    assert np.allclose(pdf["joint1_torque_cmd_change"].iloc[1:], step.iloc[1:])
    assert np.allclose(pdf["joint1_pos_error_ma_20"], want.rolling(20, min_periods=1).mean())
    assert np.allclose(pdf["joint1_torque_cmd_change_std_20"], step.rolling(20, min_periods=1).std().fillna(0), atol=1e-6)


@pytest.mark.parametrize("block", [20, 33, 1 << 16])
def test_robot_features_alike_at_every_block_size(spark, block):
    from gearsight.plans.robot import robot_features
    rng = random.Random(1)
    rows = [(d, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=5 * i), *[rng.random() * 50 for _ in range(4)])
            for d in ("A", "B") for i in range(rng.randint(70, 130))]
    names = ["joint1_pos_error", "joint2_pos_error", "joint1_torque_cmd", "joint1_actual_pos"]
    df = spark.createDataFrame(rows, "device_id string, ts timestamp_ntz, " + ", ".join(f"{n} double" for n in names))
    a, b = (robot_features(df, ["device_id"], block_rows=x).orderBy("device_id", "ts").toPandas() for x in (block, 1 << 20))
    assert list(a.columns) == list(b.columns) and len(a) == len(rows)
    pd.testing.assert_frame_equal(a, b)


def test_rolling_pass_over_small_batches_equals_window_functions(spark):
    """Frames reach over batches, null keys are a key, NaN and infinity are values: figures are Spark's own."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from gearsight.operators.rolling import rolling_features
    from gearsight.operators.wide_rolling import STEP_VALUES
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2]), i, None if rng.random() < 0.2 else rng.random() * 1e5) for i in range(400)]
    rows += [(3, 400, 1.0), (3, 401, float("inf")), (3, 402, 2.0), (4, 403, float("nan")), (4, 404, 2.0), (5, 405, None)]
    df = spark.createDataFrame(rows, "k int, t int, x double")
    assert STEP_VALUES > 400
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for block in (1 << 20, 40):
            got = rolling_features(df, ["k"], ["t"], ["x"], [3, 30], stats=("mean", "std"), with_pct=False, block_rows=block)
            assert "MapInArrow" in got._jdf.queryExecution().toString()
            w = Window.partitionBy("k").orderBy("t")
            want = df.select("t", *[c for n in (3, 30) for c in (
                F.avg("x").over(w.rowsBetween(1 - n, 0)).alias(f"m{n}"),
                F.coalesce(F.stddev_samp("x").over(w.rowsBetween(1 - n, 0)), F.lit(0.0)).alias(f"s{n}"))])
            a = sorted(map(repr, map(tuple, got.select("t", "x_ma_3", "x_std_3", "x_ma_30", "x_std_30").collect())))
            b = sorted(map(repr, map(tuple, want.select("t", "m3", "s3", "m30", "s30").collect())))
            assert a == b
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
