"""F3-F7, F12-F17 on hand-computed cases (the reference's scalar demo)."""

import math

from pyspark.sql import functions as F

from gearsight.functions import scoring, sensors


def test_generic_scores_demo_case(spark):
    # temperature 75, vibration_x 1.2, current 18.5, pressure 2.8
    df = spark.createDataFrame([(75.0, 1.2, 18.5, 2.8)], "temperature double, vibration_x double, current double, pressure double")
    cols = {"temperature": "temperature", "vibration_x": "vibration_x", "current": "current", "pressure": "pressure"}
    r = scoring.score(df, cols).first()
    devs = [10 / 65, 0.7 / 0.5, 3.5 / 15, 0.3 / 2.5]
    health = 100 - 100 * sum(devs) / 4
    assert math.isclose(r["health_score"], health, rel_tol=1e-12)
    assert math.isclose(r["anomaly_score"], (100 - health) / 100 * 0.7, rel_tol=1e-12)
    assert r["status"] == "warning"


def test_health_no_known_sensor_is_100_and_nulls_are_absent(spark):
    df = spark.createDataFrame([(None, 1.0)], "temperature double, other double")
    r = scoring.score(df, {"temperature": "temperature", "other": "other"}).first()
    assert r["health_score"] == 100.0 and r["anomaly_score"] == 0.0 and r["status"] == "normal"


def test_anomaly_out_of_range_ratio(spark):
    # temperature 100 > 90: ratio 10/90; current 5 < 10: ratio 0.5
    df = spark.createDataFrame([(100.0, 5.0)], "temperature double, current double")
    r = scoring.score(df, {"temperature": "temperature", "current": "current"}).first()
    health = max(0.0, 100 - 100 * ((35 / 65) + (10 / 15)) / 2)
    expect = min(1.0, (100 - health) / 100 * 0.7 + 0.3 * ((10 / 90) + 0.5) / 2)
    assert math.isclose(r["anomaly_score"], expect, rel_tol=1e-12)


def test_status_policies_differ_at_cut_points(spark):
    df = spark.createDataFrame([(70.0,), (30.0,), (29.9,)], "h double")
    out = df.select(scoring.status_generic(F.col("h")).alias("g"), scoring.status_device(F.col("h")).alias("d")).collect()
    assert [(r.g, r.d) for r in out] == [("normal", "warning"), ("warning", "critical"), ("critical", "critical")]


def test_power_rounds_on_binary_value(spark):
    df = spark.createDataFrame([(210.0, 10.0, 0.9), (220.0, 15.0, 0.95)], "v double, i double, pf double")
    got = [r[0] for r in df.select(scoring.power_consumption("v", "i", "pf")).collect()]
    assert got == [round(210.0 * 10.0 * 0.9 / 1000, 2), round(220.0 * 15.0 * 0.95 / 1000, 2)]


def test_robot_scores(spark):
    df = spark.createDataFrame([(1.0, 4.0, 150.0, 0.5), (None, None, None, None)],
                               "rms double, imb double, tq double, sd double")
    h = scoring.robot_health(F.col("rms"), F.col("imb"), F.col("tq"))
    out = df.select(h.alias("h")).collect()
    assert math.isclose(out[0]["h"], 100 - 20 - 8 - 5)
    assert out[1]["h"] == 100.0
    r = df.select(scoring.robot_anomaly(F.col("rms"), F.lit(67.0), F.col("imb"), F.col("sd")).alias("a")).first()
    assert math.isclose(r["a"], min(1.0, 0.2 + 33 / 150 + 4 / 30 + 0.05))
    s = spark.createDataFrame([(90.0, 0.1), (90.0, 0.3), (50.0, 0.1)], "h double, a double")
    assert [x[0] for x in s.select(scoring.robot_status(F.col("h"), F.col("a"))).collect()] == ["normal", "warning", "critical"]


def test_labels_and_risk_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.31,), (0.7,), (0.71,), (1.0,)], "a double")
    got = [r[0] for r in df.select(sensors.failure_risk(F.col("a"))).collect()]
    assert got == [None, "low", "medium", "medium", "high", "high"]
    p = spark.createDataFrame([(0.29,), (0.3,), (0.69,), (0.7,)], "p double")
    assert [r[0] for r in p.select(sensors.prediction_risk(F.col("p"))).collect()] == ["low", "medium", "medium", "high"]
    lab = spark.createDataFrame([(40.0, 0.5), (80.0, 0.71), (60.0, 0.2)], "h double, a double")
    assert [r[0] for r in lab.select(sensors.label_generic(F.col("a"), F.col("h"))).collect()] == [0, 1, 0]
    assert [r[0] for r in lab.select(sensors.label_generic(None, F.col("h"))).collect()] == [1, 0, 0]
    assert [r[0] for r in lab.select(sensors.label_robot(F.col("h"), F.col("a"))).collect()] == [1, 1, 1]
