"""P1-P3, P6, P8, P12, F1, F2, F8-F11, F18, F19."""

import math

from pyspark.sql import functions as F

from gearsight.functions import calendar, rowwise, sensors


def test_flatten_json_roundtrip(spark):
    df = spark.createDataFrame([("D1", {"temperature": 70.0, "current": 15.0})],
                               "device_id string, sensors map<string,double>")
    flat = sensors.flatten_sensors(df, ["temperature", "current", "pressure"]).first()
    assert flat["temperature"] == 70.0 and flat["pressure"] is None
    packed = df.select("device_id", F.to_json("sensors").alias("sensor_data"))
    back = sensors.expand_json_sensors(packed, ["temperature", "current"]).first()
    assert back["current"] == 15.0
    bad = spark.createDataFrame([("D2", "{not json")], "device_id string, sensor_data string")
    assert sensors.expand_json_sensors(bad, ["temperature"]).first()["temperature"] is None


def test_validation_bounds(spark):
    df = spark.createDataFrame([("D", 1, 180.0), ("D", 1, 180.1), ("D", 1, 39.9), (None, 1, 50.0)],
                               "device_id string, ts int, temperature double")
    r = df.select(sensors.validation_reasons({"temperature": "temperature"},
                                             {"device_id": F.col("device_id"), "timestamp": F.col("ts")})
                  .alias("r")).collect()
    assert [x.r for x in r] == [[], ["range:temperature"], ["range:temperature"], ["missing:device_id"]]


def test_normalize_and_finite(spark):
    df = spark.createDataFrame([(130.0, float("nan")), (200.0, float("inf"))], "t double, x double")
    out = df.select(sensors.normalize("temperature", F.col("t")).alias("n"),
                    sensors.finite_or_zero(F.col("x")).alias("z")).collect()
    assert out[0]["n"] == 1.0 and out[0]["z"] == 0.0 and out[1]["z"] == 0.0
    m = spark.createDataFrame([({"temperature": 65.0, "zzz": 3.0},)], "m map<string,double>")
    nm = m.select(sensors.normalize_map(F.col("m")).alias("n")).first()["n"]
    assert nm == {"temperature": 0.5, "zzz": 3.0}


def test_sensor_fault_map_and_columns(spark):
    df = spark.createDataFrame([({"temperature": 200.0, "current": 15.0},), ({"vibration_y": 10.0},),
                                ({"vibration_z": -0.1},), ({"noise_level": 999.0},)], "m map<string,double>")
    assert [r[0] for r in df.select(sensors.sensor_fault_map(F.col("m"))).collect()] == [True, False, True, False]


def test_calendar_and_period(spark):
    df = spark.createDataFrame([("2024-01-06 00:30:00",), ("2024-01-08 06:00:00",), ("2024-01-08 18:59:00",), ("2024-01-08 19:00:00",)], "s string") \
        .select(F.to_timestamp("s").alias("ts"))
    out = calendar.add_time_features(df).collect()
    assert [(r.day_of_week, r.is_weekend, r.time_period) for r in out] == [(5, 1, None), (0, 0, "night"), (0, 0, "afternoon"), (0, 0, "evening")]


def test_rowwise_null_rules(spark):
    df = spark.createDataFrame([(3.0, None, 4.0), (None, None, None)], "a double, b double, c double")
    cols = ["a", "b", "c"]
    r = df.select(rowwise.row_rms_null_zero(cols).alias("rms"), rowwise.row_mean(cols).alias("mean"),
                  rowwise.row_max(cols).alias("mx"), rowwise.row_std(cols).alias("sd"),
                  rowwise.row_abs_sum(cols).alias("s"), rowwise.vector_norm_null_zero(cols).alias("norm")).collect()
    assert math.isclose(r[0].rms, math.sqrt(25 / 3)) and r[0].mean == 3.5 and r[0].mx == 4.0
    assert math.isclose(r[0].sd, math.sqrt(0.5)) and r[0].s == 7.0 and r[0].norm == 5.0
    assert r[1].mean is None and r[1].sd is None and r[1].s == 0.0 and r[1].rms == 0.0


def test_suggest_sensor_name(spark):
    tags = ["::[scararobot]Ax_J2.ActualPosition", "Motor.Axis3.ActualTorque", "CS.PositionError", "Foo.Bar"]
    df = spark.createDataFrame([(t,) for t in tags], "tag string")
    got = [r[0] for r in df.select(sensors.suggest_sensor_name(F.col("tag"))).collect()]
    assert got == ["joint2_actual_pos", "joint3_torque", "position_error", None]
