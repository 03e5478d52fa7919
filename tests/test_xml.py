"""S1-S3, S12, P4, P5, J1 and M1 on XML files written by the test."""

import os
import tempfile

from pyspark.sql import functions as F

from gearsight.plans.robot import robot_summary, robot_from_xml
from gearsight.sources.xml import (clean_tag_history, list_files, newest_file, read_tag_history,
                                   tag_map_frame, unmapped_tags)

REC = ("<HistoricalTextData><TagName>{t}</TagName><Status>{s}</Status>"
       "<TagValue>{v}</TagValue><TimeStamp>{ts}</TimeStamp></HistoricalTextData>")
J1ERR = "::[scararobot]Ax_J1.PositionError"
J1TQ = "::[scararobot]Ax_J1.TorqueCommand"
J2TQ = "::[scararobot]Ax_J2.TorqueCommand"


def _write(d, name, body):
    with open(os.path.join(d, name), "w") as f:
        f.write(body)


def _fixture_dir():
    d = tempfile.mkdtemp(prefix="gearsight-xml-", dir="/tmp")
    good = "<root><Block>" + REC.format(t=f"  {J1ERR} ", s="0", v="0.5", ts=" 2024-01-01 00:00:01 ") + "</Block>" \
        + REC.format(t=J1TQ, s="", v="", ts="2024-01-01 00:00:02") \
        + REC.format(t=J2TQ, s="0", v="3.0", ts="2024-01-01 00:00:02") \
        + REC.format(t=J2TQ, s="0", v="5.0", ts="2024-01-01 00:00:02") \
        + REC.format(t="unmapped.tag", s="0", v="1", ts="2024-01-01 00:00:03") \
        + REC.format(t=J1ERR, s="abc", v="1", ts="2024-01-01 00:00:04") \
        + REC.format(t=J1ERR, s="1", v="9", ts="2024-01-01 00:00:05") \
        + REC.format(t=J1ERR, s="0", v="x1", ts="2024-01-01 00:00:06") \
        + REC.format(t=J1ERR, s="0", v="2", ts="not a time") \
        + "<HistoricalTextData><TagName>missing.value</TagName><Status>0</Status><TimeStamp>2024-01-01 00:00:07</TimeStamp></HistoricalTextData>" \
        + REC.format(t=J1ERR, s="0", v="1.5", ts="2024-01-01 00:00:11") + "</root>"
    _write(d, "a.dat", good)
    _write(d, "b.dat", "<root>" + REC.format(t=J1ERR, s="0", v="7", ts="2024-01-01 00:00:01") + "<HistoricalTextData><TagName>x")
    return d


def test_scan_rules(spark):
    d = _fixture_dir()
    recs = read_tag_history(spark, f"{d}/*.dat")
    rows = {(r.tag_name, r.status, r.tag_value, r.timestamp) for r in recs.collect()}
    assert (J1ERR, 0, 0.5, "2024-01-01 00:00:01") in rows          # trimmed, nested depth
    assert (J1TQ, 0, 0.0, "2024-01-01 00:00:02") in rows           # empty children -> defaults
    assert not any(r[0] == "missing.value" for r in rows)          # missing child dropped
    assert not any(r[3] == "2024-01-01 00:00:04" for r in rows)    # non-numeric status dropped
    assert not any(r[3] == "2024-01-01 00:00:06" for r in rows)    # non-numeric value dropped
    assert all(f != "b.dat" for f in [r.file_source for r in recs.collect()])  # truncated file: nothing
    assert {r.file_source for r in recs.collect()} == {"a.dat"}


def test_clean_map_and_report(spark):
    d = _fixture_dir()
    recs = read_tag_history(spark, f"{d}/*.dat")
    tm = tag_map_frame(spark)
    clean = clean_tag_history(recs, tm)
    got = sorted((r.sensor_name, r.tag_value) for r in clean.collect())
    # status 1 dropped, bad time dropped, unmapped dropped
    assert got == [("joint1_pos_error", 0.5), ("joint1_pos_error", 1.5), ("joint1_torque_cmd", 0.0),
                   ("joint2_torque_cmd", 3.0), ("joint2_torque_cmd", 5.0)]
    rep = unmapped_tags(recs, tm).collect()
    assert [(r.tag_name, r.n) for r in rep] == [("unmapped.tag", 1)]


def test_list_and_newest(spark):
    d = _fixture_dir()
    files = list_files(spark, f"{d}/*.dat", 1)
    assert len(files) == 1 and files[0].endswith("a.dat")
    assert newest_file(spark, f"{d}/*.dat").endswith(".dat")


def test_robot_pipeline_end_to_end(spark):
    d = _fixture_dir()
    f = robot_from_xml(spark, f"{d}/*.dat", interval="5s")
    rows = f.orderBy("ts").collect()
    # bins 00:00:00, :05, :10 (empty bin :05 interpolated)
    assert [str(r.ts) for r in rows] == ["2024-01-01 00:00:00", "2024-01-01 00:00:05", "2024-01-01 00:00:10"]
    assert rows[0].joint2_torque_cmd == 4.0                        # mean of duplicates
    assert rows[1].joint1_pos_error == 1.0                         # linear fill between 0.5 and 1.5
    assert rows[0].total_torque_cmd == 4.0
    assert rows[0].health_score <= 100 and rows[0].status in ("normal", "warning", "critical")
    s = {(r.metric, r.key) for r in robot_summary(f).collect()}
    assert ("summary", "rows") in s


def test_training_set_and_catalog(spark):
    from gearsight.plans.robot import feature_catalog, feature_counts, robot_training_set, select_features
    d = _fixture_dir()
    f = robot_from_xml(spark, f"{d}/*.dat", interval="5s")
    ts = robot_training_set(f)
    assert "maintenance_needed" in ts.columns and ts.count() == 3
    feats = select_features(f)
    assert "hour" not in feats and "health_score" not in feats and "total_torque_cmd" in feats
    assert ts.where(F.col(feats[0]).isNull()).count() == 0          # forward fill then 0
    assert "joint1_pos_error_ma_5" in feats and "minute" in select_features(f, with_time=True)
    cats = {r.category: r for r in feature_counts(f).collect()}
    assert len(cats) == 10 and cats["time"].n_columns == 4 and cats["target"].n_columns == 4
    assert cats["cartesian"].sample.count(",") == 2 and feature_catalog(f).count() == sum(r.n_columns for r in cats.values())
    assert {r.maintenance_needed for r in ts.collect()} <= {0, 1}


def test_composites(spark):
    from gearsight.plans.model import add_composites
    df = spark.createDataFrame([(3.0, 4.0, 12.0, -1.0, 2.5, -4.0, None)], "cartesian_x double, cartesian_y double, "
                               "cartesian_z double, joint1_pos_error double, joint2_pos_error double, "
                               "joint1_torque_cmd double, joint1_pos_error_ma_5 double")
    r = add_composites(df).first()
    assert (r.cartesian_distance, r.total_pos_error, r.total_torque_cmd) == (13.0, 3.5, 4.0)
    assert add_composites(df.select("cartesian_x")).columns == ["cartesian_x"]


def test_basic_rolling_and_start_day_origin(spark):
    import datetime as dt
    from gearsight.operators.series import regular_series
    from gearsight.plans.model import ensure_basic_rolling
    rows = [("R", dt.datetime(2024, 1, 1, 0, 0, s), "joint1_pos_error", float(s)) for s in range(0, 30, 3)]
    long = spark.createDataFrame(rows, "device_id string, ts timestamp_ntz, sensor_name string, tag_value double")
    s7 = regular_series(long, ["device_id"], "ts", "sensor_name", "tag_value", ["joint1_pos_error"], "7s")
    assert str(s7.orderBy("ts").first().ts) == "2024-01-01 00:00:00"     # origin = midnight, not epoch
    f = ensure_basic_rolling(s7, ["device_id"], ["ts"], ["joint1_pos_error"])
    assert {"joint1_pos_error_ma_5", "joint1_pos_error_ma_15", "joint1_pos_error_std_5",
            "joint1_pos_error_trend"} <= set(f.columns)
    first = f.orderBy("ts").first()
    assert first.joint1_pos_error_trend == 0.0 and first.joint1_pos_error_std_5 == 0.0


def test_white_space_and_suffixed_numbers_are_dropped(spark):
    d = tempfile.mkdtemp(prefix="gearsight-xml-", dir="/tmp")
    _write(d, "a.dat", "<root>" + "".join(REC.format(t=J1ERR, s=s, v=v, ts=f"2024-01-01 00:00:{i:02d}") for i, (s, v) in
           enumerate([("  ", "1"), ("0", "  "), ("0", "1f"), ("0", "1.0d"), (" 1 ", " 2.5 "), ("0", "1e3"), ("", "")])) + "</root>")
    got = sorted((r.status, r.tag_value) for r in read_tag_history(spark, f"{d}/*.dat").collect())
    assert got == [(0, 0.0), (0, 1000.0), (1, 2.5)]


def test_newest_file_by_time(spark):
    d = tempfile.mkdtemp(prefix="gearsight-xml-", dir="/tmp")
    for name, at in (("z.dat", 1_700_000_000), ("a.dat", 1_700_000_900), ("m.dat", 1_700_000_500)):
        _write(d, name, "<root></root>")
        os.utime(os.path.join(d, name), (at, at))
    assert newest_file(spark, f"{d}/*.dat").endswith("/a.dat")


def test_xml_round_trip_files_do_not_grow_with_devices(spark, tmp_path):
    """Records carry their device: files follow the tasks, and a missing device comes back as null."""
    from gearsight.sources.xml import write_tag_history
    rows = [(f"DEVICE_{i}" if i else None, "T", "0", str(float(i)), "2024-01-01 00:00:00") for i in range(60)]
    rec = spark.createDataFrame(rows, "device_id string, TagName string, Status string, TagValue string, TimeStamp string")
    path = str(tmp_path / "x")
    write_tag_history(rec.coalesce(2), path)
    assert sum(f.startswith("part-") for _, _, fs in os.walk(path) for f in fs) <= 2
    back = read_tag_history(spark, path, extra="device_id").collect()
    assert sorted((r.device_id or "", r.tag_value) for r in back) == sorted((r[0] or "", float(r[3])) for r in rows)


def test_robot_xml_query_writes_few_files(spark):
    """60 devices, one file per task and not one per task and device."""
    from gearsight.plans.registry import load_all
    from gearsight.session import checkpoint_dir
    base = f"{checkpoint_dir(spark)}/tag_history_xml"
    seen = set(os.listdir(base)) if os.path.isdir(base) else set()
    load_all()["robot_features_xml"].build(spark, "/root/testdata/sf0.001")
    made = [f for d in set(os.listdir(base)) - seen for _, _, fs in os.walk(f"{base}/{d}") for f in fs if f.startswith("part-")]
    assert 0 < len(made) <= 16


def test_training_set_works_out_features_once(spark):
    from pyspark.sql import functions as F
    from gearsight.plans.robot import robot_training_set
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b
    f = spark.range(9).select(F.lit("D").alias("device_id"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,0,id)").alias("ts"),
                              F.lit(80.0).alias("health_score"), F.lit(0.2).alias("anomaly_score"), F.col("id").cast("double").alias("total_x"))
    assert robot_training_set(f.mapInArrow(seen, f.schema)).count() == 9
    assert calls.value == 9
