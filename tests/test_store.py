"""Store round trip: append, last N, devices, delete with partition rewrite, stats, CSV."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from gearsight.sources.store import ReadingStore, read_csv_readings


def _readings(spark, n=11, devices=("STORAGE_TEST_001", "STORAGE_TEST_002")):
    base = dt.datetime(2024, 1, 1, 23, 59, 55)
    rows = [(d, base + dt.timedelta(seconds=i), float(i), 70.0 + 2 * i, 0.1, "normal",
             {"temperature": 60.0 + i, "current": 15.0})
            for d in devices for i in range(n)]
    return spark.createDataFrame(rows, "device_id string, ts timestamp_ntz, operating_hours double, "
                                       "health_score double, anomaly_score double, status string, "
                                       "sensors map<string,double>")


def test_round_trip_last_n_delete(spark):
    root = tempfile.mkdtemp(prefix="gearsight-store-", dir="/tmp")
    st = ReadingStore(spark, root, buckets=4)
    st.append(_readings(spark))
    last = st.device_data("STORAGE_TEST_001", 5, ["temperature", "pressure"]).collect()
    assert [r.health_score for r in last] == [82.0, 84.0, 86.0, 88.0, 90.0]   # newest 5, oldest first
    assert last[0].pressure is None and last[-1].temperature == 70.0
    assert sorted(r.device_id for r in st.devices().collect()) == ["STORAGE_TEST_001", "STORAGE_TEST_002"]
    s = st.statistics().first()
    assert s.total_records == 22 and s.devices == 2 and s.size_bytes > 0
    assert st.delete_device("STORAGE_TEST_001") == 11
    assert st.delete_device("STORAGE_TEST_001") == 0
    assert [r.device_id for r in st.devices().collect()] == ["STORAGE_TEST_002"]
    assert st.all_data().count() == 11
    out = os.path.join(root + "-csv")
    st.export_csv(out, ["temperature", "current"])
    back = read_csv_readings(spark, out, ["temperature", "current", "pressure"])
    assert back.count() == 11
    assert back.where(F.col("sensors")["temperature"] == 70.0).count() == 1


def test_delete_many_reports_each(spark):
    root = tempfile.mkdtemp(prefix="gearsight-store-", dir="/tmp")
    st = ReadingStore(spark, root, buckets=2)
    st.append(_readings(spark, 5, tuple(f"D{i}" for i in range(6))))
    gone = st.delete_devices(spark.createDataFrame([("D1",), ("D4",), ("D4",), ("none",), (None,)], "device_id string"))
    assert {r.device_id: r.removed for r in gone.collect()} == {"D1": 5, "D4": 5, "none": 0}
    assert sorted(r.device_id for r in st.devices().collect()) == ["D0", "D2", "D3", "D5"]
    assert st.all_data().count() == 20
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_csv_files_with_their_own_headers(spark):
    d = tempfile.mkdtemp(prefix="gearsight-csv-", dir="/tmp")
    files = {"A": "device_id,timestamp,temperature,pressure,status\nA,2024-01-01 00:00:00,50,2,normal\n",
             "B": "timestamp,device_id,pressure,temperature\n2024-01-01 00:00:01,B,3,60\n2024-01-01 00:00:02,B,oops,61\n",
             "C": "device_id,timestamp,humidity\nC,not a time,5\n"}
    for name, text in files.items():
        with open(os.path.join(d, f"{name}.csv"), "w") as f:
            f.write(text)
    got = sorted(((r.device_id, str(r.ts), r.status, r.sensors) for r in read_csv_readings(
        spark, d, ["temperature", "pressure", "humidity"]).collect()), key=str)
    assert got == [("A", "2024-01-01 00:00:00", "normal", {"temperature": 50.0, "pressure": 2.0}),
                   ("B", "2024-01-01 00:00:01", None, {"pressure": 3.0, "temperature": 60.0}),
                   ("B", "2024-01-01 00:00:02", None, {"temperature": 61.0}), ("C", "None", None, {"humidity": 5.0})]
