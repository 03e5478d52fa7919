"""Report helpers on hand-made frames: histogram edges, frame validation,
missing profile, variance ranking."""

from pyspark.sql import functions as F

from gearsight.plans.reports import histogram, missing_profile, validate_frame, variance_top


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (None,)], "v double")
    h = {r.bin: r.n for r in histogram(df, "v", 5).collect()}
    assert h == {0: 1, 1: 0, 2: 1, 3: 0, 4: 1}                     # last bin right-closed, zeros kept
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert {r.bin: r.n for r in histogram(same, "v", 3).collect()} == {0: 2, 1: 0, 2: 0}
    empty = spark.createDataFrame([], "v double")
    assert [r.n for r in histogram(empty, "v", 2).collect()] == [0, 0]


def test_validate_frame_and_missing(spark):
    df = spark.createDataFrame([("D1", 1.0), ("D2", None)], "device_id string, x double")
    r = validate_frame(df, ["device_id", "x", "ts"]).first()
    assert r.n_rows == 2 and r.missing_columns == ["ts"] and r.null_counts == {"device_id": 0, "x": 1}
    assert r.valid is False
    ok = validate_frame(df.where(F.col("x").isNotNull()), ["device_id", "x"]).first()
    assert ok.valid is True
    mp = {r.column_name: (r.n_missing, r.pct_missing) for r in missing_profile(df).collect()}
    assert mp == {"x": (1, 50.0)}


def test_variance_top_order(spark):
    df = spark.createDataFrame([(1.0, 10.0, 5.0), (2.0, 20.0, 5.0), (3.0, 30.0, 5.0)], "a double, b double, c double")
    got = [r.column_name for r in variance_top(df, ["a", "b", "c"], 2).collect()]
    assert got == ["b", "a"]


def _plan(df):
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_pushdown_and_pruning(spark):
    import __spark_entry__ as E
    p = _plan(E.queries()["device_range"](spark, "/root/testdata/sf0.001"))
    assert "GreaterThanOrEqual(ts" in p and "LessThan(ts" in p            # time filter reaches the scan
    p = _plan(E.queries()["hourly_anomaly"](spark, "/root/testdata/sf0.001"))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,props:string>" in p   # only used columns


def test_store_lookup_prunes_to_one_bucket(spark):
    import datetime as dt
    import tempfile
    from gearsight.sources.store import ReadingStore
    root = tempfile.mkdtemp(prefix="gearsight-store-", dir="/tmp")
    st = ReadingStore(spark, root, buckets=8)
    rows = [(f"D{i}", dt.datetime(2024, 1, 1, 0, i), 0.0, 90.0, 0.1, "normal", {"temperature": 60.0})
            for i in range(20)]
    st.append(spark.createDataFrame(rows, "device_id string, ts timestamp_ntz, operating_hours double, "
                                          "health_score double, anomaly_score double, status string, "
                                          "sensors map<string,double>"))
    p = _plan(st.device_data("D3", 5))
    assert "PartitionFilters: [isnotnull(bucket" in p and "(bucket#" in p
