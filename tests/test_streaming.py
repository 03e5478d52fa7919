"""Stream/batch parity for in-order input over many micro-batches (state
carried between batches), handler isolation, and the late-row policy."""

import tempfile

from pyspark.sql import functions as F

from gearsight.plans.alerts import evaluate_rules, with_cooldown, default_rules, alert_readings
from gearsight.streaming.queries import (event_stream, fan_out, read_sink, rule_alert_stream,
                                         run_available, scored_stream)

SF = "/root/testdata/sf0.001"


def _split_by_day(spark):
    """events of sf0.001 rewritten as one file per day (names sort by day)."""
    d = tempfile.mkdtemp(prefix="gearsight-stream-", dir="/tmp")
    e = spark.read.parquet(f"{SF}/events.parquet")
    days = sorted(r[0] for r in e.select(F.to_date("ts")).distinct().collect())
    for i, day in enumerate(days):
        e.where(F.to_date("ts") == day).coalesce(1).write.parquet(f"{d}/tmp{i:03d}")
    return d, days


def test_stream_cooldown_equals_batch_across_batches(spark):
    import glob
    import os
    import shutil
    d, days = _split_by_day(spark)
    src = tempfile.mkdtemp(prefix="gearsight-stream-src-", dir="/tmp")
    for i in range(len(days)):
        part = glob.glob(f"{d}/tmp{i:03d}/*.parquet")[0]
        dst = os.path.join(src, "events.parquet", f"part-{i:03d}.parquet")
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        shutil.copy(part, dst)
        os.utime(dst, (1_700_000_000 + i, 1_700_000_000 + i))   # file source orders by mtime
    rules = with_cooldown(default_rules(), 24 * 60)     # day-scale: decisions span batches
    st = rule_alert_stream(scored_stream(event_stream(spark, src, max_files=1)), rules)
    sink = run_available(st, spark, "parity")
    told = read_sink(spark, sink, st).collect()
    assert {r.outcome for r in told} == {"fired"}           # in order: nothing is late
    streamed = {(r.rule, r.device_id, r.event_id) for r in told}
    batch = evaluate_rules(alert_readings(spark, SF), rules)
    expect = {(r.rule, r.device_id, r.event_id) for r in batch.collect()}
    assert len(streamed) == len(expect), (len(streamed), len(expect), sorted(streamed - expect)[:3], sorted(expect - streamed)[:3])
    assert streamed == expect and len(expect) > 0
    n_batches = spark.read.parquet(sink).select("_batch").distinct().count()
    assert n_batches > 1
    from gearsight.streaming.queries import read_progress
    progress = read_progress(spark, sink).collect()
    assert sum(r.rows for r in progress) == len(told) and all(r.seconds > 0 for r in progress)
    assert len(progress) >= n_batches


def _day_files(spark, days_first=None):
    """The days as files in the given order (a file source reads by time of change)."""
    import glob
    import os
    import shutil
    d, days = _split_by_day(spark)
    src = tempfile.mkdtemp(prefix="gearsight-stream-src-", dir="/tmp")
    order = days_first or range(len(days))
    for place, i in enumerate(order):
        dst = os.path.join(src, "events.parquet", f"part-{place:03d}.parquet")
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        shutil.copy(glob.glob(f"{d}/tmp{i:03d}/*.parquet")[0], dst)
        os.utime(dst, (1_700_000_000 + place, 1_700_000_000 + place))
    return src


def test_late_matches_come_out_marked(spark):
    """Days in the order 1, 0, 2: what day 0 brings for a key already on day 1 is late."""
    src = _day_files(spark, [1, 0, 2])
    rules = with_cooldown(default_rules(), 60)
    scored = scored_stream(event_stream(spark, src, max_files=1))
    st = rule_alert_stream(scored, rules)
    got = read_sink(spark, run_available(st, spark, "late"), st).collect()
    day = sorted({r.ts.date() for r in got})
    on_day_1 = {(r.rule, r.device_id) for r in got if r.ts.date() == day[1]}
    late = {(r.rule, r.device_id) for r in got if r.outcome == "late"}
    first = {(r.rule, r.device_id) for r in got if r.ts.date() == day[0]}
    assert late and late == first & on_day_1
    assert all(r.ts.date() == day[0] for r in got if r.outcome == "late")


def test_stream_predictions_equal_the_batch_ones(spark):
    """A fitted model over many files, in and out of order."""
    from gearsight.plans.model import (SEQ_LEN, SETTINGS, device_predictions_q, predict_all, telemetry_samples, train,
                                       training_scaler)
    from gearsight.streaming.queries import prediction_stream, read_progress, run_predictions
    scaler = training_scaler(spark, SF)
    model, _ = train(telemetry_samples(spark, SF, scaler=scaler), SETTINGS, max_iter=30)
    want = {r.device_id: r for r in device_predictions_q(spark, SF).collect()}
    src = _day_files(spark, None)
    windows = prediction_stream(scored_stream(event_stream(spark, src, max_files=4)), SEQ_LEN, scaler)
    latest, sink = run_predictions(spark, windows, lambda b: predict_all(model, b, settings=SETTINGS), "model")
    got = {r.device_id: r for r in latest.collect()}
    assert got.keys() == want.keys() and read_progress(spark, sink).count() > 1
    for d, r in want.items():
        assert (got[d].timestamp, got[d].error, got[d].risk_level) == (r.timestamp, r.error, r.risk_level)
        assert got[d].maintenance_probability is None if r.maintenance_probability is None else abs(
            got[d].maintenance_probability - r.maintenance_probability) < 1e-9


def test_fan_out_isolates_failures(spark):
    seen = []

    def bad(df, epoch):
        raise ValueError("boom")

    def good(df, epoch):
        seen.append(epoch)
    fan_out([bad, good])(spark.range(1), 7)
    assert seen == [7]


def test_stream_buffers_and_latest_across_batches(spark):
    import glob
    import os
    import shutil
    from gearsight.operators.latest import last_n_per_device
    from gearsight.plans.fleet import scored_telemetry
    from gearsight.streaming.queries import last_change, latest_state_stream
    from gearsight.streaming.stateful import stream_buffers
    d, days = _split_by_day(spark)
    src = tempfile.mkdtemp(prefix="gearsight-stream-src-", dir="/tmp")
    for i in range(len(days)):
        dst = os.path.join(src, "events.parquet", f"part-{i:03d}.parquet")
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        shutil.copy(glob.glob(f"{d}/tmp{i:03d}/*.parquet")[0], dst)
        os.utime(dst, (1_700_000_000 + i, 1_700_000_000 + i))
    st = stream_buffers(scored_stream(event_stream(spark, src, max_files=3)), cap=5)
    sink = run_available(st, spark, "buffers")
    got = {r.device_id: (r.buffer_size, r.newest_us) for r in last_change(read_sink(spark, sink, st),
                                                                          ["device_id"]).collect()}
    s = scored_telemetry(spark, SF)
    last5 = last_n_per_device(s, 5, "device_id", ["ts", "event_id"])
    want = {r.device_id: (r.n, r.newest) for r in last5.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("newest")).collect()}
    assert got == want
    lt = latest_state_stream(scored_stream(event_stream(spark, src, max_files=3)))
    sink2 = run_available(lt, spark, "latest", "update")
    got2 = {r.device_id: r.event_id for r in last_change(read_sink(spark, sink2, lt), ["device_id"]).collect()}
    want2 = {r.device_id: r.event_id for r in s.groupBy("device_id").agg(
        F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")).collect()}
    assert got2 == want2


def test_sink_failure_stops_the_stream(spark):
    import pytest

    def broken(path):
        def h(batch, epoch):
            raise ValueError("disk full")
        return h
    st = scored_stream(event_stream(spark, SF)).select("event_id")
    with pytest.raises(Exception, match="disk full"):
        run_available(st, spark, "broken", sink=broken)


def test_repeated_batch_replaces_its_rows(spark):
    from gearsight.streaming.queries import parquet_sink
    path = tempfile.mkdtemp(prefix="gearsight-sink-", dir="/tmp")
    write = parquet_sink(path)
    write(spark.range(5), 0)
    write(spark.range(7), 1)
    write(spark.range(7), 1)        # the batch runs again after a crash
    got = read_sink(spark, path, spark.range(0))
    assert got.count() == 12 and {r._batch for r in got.collect()} == {0, 1}
    assert read_sink(spark, path + "-none", spark.range(0)).count() == 0


def test_messages_round_trip(spark):
    from gearsight.streaming.queries import from_messages, to_messages
    r = spark.sql("select 'D1' as device_id, timestamp_ntz'2024-01-01 00:00:00' as ts, 1.5D as health_score")
    m = to_messages(r)
    assert m.columns == ["key", "value", "timestamp"]
    junk = spark.createDataFrame([("D2", "{not json", None), (None, "{}", None)], "key string, value string, timestamp timestamp")
    assert from_messages(m.unionByName(junk), r.schema).collect() == r.collect()


def _told(spark, files, **kw):
    """``files`` (rows ``(rule, device, t, id)``) as a stream through the cool-down of 100 us; outcome rows and state rows."""
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    from gearsight.streaming.stateful import stream_cooldown
    src = tempfile.mkdtemp(prefix="gearsight-stream-src-", dir="/tmp")
    schema = "rule string, device string, t long, id long"
    for i, rows in enumerate(files):
        cols = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64()))]
        pq.write_table(pa.table(cols, names=["rule", "device", "t", "id"]), f"{src}/part-{i}.parquet")
        os.utime(f"{src}/part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    matches = rows.select("rule", "device", "id", F.timestamp_micros("t").alias("ts"), F.lit(100).cast("long").alias("cd"))
    st = stream_cooldown(matches, ["rule", "device"], "ts", "id", "cd", **kw)
    sink = run_available(st, spark, "cooldown")
    told = read_sink(spark, sink, st)
    assert told.columns == ["rule", "device", "id", "ts", "cd", "outcome", "_batch"]
    state = spark.read.format("statestore").load(f"{sink.removesuffix('/sink')}/checkpoint").count()
    return sorted(map(tuple, told.select("rule", "device", F.unix_micros("ts"), "id", "outcome", "_batch").collect()), key=repr), state


def _told_plainly(files):
    out, fire, seen = [], {}, {}
    for batch, rows in enumerate(files):
        newest = dict(seen)
        for rule, device, t, i in sorted(rows, key=lambda r: (r[2], r[3] is None, r[3] or 0)):
            k = rule, device
            if t < seen.get(k, t):
                out.append((rule, device, t, i, "late", batch))
                continue
            if k not in fire or t - fire[k] >= 100:
                fire[k] = t
                out.append((rule, device, t, i, "fired", batch))
            newest[k] = max(t, newest.get(k, t))
        seen = newest
    return sorted(out, key=repr)


def test_cooldown_calls_do_not_grow_with_the_keys(spark):
    """more keys than buckets, rows out of order and late; state is one row per bucket."""
    import random
    draw = random.Random(5)
    keys = [(r, d) for r in ("a", "b", "c") for d in [None, "", *(f"D{i}" for i in range(700))]]
    n = iter(range(10 ** 6))
    files = [[(*draw.choice(keys), draw.randrange(lo, lo + 600), next(n)) for _ in range(4000)] for lo in (0, 300, 900)]
    got, state = _told(spark, files)
    assert got == _told_plainly(files) and {r[4] for r in got} == {"fired", "late"}
    from gearsight.streaming.stateful import COOLDOWN_BUCKETS
    assert state <= COOLDOWN_BUCKETS < len({r[:2] for f in files for r in f})


def test_cooldown_keeps_long_values_beside_nulls(spark):
    files = [[("a", "D1", 0, 2 ** 60 + 1), ("a", "D2", 0, None), ("a", "D2", 0, 5), ("b", None, 50, 2 ** 60 + 3)],
             [("a", "D1", 100, 2 ** 60 + 5), ("a", "D2", 99, None)]]
    got, state = _told(spark, files, buckets=1)
    assert got == _told_plainly(files) and state == 1 and ("a", "D1", 0, 2 ** 60 + 1, "fired", 0) in got
