"""Alert rules on the reference's demo cases, lifecycle, manual alerts,
views, and the cool-down against a brute-force loop."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from gearsight.operators.cooldown import greedy_cooldown
from gearsight.plans.alerts import (active_alerts, alert_dashboard, alert_statistics, apply_actions,
                                    default_rules, evaluate_rules, manual_alert, threshold_alerts,
                                    undated_matches)
from gearsight.functions.sensors import sensor_fault_map

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def _cases(spark, cases):
    rows = [(d, T0, i, h, a, s) for i, (d, h, a, s) in enumerate(cases)]
    df = spark.createDataFrame(rows, "device_id string, ts timestamp_ntz, event_id long, health_score double, "
                                     "anomaly_score double, sensors map<string,double>")
    return df.withColumn("sensor_fault", sensor_fault_map(F.col("sensors")))


def test_reference_demo_cases(spark):
    df = _cases(spark, [("TEST_001", 60.0, 0.3, {"temperature": 75.0, "current": 15.0}),
                        ("TEST_002", 20.0, 0.8, {"temperature": 95.0, "current": 25.0}),
                        ("TEST_003", 90.0, 0.1, {"temperature": 200.0, "current": 15.0})])
    got = {(r.device_id, r.rule) for r in evaluate_rules(df, default_rules()).collect()}
    assert got == {("TEST_001", "health_low"), ("TEST_002", "health_low"), ("TEST_002", "health_critical"),
                   ("TEST_002", "anomaly_high"), ("TEST_003", "sensor_fault")}


def test_boundary_health_70_does_not_alert(spark):
    df = _cases(spark, [("A1", 85.0, 0.2, {"temperature": 70.0}), ("A3", 70.0, 0.8, {"temperature": 95.0})])
    got = {(r.device_id, r.rule) for r in evaluate_rules(df, default_rules()).collect()}
    assert got == {("A3", "anomaly_high")}
    msg = evaluate_rules(df, default_rules()).first().message
    assert "A3" in msg and "0.800" in msg


def test_lifecycle_and_views(spark):
    df = _cases(spark, [("D1", 20.0, 0.95, {}), ("D2", 60.0, 0.1, {})])
    hist = evaluate_rules(df, default_rules())
    ids = sorted(r.alert_id for r in hist.collect())
    actions = spark.createDataFrame([(ids[0], "acknowledge", "ops", T0), ("nope", "resolve", "ops", T0)],
                                    "alert_id string, action string, user string, at timestamp_ntz")
    upd = apply_actions(hist, actions)
    st = {r.alert_id: r.status for r in upd.collect()}
    assert st[ids[0]] == "acknowledged" and all(v in ("active", "acknowledged") for v in st.values())
    resolved = apply_actions(hist, actions.union(spark.createDataFrame(
        [(ids[0], "resolve", "ops", T0)], actions.schema)))
    act = active_alerts(resolved)
    assert ids[0] not in {r.alert_id for r in act.collect()}
    dash = {(r.section, r.key): r.n for r in alert_dashboard(active_alerts(hist)).collect()}
    assert dash[("by_priority", "low")] == 0 and dash[("active", "all")] == active_alerts(hist).count()
    stats = {(r.metric, r.key): r.n for r in alert_statistics(hist, active_alerts(hist), 4).collect()}
    assert stats[("total", "all")] == hist.count() and stats[("rules", "all")] == 4
    m = manual_alert(spark, "D9", "check pump", T0, "high").first()
    assert m.alert_type == "system_error" and m.alert_id.startswith("manual_D9_")


def test_threshold_alert_hides_critical(spark):
    df = _cases(spark, [("D1", 20.0, 0.95, {}), ("D2", 20.0, 0.1, {}), ("D3", 50.0, 0.75, {})])
    got = {(r.device_id, r.alert_type, r.priority) for r in threshold_alerts(df).collect()}
    assert got == {("D1", "anomaly_threshold", "high"), ("D2", "health_critical", "critical"),
                   ("D3", "anomaly_threshold", "medium")}


def test_cooldown_matches_loop_with_many_chunks(spark):
    rng = random.Random(3)
    rows = []
    for k in range(4):
        t = T0
        for i in range(300):
            t += dt.timedelta(minutes=rng.choice([1, 2, 5, 9, 14, 15, 16, 30, 240]))
            rows.append((f"K{k}", t, k * 1000 + i))
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long")
    cd = 15 * 60 * 1_000_000
    for chunk in (1, 2, 7, 299, 1 << 16):
        got = {(r.k, r.id) for r in greedy_cooldown(df, ["k"], "ts", "id", cd, chunk_rows=chunk).collect()}
        want = set()
        for k in {r[0] for r in rows}:
            last = None
            for kk, t, i in sorted(r for r in rows if r[0] == k):
                if last is None or (t - last) >= dt.timedelta(microseconds=cd):
                    want.add((kk, i))
                    last = t
        assert got == want


def _loop(rows, cd_us):
    fired, last = set(), {}
    for k, t, i in sorted(rows):
        if k not in last or t - last[k] >= dt.timedelta(microseconds=cd_us):
            fired.add((k, i))
            last[k] = t
    return fired


@pytest.mark.parametrize("seed, chunk", [(1, 1), (2, 3), (3, 10), (4, 64)])
def test_cooldown_of_a_hot_key_with_ties_and_dense_runs(spark, seed, chunk):
    """Many chunks within one cool-down, equal times, and long silences."""
    rng = random.Random(seed)
    rows, t = [], T0
    for i in range(900):
        t += dt.timedelta(seconds=rng.choice([0, 0, 1, 1, 2, 59, 60, 61, 7200 if i % 40 == 0 else 1]))
        rows.append(("HOT", t, i))
    rows += [(f"C{i % 9}", T0 + dt.timedelta(seconds=rng.randint(0, 600)), 1000 + i) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long")
    for cd in (60_000_000, 1_000_000, 3_600_000_000):
        got = greedy_cooldown(df, ["k"], "ts", "id", cd, chunk_rows=chunk).collect()
        assert sorted((r.k, r.id) for r in got) == sorted(_loop(rows, cd))


def test_no_cooldown_and_no_matches(spark):
    df = spark.createDataFrame([("A", T0, 1), ("A", T0, 2), (None, T0, 3), ("A", None, 4)], "k string, ts timestamp_ntz, id long")
    assert sorted(r.id for r in greedy_cooldown(df, ["k"], "ts", "id", 0).collect()) == [1, 2, 3]
    assert sorted(r.id for r in greedy_cooldown(df, ["k"], "ts", "id", 5).collect()) == [1, 3]
    assert greedy_cooldown(df.where("id > 9"), ["k"], "ts", "id", 5).collect() == []


def test_cooldown_properties(spark):
    """Fired alerts are >= cool-down apart; every suppressed match has a fired
    one less than the cool-down before it (SURVEY 5c)."""
    rng = random.Random(11)
    rows = []
    t = T0
    for i in range(400):
        t += dt.timedelta(seconds=rng.choice([5, 30, 60, 299, 300, 301, 900, 3600]))
        rows.append(("K", t, i))
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long")
    cd = dt.timedelta(minutes=5)
    fired = sorted((r.ts, r.id) for r in greedy_cooldown(df, ["k"], "ts", "id", 300_000_000,
                                                          chunk_rows=16).collect())
    assert all(b[0] - a[0] >= cd for a, b in zip(fired, fired[1:]))
    fired_ids = {i for _, i in fired}
    for tt, _, i in [(r[1], r[0], r[2]) for r in rows]:
        if i not in fired_ids:
            assert any(ft <= tt and tt - ft < cd for ft, _ in fired)


def test_first_resolve_ends_the_alert(spark):
    """Later resolves, acknowledgements after the resolve and actions before the alert
    are refused; of two alerts with one id only the last in order is touched."""
    h = lambda x: T0 + dt.timedelta(hours=x)
    alerts = spark.createDataFrame(
        [("a", h(0), 0, "active"), ("b", h(0), 0, "active"), ("b", h(0), 1, "active"), ("c", h(2), 0, "active")],
        "alert_id string, ts timestamp_ntz, rule_order int, status string")
    actions = spark.createDataFrame(
        [("a", "resolve", "x", h(1)), ("a", "resolve", "y", h(5)), ("a", "acknowledge", "late", h(6)),
         ("b", "acknowledge", "u", h(1)), ("b", "acknowledge", "v", h(2)), ("c", "resolve", "x", h(1)), (None, "resolve", "x", h(9))],
        "alert_id string, action string, user string, at timestamp_ntz")
    got = {(r.alert_id, r.rule_order): (r.status, r.acknowledged_by, r.resolved_at) for r in
           apply_actions(alerts, actions).collect()}
    assert got == {("a", 0): ("resolved", None, h(1)), ("b", 0): ("active", None, None),
                   ("b", 1): ("acknowledged", "v", None), ("c", 0): ("active", None, None)}


def test_complete_groups_keeps_order_and_groups():
    import pandas as pd
    from gearsight.operators.cooldown import complete_groups
    rng = random.Random(2)
    keys = sorted(rng.choice("abcdefgh") for _ in range(200)) + ["z"] * 500
    frame = pd.DataFrame({"k": keys, "v": range(len(keys))})
    for size in (1, 3, 50, 1000):
        parts = list(complete_groups((frame.iloc[i:i + size] for i in range(0, len(frame), size)), ["k"]))
        assert pd.concat(parts, ignore_index=True).equals(frame)
        seen = [set(p["k"]) for p in parts]
        assert all(not (a & b) for i, a in enumerate(seen) for b in seen[:i])


def test_readings_without_time_are_reported(spark):
    df = _cases(spark, [("D1", 20.0, 0.95, {}), ("D2", 20.0, 0.95, {})])
    df = df.withColumn("ts", F.when(F.col("device_id") == "D2", F.col("ts")))
    assert {r.device_id for r in evaluate_rules(df, default_rules()).collect()} == {"D2"}
    assert {(r.device_id, r.rule) for r in undated_matches(df, default_rules()).collect()} == {
        ("D1", "health_low"), ("D1", "health_critical"), ("D1", "anomaly_high")}
