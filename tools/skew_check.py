"""Hot-key check for the ordered-window operators.

Derives a skewed copy of ``lineitem`` (one supplier key receives a third of
all rows) and runs the rolling features twice: with the default block size
(the hot key is small enough for one plain window here) and with a block
size that forces the hot key through the blocked path. Prints timings, the
largest window partition of each run, and whether the results are equal.

python tools/skew_check.py [sf_dir] [block_rows]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    block = int(sys.argv[2]) if len(sys.argv) > 2 else 20_000
    from pyspark.sql import functions as F
    from gearsight.functions.numeric import rnd
    from gearsight.operators.rolling import rolling_features
    from gearsight.session import build_session
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # a third of the rows (by order key) move to supplier 0
    skewed = li.withColumn("l_suppkey", F.when(F.col("l_orderkey") % 3 == 0, F.lit(0))
                           .otherwise(F.col("l_suppkey")))
    sizes = skewed.groupBy("l_suppkey").count().orderBy(F.col("count").desc()).limit(2).collect()
    print("largest keys:", [(r.l_suppkey, r["count"]) for r in sizes])
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    out = {}
    for label, b in (("plain", 1 << 30), ("blocked", block)):
        r = rolling_features(skewed.select("l_suppkey", *order, "l_quantity"), ["l_suppkey"], order,
                             ["l_quantity"], [5, 15, 30], stats=("mean", "std"), with_pct=False, block_rows=b)
        r = r.select("l_orderkey", "l_linenumber", *[rnd(c, 6).alias(c) for c in r.columns
                                                      if c.startswith("l_quantity_")])
        t0 = time.perf_counter()
        r.write.format("noop").mode("overwrite").save()
        out[label] = (r, time.perf_counter() - t0)
        print(f"{label}: {out[label][1]:.2f}s")
    a, b = out["plain"][0], out["blocked"][0]
    diff = a.exceptAll(b).count() + b.exceptAll(a).count()
    print("rows:", a.count(), "differing rows:", diff)
    cooldown_check(spark, sf_dir)
    spark.stop()


def cooldown_check(spark, sf_dir: str) -> None:
    """Greedy cool-down with a hot device (a third of all events) against a
    plain Python loop over the collected matches."""
    import datetime as dt
    from collections import defaultdict
    from pyspark.sql import functions as F
    from gearsight.functions.scoring import score
    from gearsight.functions.sensors import sensor_fault
    from gearsight.plans.alerts import default_rules, evaluate_rules, rule_matches
    from gearsight.sources.tables import TELEMETRY_SENSORS, telemetry_of
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    ev = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))
    r = score(telemetry_of(ev), TELEMETRY_SENSORS).withColumn("sensor_fault", sensor_fault(TELEMETRY_SENSORS))
    rules = default_rules()
    t0 = time.perf_counter()
    got = {(x.rule, x.device_id, x.event_id) for x in evaluate_rules(r, rules).collect()}
    took = time.perf_counter() - t0
    m = rule_matches(r, rules).select("rule", "device_id", "ts", "event_id", "cooldown_us").collect()
    groups = defaultdict(list)
    for x in m:
        groups[(x.rule, x.device_id)].append((x.ts, x.event_id, x.cooldown_us))
    want = set()
    for (rule, dev), v in groups.items():
        last = None
        for ts, eid, cd in sorted(v):
            if last is None or ts - last >= dt.timedelta(microseconds=cd):
                want.add((rule, dev, eid))
                last = ts
    hot = max(groups.items(), key=lambda kv: len(kv[1]))
    print(f"cool-down: {len(m)} matches, hottest key {hot[0]} has {len(hot[1])}; "
          f"{len(got)} fired in {took:.2f}s; equal to loop: {got == want}")


if __name__ == "__main__":
    main()
