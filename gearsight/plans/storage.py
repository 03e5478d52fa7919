"""Store-shaped queries over the test tables: device history (S5/S6, W10,
P1-P3), z-score heat map (W12) and file statistics (A15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gearsight.functions.numeric import rnd
from gearsight.functions.sensors import expand_json_sensors, pack_sensors
from gearsight.operators.latest import last_n_per_device
from gearsight.plans.fleet import scored_sql, scored_telemetry
from gearsight.plans.registry import register
from gearsight.sources.store import store_statistics
from gearsight.sources.tables import TELEMETRY_SENSORS, table

SENSORS = list(TELEMETRY_SENSORS.values())
HISTORY_N = 20
HEAT_N, HEAT_MIN = 50, 10


@register("device_history", f"""
select device_id, ts, event_id, round(health_score, 6) as health_score, status,
  {", ".join(f"round({c}, 6) as {c}" for c in SENSORS)}
from (select *, row_number() over (partition by device_id order by ts desc, event_id desc) as rn
      from ({scored_sql()}) s) x where rn <= {HISTORY_N}
""", ids=("S5", "S6", "W10", "P1", "P2", "P3"))
def device_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest N readings per device with sensors packed to JSON and expanded
    back, as the relational store does on save and load."""
    s = scored_telemetry(spark, sf_dir)
    stored = s.select("device_id", "ts", "event_id", "health_score", "status",
                      pack_sensors({c: c for c in SENSORS}).alias("sensor_data"))
    last = last_n_per_device(stored, HISTORY_N, "device_id", ["ts", "event_id"])
    flat = expand_json_sensors(last, SENSORS, "sensor_data")
    return flat.select("device_id", "ts", "event_id", rnd("health_score", 6).alias("health_score"), "status",
                       *[rnd(c, 6).alias(c) for c in SENSORS])


def zscore_heatmap(readings: DataFrame, sensors: list[str], n: int = HEAT_N, min_rows: int = HEAT_MIN
                   ) -> DataFrame:
    """Z-scores (sample std) of each sensor over the newest n readings of
    each device; devices with fewer than ``min_rows`` readings are left out;
    zero std gives null."""
    last = last_n_per_device(readings, n, "device_id", ["ts", "event_id"])
    w = Window.partitionBy("device_id")   # at most n rows per device
    out = last.withColumn("_cnt", F.count(F.lit(1)).over(w)).where(F.col("_cnt") >= min_rows)
    z = {}
    for c in sensors:
        sd = F.stddev_samp(c).over(w)
        z[c] = F.when(sd != 0, (F.col(c) - F.avg(c).over(w)) / sd)
    return out.select("device_id", "ts", "event_id", *[z[c].alias(f"z_{c}") for c in sensors])


@register("anomaly_heatmap", f"""
with l as (select * from (select *, row_number() over (partition by device_id order by ts desc, event_id desc) as rn
                          from ({scored_sql()}) s) x where rn <= {HEAT_N}),
c as (select *, count(*) over (partition by device_id) as cnt,
  {", ".join(f"avg({c}) over (partition by device_id) as m_{c}, stddev_samp({c}) over (partition by device_id) as s_{c}" for c in SENSORS)}
  from l)
select device_id, ts, event_id,
  {", ".join(f"round(case when s_{c} != 0 then ({c} - m_{c}) / s_{c} end, 6) as z_{c}" for c in SENSORS)}
from c where cnt >= {HEAT_MIN}
""", ids=("W12", "W10"))
def anomaly_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zscore_heatmap(scored_telemetry(spark, sf_dir), SENSORS)
    return z.select("device_id", "ts", "event_id", *[rnd(f"z_{c}", 6).alias(f"z_{c}") for c in SENSORS])


@register("store_statistics", None, ids=("A15",))
def store_statistics_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("device_id", F.col("user_id"))
    return store_statistics(e, "ts", "device_id")


@register("store_counts", """
select count(*) as total_records, count(distinct user_id) as devices, min(ts) as oldest, max(ts) as newest from events
""", ids=("A15",))
def store_counts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_statistics_q(spark, sf_dir).drop("size_bytes")


def _stored(spark: SparkSession, sf_dir: str):
    """A fresh store with all scored readings, and its folder."""
    import uuid
    from gearsight.functions.sensors import sensors_map
    from gearsight.session import checkpoint_dir
    from gearsight.sources.store import ReadingStore
    base = f"{checkpoint_dir(spark).rstrip('/')}/store/{uuid.uuid4().hex[:12]}"
    readings = scored_telemetry(spark, sf_dir).select(
        "device_id", "ts", F.lit(None).cast("double").alias("operating_hours"), "health_score", "anomaly_score",
        "status", sensors_map({c: c for c in SENSORS}).alias("sensors"))
    store = ReadingStore(spark, f"{base}/parquet", buckets=16)
    store.append(readings)
    return store, base


@register("store_delete_devices", """
with d as (select 'DEVICE_' || lpad(cast(user_id as varchar), 5, '0') as device_id, user_id from events)
select device_id, count(*) as n, 'kept' as what from d where user_id % 3 <> 0 group by device_id
union all select device_id, count(*), 'removed' from d where user_id % 3 = 0 group by device_id
union all select 'DEVICE_NONE', 0, 'removed'
""", ids=("S8", "S7", "S9"))
def store_delete_devices_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third device deleted by list, and one that does not exist."""
    store, _ = _stored(spark, sf_dir)
    gone = store.devices().where("cast(substring(device_id, 8) as int) % 3 = 0").unionByName(
        spark.createDataFrame([("DEVICE_NONE",)], "device_id string"))
    counts = store.delete_devices(gone)
    kept = store.all_data().groupBy("device_id").agg(F.count(F.lit(1)).alias("n"))
    return kept.withColumn("what", F.lit("kept")).unionByName(
        counts.select("device_id", F.col("removed").alias("n"), F.lit("removed").alias("what")))


@register("csv_mixed_headers", f"""
select device_id, ts, round(health_score, 6) as health_score,
  case when event_id % 2 = 0 then round(temperature, 6) end as temperature, round(pressure, 6) as pressure,
  case when event_id % 2 = 1 then round(voltage, 6) end as voltage
from ({scored_sql()}) s
""", ids=("S4", "S11", "O5"))
def csv_mixed_headers_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings written as two CSV folders with other columns in another order,
    and read back in one call."""
    import uuid
    from gearsight.session import checkpoint_dir
    from gearsight.sources.store import read_csv_readings, save_processed
    base = f"{checkpoint_dir(spark).rstrip('/')}/csv/{uuid.uuid4().hex[:12]}"
    s = scored_telemetry(spark, sf_dir).withColumn("timestamp", F.col("ts").cast("string"))
    save_processed(s.where("event_id % 2 = 0").select("device_id", "timestamp", "health_score", "temperature", "pressure"),
                   f"{base}/a", "csv")
    save_processed(s.where("event_id % 2 = 1").select("pressure", "voltage", "timestamp", "health_score", "device_id"),
                   f"{base}/b", "csv")
    back = read_csv_readings(spark, f"{base}/*", ["temperature", "pressure", "voltage"])
    return back.select("device_id", "ts", rnd("health_score", 6).alias("health_score"),
                       *[rnd(F.col("sensors")[c], 6).alias(c) for c in ("temperature", "pressure", "voltage")])


@register("store_csv_roundtrip", f"""
select device_id, ts, round(health_score, 6) as health_score, status,
  {", ".join(f"round({c}, 6) as {c}" for c in SENSORS)}
from (select *, row_number() over (partition by device_id order by ts desc) as rn
      from ({scored_sql()}) s) x where rn <= {HISTORY_N}
""", ids=("S7", "S10", "S4", "S5"))
def store_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings appended to the partitioned store (S7), exported as CSV (S10),
    read back by name (S4) and cut to the newest N per device (S5)."""
    from gearsight.sources.store import read_csv_readings
    store, base = _stored(spark, sf_dir)
    store.export_csv(f"{base}/csv", SENSORS)
    back = read_csv_readings(spark, f"{base}/csv", SENSORS)
    last = last_n_per_device(back, HISTORY_N, "device_id", ["ts"])
    return last.select("device_id", "ts", rnd("health_score", 6).alias("health_score"), "status",
                       *[rnd(F.col("sensors")[c], 6).alias(c) for c in SENSORS])
