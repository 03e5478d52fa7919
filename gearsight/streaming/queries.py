"""Structured Streaming queries (ST1-ST7).

Source (ST1/S14): the ``events`` parquet read as a file stream
(``maxFilesPerTrigger`` bounds each micro-batch; a file source waits
instead of dropping, which replaces the reference's lossy queue). Each
registered query runs its stream with ``availableNow`` to completion, with
checkpoint and sink in a fresh folder under ``spark.checkpoint.dir``, and
returns the sink read back as a batch DataFrame.

Sinks: every stream writes through ``foreachBatch`` (ST7). The sink comes
first: it overwrites the folder of its batch id, so a batch that runs again
after a crash replaces its rows, and a failure there stops the query before
the batch is committed. Then the batch goes to the other handlers; one that
fails is logged and the rest still run. Stateful aggregates in update mode
write a changelog (one folder per batch); readers take the last change per key.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gearsight.functions.numeric import rnd
from gearsight.functions.scoring import score
from gearsight.config import DEFAULT
from gearsight.functions.sensors import finite_or_zero, sensor_fault
from gearsight.plans.alerts import _hist_cols, _hist_cols_sql, default_rules, fired_sql, rule_matches, \
    alert_id, threshold_alerts, THRESHOLD_SQL
from gearsight.plans.fleet import LATEST_READINGS_SQL, scored_sql
from gearsight.plans.model import FEATURES, SEQ_LEN, SETTINGS, apply_scaler, predict_with
from gearsight.plans.registry import register
from gearsight.session import checkpoint_dir
from gearsight.sources.tables import TELEMETRY_SENSORS, TELEMETRY_SQL, telemetry_of
from gearsight.streaming.stateful import stream_buffers, stream_cooldown, stream_sequences

log = logging.getLogger(__name__)
Handler = Callable[[DataFrame, int], None]


def event_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """ST1: events as a file stream (schema from the table, no inference). The
    table may be one file or a folder of part files."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    # as a pattern, the path may name a file; a plain path must be a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{path}*")


JSON_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def to_messages(readings: DataFrame) -> DataFrame:
    """Readings as messages (key = device, value = JSON of the reading,
    timestamp = event time), the shape of a message log."""
    return readings.select(F.col("device_id").alias("key"), F.to_json(F.struct(*readings.columns), JSON_TIMES).alias("value"),
                           F.col("ts").cast("timestamp").alias("timestamp"))


def from_messages(messages: DataFrame, schema) -> DataFrame:
    """Readings of a message stream; values that are not such JSON are dropped."""
    return messages.select(F.from_json("value", schema, JSON_TIMES).alias("r"), "key").where("key is not null").select("r.*").where(
        "device_id is not null")


def scored_stream(events: DataFrame) -> DataFrame:
    return score(telemetry_of(events), TELEMETRY_SENSORS)


def fan_out(handlers: list[Handler]) -> Handler:
    """ST7: call every handler on the batch; one failure does not stop the rest."""
    def run(batch: DataFrame, epoch: int) -> None:
        for h in handlers:
            try:
                h(batch, epoch)
            except Exception:  # noqa: BLE001 - a handler's failure is its own
                log.exception("stream handler %s failed on batch %s", getattr(h, "__name__", h), epoch)
    return run


def parquet_sink(path: str) -> Handler:
    """Writes a batch to its own folder, replacing what an earlier try left."""
    def h(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={epoch}")
    return h


def predicting_sink(predict: Callable[[DataFrame], DataFrame]) -> Callable[[str], Handler]:
    """ST7: a sink that applies a fitted predictor to each batch and writes its rows."""
    def sink(path: str) -> Handler:
        write = parquet_sink(path)
        return lambda batch, epoch: write(predict(batch), epoch)
    return sink


def run_available(stream: DataFrame, spark: SparkSession, name: str, output_mode: str = "append",
                  extra: list[Handler] | None = None, sink: Callable[[str], Handler] = parquet_sink) -> str:
    """Run a stream over everything available now; return its sink folder.
    Raises if the sink fails."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"
    path = f"{base}/sink"
    write, others = sink(path), fan_out(extra or [])

    def batch_done(batch: DataFrame, epoch: int) -> None:
        seen, began = Observation(), time.monotonic()
        write(batch.observe(seen, F.count(F.lit(1)).alias("rows")), epoch)
        done = (int(seen.get["rows"]), time.monotonic() - began)
        spark.createDataFrame([done], PROGRESS).coalesce(1).write.mode("overwrite").parquet(f"{base}/progress/_batch={epoch}")
        others(batch, epoch)
    q = (stream.writeStream.outputMode(output_mode)
         .option("checkpointLocation", f"{base}/checkpoint")
         .foreachBatch(batch_done).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return path


PROGRESS = "rows long, seconds double"


def read_progress(spark: SparkSession, sink: str) -> DataFrame:
    """ST6: one row per batch of a run: rows it handed to the sink (counted while
    they were written), seconds, ``_batch``. Kept as a table beside the sink, so any
    process can read it, also after a restart."""
    return read_sink(spark, f"{sink.removesuffix('/sink')}/progress", spark.createDataFrame([], PROGRESS))


def read_sink(spark: SparkSession, sink: str, schema_of: DataFrame) -> DataFrame:
    """The sink as a batch frame (empty with the stream's schema if no batch came)."""
    schema = T.StructType([*schema_of.schema.fields, T.StructField("_batch", T.LongType())])
    try:
        return spark.read.schema(schema).parquet(sink)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def last_change(changes: DataFrame, key: list[str]) -> DataFrame:
    """Latest row per key from an update-mode changelog."""
    w = Window.partitionBy(*key).orderBy(F.col("_batch").desc())
    return changes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r", "_batch")


# ---------------------------------------------------------------- ST2
def latest_state_stream(scored: DataFrame) -> DataFrame:
    """ST2: latest reading per device by event time, update mode. The state is
    one row per device and stays: a device's last reading never expires."""
    payload = F.struct("ts", "event_id", "health_score", "anomaly_score", "status")
    return scored.groupBy("device_id").agg(F.max_by(payload, F.struct("ts", "event_id")).alias("_r")) \
                 .select("device_id", "_r.*")


@register("stream_latest_state", LATEST_READINGS_SQL, ids=("ST1", "ST2", "ST7", "S14", "S15"))
def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = latest_state_stream(scored_stream(event_stream(spark, sf_dir)))
    sink = run_available(st, spark, "latest_state", "update")
    latest = last_change(read_sink(spark, sink, st), ["device_id"])
    return latest.select("device_id", "ts", "event_id", rnd("health_score", 6).alias("health_score"),
                         rnd("anomaly_score", 6).alias("anomaly_score"), "status")


# ---------------------------------------------------------------- ST3
THRESHOLD_COLS = ["event_id", "device_id", "ts", "alert_type", "priority", "message"]


@register("stream_threshold_alerts", THRESHOLD_SQL, ids=("ST3", "S14"))
def stream_threshold_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings travel as messages; the alerts carry message and scores."""
    scored = scored_stream(event_stream(spark, sf_dir))
    st = threshold_alerts(from_messages(to_messages(scored), scored.schema)).select(
        *THRESHOLD_COLS, "health_score", "anomaly_score")
    sink = run_available(st, spark, "threshold_alerts")
    return read_sink(spark, sink, st).select(*THRESHOLD_COLS, rnd("health_score", 6).alias("health_score"),
                                             rnd("anomaly_score", 6).alias("anomaly_score"))


# ---------------------------------------------------------------- ST4
def rule_alert_stream(scored: DataFrame, rules=None) -> DataFrame:
    """Alerts (``outcome`` fired), and matches that came too late to be decided (late)."""
    rules = rules or default_rules()
    r = scored.withColumn("sensor_fault", sensor_fault(TELEMETRY_SENSORS))
    kept = ["rule", "rule_order", "device_id", "alert_type", "priority", "message", "ts", "event_id", "health_score",
            "anomaly_score"]
    m = rule_matches(r, rules).select(*kept, "cooldown_us")
    told = stream_cooldown(m, ["rule", "device_id"], "ts", "event_id", "cooldown_us")
    return told.select(alert_id(F.col("device_id"), F.col("alert_type"), F.col("ts")).alias("alert_id"), *kept, "outcome")


@register("stream_rule_alerts", fired_sql(default_rules()) + f"select {_hist_cols_sql()} from hist",
          ids=("ST4", "L2", "W13"))
def stream_rule_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = rule_alert_stream(scored_stream(event_stream(spark, sf_dir)))
    sink = run_available(st, spark, "rule_alerts")
    return _hist_cols(read_sink(spark, sink, st).where("outcome = 'fired'"))


# ---------------------------------------------------------------- ST5
@register("stream_buffers", f"""
with s as ({TELEMETRY_SQL}), sc as ({scored_sql()}),
l as (select * from (select *, row_number() over (partition by device_id order by ts desc, event_id desc) as rn
                     from sc) x where rn <= 100)
select device_id, count(*) as buffer_size, min(ts) as oldest, max(ts) as newest,
  round(avg(health_score), 6) as health_mean
from l group by device_id
""", ids=("ST5", "W10"))
def stream_buffers_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = stream_buffers(scored_stream(event_stream(spark, sf_dir)), 100)
    sink = run_available(st, spark, "buffers")
    last = last_change(read_sink(spark, sink, st), ["device_id"])
    return last.select("device_id", "buffer_size",
                       F.timestamp_micros("oldest_us").cast("timestamp_ntz").alias("oldest"),
                       F.timestamp_micros("newest_us").cast("timestamp_ntz").alias("newest"),
                       rnd("health_mean", 6).alias("health_mean"))


# ---------------------------------------------------------------- ST6
@register("stream_device_counts", """
select concat('DEVICE_', lpad(cast(user_id as varchar), 5, '0')) as device_id, count(*) as n_messages
from events group by 1
""", ids=("ST6", "A23"))
def stream_device_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = telemetry_of(event_stream(spark, sf_dir)).groupBy("device_id").agg(
        F.count(F.lit(1)).alias("n_messages"))
    sink = run_available(st, spark, "device_counts", "update")
    return last_change(read_sink(spark, sink, st), ["device_id"])


# ---------------------------------------------------------------- ST7 with M7
def prediction_stream(scored: DataFrame, length: int, scaler: dict | None = None) -> DataFrame:
    """The newest window of feature rows per device, as the model reads it."""
    rows = scored.select("device_id", "ts", "event_id", *[finite_or_zero(F.col(c)).alias(c) for c in FEATURES])
    return stream_sequences(apply_scaler(rows, scaler) if scaler else rows, FEATURES, length)


def run_predictions(spark: SparkSession, windows: DataFrame, predict: Callable[[DataFrame], DataFrame], name: str
                    ) -> tuple[DataFrame, str]:
    """Runs the stream through the predictor; the newest prediction per device, and the sink."""
    sink = run_available(windows, spark, name, sink=predicting_sink(predict))
    rows = read_sink(spark, sink, predict(spark.createDataFrame([], windows.schema)))
    return last_change(rows, ["device_id"]), sink


# A scorer whose figures SQL can repeat: a logistic curve over the window's mean
# reading. A fitted model takes its place through ``predict_all``.
CURVE_MIDDLE, CURVE_WIDTH = 40.0, 5.0


def curve_probability(windows: DataFrame) -> DataFrame:
    total = F.aggregate("seq", F.lit(0.0), lambda a, x: a + x)
    return windows.withColumn("maintenance_probability",
                              1 / (1 + F.exp(-(total / F.size("seq") - CURVE_MIDDLE) / CURVE_WIDTH)))


def predict_by_curve(windows: DataFrame) -> DataFrame:
    return predict_with(curve_probability, windows, settings=SETTINGS, method="window_curve")


_WINDOW_SQL = f"""
s as ({scored_sql()}),
r as (select *, row_number() over (partition by device_id order by ts desc, event_id desc) as rn from s),
l as (select device_id, max(ts) as ts, count(*) as n,
             1 / (1 + exp(-(sum({" + ".join(f"coalesce({c}, 0e0)" for c in FEATURES)}) / {SEQ_LEN * len(FEATURES)} - {CURVE_MIDDLE})
                          / {CURVE_WIDTH})) as p
      from r where rn <= {SEQ_LEN} group by device_id)
"""


@register("stream_predictions", f"""
with {_WINDOW_SQL}
select device_id, ts as "timestamp", case when n >= {SEQ_LEN} then round(p, 6) end as maintenance_probability,
  case when n >= {SEQ_LEN} then p > {DEFAULT.thresholds.maintenance_threshold} end as maintenance_needed,
  case when n < {SEQ_LEN} then 'not enough data' end as error
from l
""", ids=("ST7", "M7", "W9"))
def stream_predictions_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = prediction_stream(scored_stream(event_stream(spark, sf_dir)), SEQ_LEN)
    latest, _ = run_predictions(spark, windows, predict_by_curve, "predictions")
    return latest.select("device_id", "timestamp", rnd("maintenance_probability", 6).alias("maintenance_probability"),
                         "maintenance_needed", "error")


@register("stream_totals", f"""
with {_WINDOW_SQL}
select 'messages' as metric, count(*) as n from events union all
select 'devices', count(*) from l union all
select 'predictions', count(*) from l where n >= {SEQ_LEN} union all
select 'short histories', count(*) from l where n < {SEQ_LEN}
""", ids=("ST6",))
def stream_totals_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and predictions of a whole run; messages from the run's own counts."""
    scored = scored_stream(event_stream(spark, sf_dir))
    read = read_progress(spark, run_available(scored.select("device_id"), spark, "messages"))
    latest, _ = run_predictions(spark, prediction_stream(scored, SEQ_LEN), predict_by_curve, "totals")
    counts = latest.agg(F.count(F.lit(1)).alias("devices"), F.count("maintenance_probability").alias("predictions"),
                        F.count("error").alias("short histories"))
    return (read.agg(F.lit("messages").alias("metric"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))
            .unionByName(counts.unpivot([], ["devices", "predictions", "short histories"], "metric", "n")))
