"""Readers for the supplied parquet tables and the two views built on them.

``telemetry`` turns the ``events`` table into one sensor reading per event;
``tag_long`` turns it into a long tag-history table (device, ts, tag, value,
status), the shape the robot XML scan produces.  Both are plain projections,
so filters and column pruning reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gearsight.config import ROBOT_TAG_MAP

# Telemetry column for each catalogue sensor it carries.
TELEMETRY_SENSORS: dict[str, str] = {
    "temperature": "temperature",
    "vibration_x": "vibration_x",
    "pressure": "pressure",
    "current": "current_a",
    "voltage": "voltage",
    "power_factor": "power_factor",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def device_id_of(user_id: Column) -> Column:
    return F.concat(F.lit("DEVICE_"), F.lpad(user_id.cast("string"), 5, "0"))


def _k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("int")


TELEMETRY_SELECT = [
    "event_id",
    "concat('DEVICE_', lpad(cast(user_id AS STRING), 5, '0')) AS device_id",
    "ts",
    "CASE WHEN event_id % 97 = 0 THEN 200.0D WHEN event_id % 17 = 0 THEN CAST(NULL AS DOUBLE) "
    "ELSE 55.0D + (event_id * 7) % 41 END AS temperature",
    "0.3D + CAST((event_id * 11) % 20 AS DOUBLE) / 10 AS vibration_x",
    "1.5D + CAST(k % 30 AS DOUBLE) / 10 AS pressure",
    "10.0D + (event_id * 13) % 17 AS current_a",
    "200.0D + k % 45 AS voltage",
    "0.8D + CAST(k % 20 AS DOUBLE) / 100 AS power_factor",
]


def telemetry_of(events: DataFrame) -> DataFrame:
    """Events (batch or stream) -> one reading per event; ``k`` is parsed once."""
    e = events.selectExpr("event_id", "user_id", "ts", "CAST(get_json_object(props, '$.k') AS INT) AS k")
    return e.selectExpr(*TELEMETRY_SELECT)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per event (FIXTURES.md section 2)."""
    return telemetry_of(table(spark, sf_dir, "events"))


def tag_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long tag history: device, ts, tag, tag_value, status."""
    e = table(spark, sf_dir, "events")
    k = _k(F.col("props"))
    return e.select(
        F.col("event_id"),
        device_id_of(F.col("user_id")).alias("device_id"),
        F.col("ts"),
        F.col("event_type").alias("tag"),
        F.col("value").alias("tag_value"),
        F.when(k % 10 == 0, F.lit(1)).otherwise(F.lit(0)).alias("status"),
    )


def robot_tag_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tag history under the robot's own tag names: an event takes the name
    at its number modulo the length of the map."""
    names = sorted(ROBOT_TAG_MAP)
    at = (F.pmod(F.col("event_id"), F.lit(len(names))) + 1).cast("int")
    return tag_long(spark, sf_dir).withColumn("tag", F.element_at(F.array(*[F.lit(n) for n in names]), at))


# DuckDB text of the same views, used by the oracle SQL.
TELEMETRY_SQL = """
select event_id, concat('DEVICE_', lpad(cast(user_id as varchar), 5, '0')) as device_id, ts,
  case when event_id % 97 = 0 then 200.0e0
       when event_id % 17 = 0 then null
       else 55.0e0 + (event_id * 7) % 41 end as temperature,
  0.3e0 + cast((event_id * 11) % 20 as double) / 10 as vibration_x,
  1.5e0 + cast(k % 30 as double) / 10 as pressure,
  10.0e0 + (event_id * 13) % 17 as current_a,
  200.0e0 + k % 45 as voltage,
  0.8e0 + cast(k % 20 as double) / 100 as power_factor
from (select *, cast(json_extract_string(props, '$.k') as int) as k from events) e
"""

ROBOT_TAG_LONG_SQL = f"""
select event_id, ts, value as tag_value, [{", ".join(f"'{n}'" for n in sorted(ROBOT_TAG_MAP))}][event_id % {len(ROBOT_TAG_MAP)} + 1] as tag
from events
"""

TAG_LONG_SQL = """
select event_id, concat('DEVICE_', lpad(cast(user_id as varchar), 5, '0')) as device_id, ts,
  event_type as tag, value as tag_value,
  case when cast(json_extract_string(props, '$.k') as int) % 10 = 0 then 1 else 0 end as status
from events
"""
