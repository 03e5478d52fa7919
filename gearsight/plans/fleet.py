"""Fleet-level views: scored readings, latest reading per device, fleet summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearsight.functions.numeric import rnd

from gearsight.config import DEFAULT
from gearsight.functions.scoring import score
from gearsight.operators.latest import latest_per_device
from gearsight.plans.registry import register
from gearsight.sources.tables import TELEMETRY_SENSORS, TELEMETRY_SQL, telemetry

STATUSES = ("normal", "warning", "critical")


def scored_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """telemetry + health_score, anomaly_score, status."""
    return score(telemetry(spark, sf_dir), TELEMETRY_SENSORS, DEFAULT.thresholds)


def fleet_summary_of(latest: DataFrame) -> DataFrame:
    """A4 over one-row-per-device input: a row per status, zero-filled.

    One global aggregate (partial per task, one tiny final merge), then an
    unpivot: no shuffle of the device rows themselves.
    """
    agg = latest.agg(
        F.count(F.lit(1)).alias("fleet_devices"),
        F.avg("health_score").alias("fleet_avg_health"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES],
        *[F.avg(F.when(F.col("status") == s, F.col("health_score"))).alias(f"h_{s}")
          for s in STATUSES],
    )
    stacked = ", ".join(f"'{s}', n_{s}, h_{s}" for s in STATUSES)
    long = agg.selectExpr("fleet_devices", "fleet_avg_health",
                          f"stack({len(STATUSES)}, {stacked}) as (status, n_devices, avg_health)")
    return long.select(
        "status",
        F.col("n_devices").cast("bigint").alias("n_devices"),
        rnd(F.when(F.col("fleet_devices") > 0,
                       F.col("n_devices") * 100.0 / F.col("fleet_devices"))
                .otherwise(F.lit(0.0)), 6).alias("pct_devices"),
        rnd(F.coalesce(F.col("avg_health"), F.lit(0.0)), 6).alias("avg_health"),
        F.col("fleet_devices").cast("bigint").alias("fleet_devices"),
        rnd(F.coalesce(F.col("fleet_avg_health"), F.lit(0.0)), 6).alias("fleet_avg_health"),
    )


# ---- DuckDB oracle pieces ----

def _health_sql(cols: dict[str, str]) -> tuple[str, str]:
    from gearsight.config import SENSOR_CATALOG
    dev = " + ".join(f"coalesce(abs({c} - {SENSOR_CATALOG[n][0]}e0) / {SENSOR_CATALOG[n][0]}e0, 0e0)"
                     for n, c in cols.items())
    cnt = " + ".join(f"(case when {c} is not null then 1 else 0 end)" for c in cols.values())
    return dev, cnt


def scored_sql(cols: dict[str, str] = TELEMETRY_SENSORS) -> str:
    from gearsight.config import SENSOR_CATALOG
    dev, cnt = _health_sql(cols)
    ratio = " + ".join(
        f"(case when {c} < {SENSOR_CATALOG[n][1]}e0 then ({SENSOR_CATALOG[n][1]}e0 - {c}) / {SENSOR_CATALOG[n][1]}e0 "
        f"when {c} > {SENSOR_CATALOG[n][2]}e0 then ({c} - {SENSOR_CATALOG[n][2]}e0) / {SENSOR_CATALOG[n][2]}e0 else 0e0 end)"
        for n, c in cols.items())
    return f"""
with t as ({TELEMETRY_SQL}),
h as (select *, case when ({cnt}) = 0 then 100e0 else greatest(0e0, 100e0 - ({dev}) / ({cnt}) * 100e0) end as health_score,
             ({cnt}) as n_known, ({ratio}) as ratio_sum from t),
a as (select *, least(1e0, (100e0 - health_score) / 100e0 * 0.7e0
                  + (case when n_known = 0 then 0e0 else ratio_sum / n_known end) * 0.3e0) as anomaly_score from h)
select * exclude (n_known, ratio_sum),
  case when health_score >= 70 then 'normal' when health_score >= 30 then 'warning' else 'critical' end as status
from a
"""


LATEST_SQL = f"""
latest as (
  select * from (select *, row_number() over (partition by device_id order by ts desc, event_id desc) as rn
                 from ({scored_sql()}) s) where rn = 1)
"""

FLEET_SUMMARY_SQL = f"""
with {LATEST_SQL},
tot as (select count(*) as fleet_devices, avg(health_score) as fleet_avg_health from latest),
st as (select * from (values ('normal'), ('warning'), ('critical')) v(status))
select st.status,
  cast(count(l.device_id) as bigint) as n_devices,
  round(case when tot.fleet_devices > 0 then count(l.device_id) * 100.0e0 / tot.fleet_devices else 0e0 end, 6) as pct_devices,
  round(coalesce(avg(l.health_score), 0e0), 6) as avg_health,
  cast(tot.fleet_devices as bigint) as fleet_devices,
  round(coalesce(tot.fleet_avg_health, 0e0), 6) as fleet_avg_health
from st cross join tot left join latest l on l.status = st.status
group by st.status, tot.fleet_devices, tot.fleet_avg_health
"""


@register("fleet_summary", FLEET_SUMMARY_SQL, ids=("F3", "F4", "F5", "W11", "A4"))
def fleet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = latest_per_device(scored_telemetry(spark, sf_dir), "device_id",
                               order=["ts", "event_id"])
    return fleet_summary_of(latest)


SCORED_SQL = f"""
select event_id, device_id, ts, round(health_score, 6) as health_score,
  round(anomaly_score, 6) as anomaly_score, status
from ({scored_sql()}) s
"""


@register("reading_scores", SCORED_SQL, ids=("F3", "F4", "F5"))
def reading_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_telemetry(spark, sf_dir)
    return s.select("event_id", "device_id", "ts",
                    rnd("health_score", 6).alias("health_score"),
                    rnd("anomaly_score", 6).alias("anomaly_score"), "status")


LATEST_READINGS_SQL = f"""
with {LATEST_SQL}
select device_id, ts, event_id, round(health_score, 6) as health_score,
  round(anomaly_score, 6) as anomaly_score, status
from latest
"""


@register("latest_readings", LATEST_READINGS_SQL, ids=("W11", "2.13"))
def latest_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = latest_per_device(scored_telemetry(spark, sf_dir), "device_id",
                               order=["ts", "event_id"])
    return latest.select("device_id", "ts", "event_id",
                         rnd("health_score", 6).alias("health_score"),
                         rnd("anomaly_score", 6).alias("anomaly_score"), "status")


# ---------------------------------------------------------------- F6 device policy
@register("device_policy_scores", f"""
select event_id, round(least(1e0, (100e0 - health_score) / 70e0), 6) as anomaly_device,
  case when health_score > 70 then 'normal' when health_score > 30 then 'warning' else 'critical' end as status_device
from ({scored_sql()}) s
""", ids=("F6",))
def device_policy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the simulator's status (> 70 / > 30) and anomaly ((100 - h) / 70) policy."""
    from gearsight.functions.scoring import anomaly_device, status_device
    s = scored_telemetry(spark, sf_dir)
    return s.select("event_id", rnd(anomaly_device(F.col("health_score")), 6).alias("anomaly_device"),
                    status_device(F.col("health_score")).alias("status_device"))
