"""Row-wise health, anomaly and status scores as Column expressions.

Everything is a plain Catalyst expression (stays in whole-stage codegen).
A sensor whose value is null counts as absent, the same as a missing key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gearsight.config import DEFAULT, SENSOR_CATALOG, Thresholds
from gearsight.functions.numeric import round_half_even_sql


def _known(sensors: dict[str, str]) -> list[tuple[str, str]]:
    """(catalogue name, column name) for the sensors the catalogue knows."""
    return [(name, col) for name, col in sensors.items() if name in SENSOR_CATALOG]


# The scores are written as Spark SQL text and parsed once (``F.expr``):
# one driver call per score instead of one per sub-expression.

def _count_sql(known: list[tuple[str, str]]) -> str:
    return " + ".join(f"(CASE WHEN `{c}` IS NOT NULL THEN 1 ELSE 0 END)" for _, c in known)


def health_score_sql(sensors: dict[str, str]) -> str:
    """max(0, 100 - 100 * mean(|v - baseline| / baseline)); 100 when no known sensor."""
    known = _known(sensors)
    if not known:
        return "100D"
    dev = " + ".join(f"coalesce(abs(`{c}` - {SENSOR_CATALOG[n][0]}D) / {SENSOR_CATALOG[n][0]}D, 0D)"
                     for n, c in known)
    cnt = _count_sql(known)
    return f"CASE WHEN ({cnt}) = 0 THEN 100D ELSE greatest(0D, 100D - ({dev}) / ({cnt}) * 100D) END"


def anomaly_score_sql(sensors: dict[str, str], health: str = "health_score") -> str:
    """min(1, 0.7 * (100 - h) / 100 + 0.3 * mean(out-of-range ratio))."""
    known = _known(sensors)
    health_part = f"(100D - `{health}`) / 100D * 0.7D"
    if not known:
        return f"least(1D, {health_part})"
    ratio = " + ".join(
        f"(CASE WHEN `{c}` < {lo}D THEN ({lo}D - `{c}`) / {lo}D "
        f"WHEN `{c}` > {hi}D THEN (`{c}` - {hi}D) / {hi}D ELSE 0D END)"
        for n, c in known for _, lo, hi in [SENSOR_CATALOG[n]])
    cnt = _count_sql(known)
    return (f"least(1D, {health_part} + "
            f"(CASE WHEN ({cnt}) = 0 THEN 0D ELSE ({ratio}) / ({cnt}) END) * 0.3D)")


def health_score(sensors: dict[str, str]) -> Column:
    return F.expr(health_score_sql(sensors))


def anomaly_score(sensors: dict[str, str], health: str = "health_score") -> Column:
    return F.expr(anomaly_score_sql(sensors, health))


def status_generic(health: Column, t: Thresholds = DEFAULT.thresholds) -> Column:
    """>= 70 normal, >= 30 warning, else critical (anomaly ignored)."""
    return (F.when(health >= t.health_normal, F.lit("normal"))
            .when(health >= t.health_warning, F.lit("warning"))
            .otherwise(F.lit("critical")))


def status_device(health: Column) -> Column:
    """F6 status policy: > 70 normal, > 30 warning, else critical."""
    return (F.when(health > 70, F.lit("normal"))
            .when(health > 30, F.lit("warning"))
            .otherwise(F.lit("critical")))


def anomaly_device(health: Column) -> Column:
    """F6 anomaly policy: min(1, (100 - h) / 70)."""
    return F.least(F.lit(1.0), (F.lit(100.0) - health) / 70.0)


def power_consumption(voltage: str, current: str, power_factor: str) -> Column:
    """round(V * I * pf / 1000, 2), rounding the binary value half-even
    as Python does (Q4)."""
    return F.expr(round_half_even_sql(f"(`{voltage}` * `{current}` * `{power_factor}` / 1000.0D)", 2))


def status_generic_sql(health: str = "health_score", t: Thresholds = DEFAULT.thresholds) -> str:
    return (f"CASE WHEN `{health}` >= {t.health_normal}D THEN 'normal' "
            f"WHEN `{health}` >= {t.health_warning}D THEN 'warning' ELSE 'critical' END")


def score(df, sensors: dict[str, str], t: Thresholds = DEFAULT.thresholds):
    """Add health_score, anomaly_score, status (F3 + F4 + F5) to a reading frame."""
    return (df.withColumn("health_score", health_score(sensors))
              .withColumns({"anomaly_score": anomaly_score(sensors, "health_score"),
                            "status": F.expr(status_generic_sql("health_score", t))}))


# ---- robot scores (F12-F14) ----

def _capped(x: Column, cap: float) -> Column:
    """min(cap, x), null when x is null (Spark's ``least`` would skip the null)."""
    return F.when(x.isNotNull(), F.least(F.lit(cap), x))


def robot_health(rms: Column, imbalance: Column, torque_total: Column) -> Column:
    """F12; a null term is skipped."""
    p_err = F.coalesce(_capped(rms * 20.0, 60.0), F.lit(0.0))
    p_imb = F.coalesce(_capped(imbalance * 2.0, 25.0), F.lit(0.0))
    p_tq = F.coalesce(F.when(torque_total > 100.0, _capped((torque_total - 100.0) * 0.1, 15.0)),
                      F.lit(0.0))
    return F.greatest(F.lit(0.0), F.lit(100.0) - p_err - p_imb - p_tq)


def robot_anomaly(rms: Column, health: Column, imbalance: Column, err_std: Column) -> Column:
    """F13; a null term is skipped."""
    s = (F.coalesce(_capped(rms / 5.0, 0.6), F.lit(0.0))
         + (F.lit(100.0) - health) / 150.0
         + F.coalesce(_capped(imbalance / 30.0, 0.3), F.lit(0.0))
         + F.coalesce(_capped(err_std / 10.0, 0.1), F.lit(0.0)))
    return F.least(F.lit(1.0), s)


def robot_status(health: Column, anomaly: Column) -> Column:
    """h >= 85 and a < .2 normal; h >= 60 and a < .5 warning; else critical."""
    return (F.when((health >= 85) & (anomaly < 0.2), F.lit("normal"))
            .when((health >= 60) & (anomaly < 0.5), F.lit("warning"))
            .otherwise(F.lit("critical")))
