"""Sensor-level expressions: flatten/pack (P1-P3), validation (P6),
normalisation (P8), NaN clean-up (P12), fault test (F18), tag naming (F19),
labels and risk (F15-F17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearsight.config import DEFAULT, FAULT_LIMITS, RISK_ADVICE, SENSOR_CATALOG, Thresholds


# ---- P1-P3 ----

def flatten_sensors(df: DataFrame, sensors: list[str], map_col: str = "sensors") -> DataFrame:
    """Wide columns from a MAP<STRING,DOUBLE>; a missing key is null."""
    rest = [c for c in df.columns if c != map_col]
    return df.select(*rest, *[F.col(map_col)[s].alias(s) for s in sensors])


def expand_json_sensors(df: DataFrame, sensors: list[str], json_col: str = "sensor_data") -> DataFrame:
    """Parse a JSON object of sensor values, then flatten; bad JSON gives nulls."""
    parsed = df.withColumn("_sensors", F.from_json(F.col(json_col), "map<string,double>"))
    return flatten_sensors(parsed.drop(json_col), sensors, "_sensors")


def pack_sensors(sensors: dict[str, str | Column]) -> Column:
    """JSON text of the sensor map (null values dropped)."""
    m = F.map_from_arrays(F.array(*[F.lit(k) for k in sensors]),
                          F.array(*[F.col(v) if isinstance(v, str) else v for v in sensors.values()]))
    return F.to_json(F.map_filter(m, lambda k, v: v.isNotNull()))


def sensors_map(sensors: dict[str, str | Column]) -> Column:
    """Wide columns to a MAP<STRING,DOUBLE>, null values dropped (a null is an absent key)."""
    m = F.map_from_arrays(F.array(*[F.lit(k) for k in sensors]),
                          F.array(*[(F.col(v) if isinstance(v, str) else v).cast("double")
                                    for v in sensors.values()]))
    return F.map_filter(m, lambda k, v: v.isNotNull())


# ---- P6 ----

def validation_reasons(sensors: dict[str, str | Column], required: dict[str, Column]) -> Column:
    """Array of reasons a reading is invalid (empty = valid).

    Required fields must be present; each known sensor must lie in
    [lo, 2 * hi] (the low bound is not widened); unknown sensors pass.
    """
    checks = [F.when(c.isNull(), F.lit(f"missing:{name}")) for name, c in required.items()]
    for name, col in sensors.items():
        if name not in SENSOR_CATALOG:
            continue
        c = F.col(col) if isinstance(col, str) else col
        _, lo, hi = SENSOR_CATALOG[name]
        checks.append(F.when(c.isNotNull() & ((c < lo) | (c > 2 * hi) | F.isnan(c)),
                             F.lit(f"range:{name}")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


# ---- P8 ----

def normalize(name: str, c: Column) -> Column:
    """clamp(v / (2 * baseline), 0, 1); unknown sensors unchanged."""
    if name not in SENSOR_CATALOG:
        return c
    b = SENSOR_CATALOG[name][0]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / (2 * b)))


def normalize_map(m: Column) -> Column:
    """P8 over a sensor map: catalogue sensors scaled, others unchanged."""
    def f(k, v):
        base = None
        for name, (b, _, _) in SENSOR_CATALOG.items():
            base = F.when(k == name, F.lit(b)) if base is None else base.when(k == name, F.lit(b))
        return F.when(base.isNull(), v).otherwise(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / (base * 2))))
    return F.transform_values(m, f)


# ---- P12 ----

def finite_or_zero(c: Column) -> Column:
    """NaN, +-infinity and null become 0."""
    return (F.when(c.isNull() | F.isnan(c) | (c == float("inf")) | (c == float("-inf")), F.lit(0.0))
            .otherwise(c.cast("double")))


# ---- F18 ----

def _fault_limits(name: str):
    if name.startswith("vibration"):
        return FAULT_LIMITS["vibration"]
    return FAULT_LIMITS.get(name)


def sensor_fault(sensors: dict[str, str | Column]) -> Column:
    """F18 over wide columns: any checked sensor outside its inclusive limits."""
    conds = []
    for name, col in sensors.items():
        lim = _fault_limits(name)
        if lim is None:
            continue
        c = F.col(col) if isinstance(col, str) else col
        conds.append(F.coalesce((c < lim[0]) | (c > lim[1]), F.lit(False)))
    if not conds:
        return F.lit(False)
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def sensor_fault_map(m: Column) -> Column:
    """F18 over a sensor map (``exists`` over its entries)."""
    def bad(e):
        k, v = e["key"], e["value"]
        out = F.lit(False)
        for name, (lo, hi) in FAULT_LIMITS.items():
            # every vibration axis has the limits of its group
            mine = k.startswith(name) if name == "vibration" else k == name
            out = out | (mine & ((v < lo) | (v > hi)))
        return out
    return F.coalesce(F.exists(F.map_entries(m), bad), F.lit(False))


# ---- F19 ----

def suggest_sensor_name(tag: Column) -> Column:
    """joint number from j#/ax#/axis# (1-9, first hit), then a suffix by keyword."""
    t = F.lower(tag)
    joint = None
    for i in range(1, 10):
        hit = t.contains(f"j{i}") | t.contains(f"ax{i}") | t.contains(f"axis{i}")
        joint = F.when(hit, F.lit(i)) if joint is None else joint.when(hit, F.lit(i))
    # fixed values: keyword -> (name with joint, name without joint)
    rules = [
        ("actualposition", "actual_pos", "actual_position"),
        ("positioncommand", "cmd_pos", "cmd_position"),
        ("positionerror", "pos_error", "position_error"),
        ("actualvelocity", "velocity", "velocity"),
        ("actualtorque", "torque", "torque"),
        ("temperature", "temp", "temperature"),
        ("current", "current", "current"),
    ]
    out = None
    for kw, with_j, without in rules:
        val = F.when(joint.isNotNull(),
                     F.concat(F.lit("joint"), joint.cast("string"), F.lit("_" + with_j))
                     ).otherwise(F.lit(without))
        out = F.when(t.contains(kw), val) if out is None else out.when(t.contains(kw), val)
    return out


# ---- F15-F17 ----

def label_generic(anomaly: Column | None, health: Column | None) -> Column:
    """F15 generic policy: anomaly > 0.7; else (no anomaly column) health < 50; else 0."""
    if anomaly is not None:
        return F.when(anomaly > 0.7, F.lit(1)).otherwise(F.lit(0))
    if health is not None:
        return F.when(health < 50, F.lit(1)).otherwise(F.lit(0))
    return F.lit(0)


def label_robot(health: Column, anomaly: Column) -> Column:
    """F15 robot policy: health < 70 or anomaly > 0.5."""
    return F.when((health < 70) | (anomaly > 0.5), F.lit(1)).otherwise(F.lit(0))


def failure_risk(anomaly: Column | None) -> Column:
    """F16: (0,.3] low, (.3,.7] medium, (.7,1] high; 0 or outside is null."""
    if anomaly is None:
        return F.lit("low")
    return (F.when((anomaly > 0) & (anomaly <= 0.3), F.lit("low"))
            .when((anomaly > 0.3) & (anomaly <= 0.7), F.lit("medium"))
            .when((anomaly > 0.7) & (anomaly <= 1.0), F.lit("high")))


def prediction_risk(p: Column, t: Thresholds = DEFAULT.thresholds) -> Column:
    """< .3 low, < .7 medium, else high."""
    return (F.when(p < t.risk_low, F.lit("low"))
            .when(p < t.risk_medium, F.lit("medium"))
            .otherwise(F.lit("high")))


def risk_advice(level: Column) -> Column:
    m = F.create_map(*[x for k, v in RISK_ADVICE.items() for x in (F.lit(k), F.lit(v))])
    return m[level]
