"""Reports over scored readings (A3, A5-A14, A20, A21, A23) and the
row-wise expression queries (F1, F2, F7, F18, P6, P8).

Aggregates are single ``groupBy``/global ``agg`` jobs: partial aggregation
in each task, so a hot device adds no shuffle volume.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearsight.functions.numeric import rnd, round_half_even, round_half_even_sql

from gearsight.config import SENSOR_CATALOG
from gearsight.functions.calendar import add_time_features
from gearsight.functions.scoring import power_consumption
from gearsight.functions.sensors import (label_generic, normalize, sensor_fault,
                                         validation_reasons)
from gearsight.operators.latest import latest_per_device
from gearsight.plans.fleet import scored_sql, scored_telemetry
from gearsight.plans.registry import register
from gearsight.sources.tables import TELEMETRY_SENSORS, TELEMETRY_SQL, table, telemetry

SCORED = f"({scored_sql()}) s"
TELE = f"({TELEMETRY_SQL}) t"

HOURS = "(unix_micros(cast(max(ts) as timestamp)) - unix_micros(cast(min(ts) as timestamp))) / 3.6e9"
HOURS_SQL = "(epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9"


def _micros(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def _hours_span():
    return (F.max(_micros("ts")) - F.min(_micros("ts"))) / 3.6e9


def with_total(df: DataFrame, col: str, out: str) -> DataFrame:
    """Attach the column total to every row: a one-row aggregate joined on a
    constant key with a broadcast hint (its size is exactly one row), so no
    single task sees all rows."""
    tot = df.agg(F.sum(col).cast("bigint").alias(out)).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(tot), "_one").drop("_one")


# ---------------------------------------------------------------- A3
def device_stats_of(scored: DataFrame, decimals: int = 2) -> DataFrame:
    """A3; values rounded like pandas ``.round(2)`` (binary value, half-even)."""
    agg = scored.groupBy("device_id").agg(
        F.avg("health_score").alias("health_mean"),
        F.min("health_score").alias("health_min"),
        F.stddev_samp("health_score").alias("health_std"),
        F.avg("anomaly_score").alias("anomaly_mean"),
        F.max("anomaly_score").alias("anomaly_max"),
        _hours_span().alias("hours_max"),
    )
    return agg.select("device_id", *[round_half_even(c, decimals).alias(c) for c in agg.columns[1:]])


_A3 = ["health_mean", "health_min", "health_std", "anomaly_mean", "anomaly_max", "hours_max"]


@register("device_stats", f"""
select device_id, {", ".join(round_half_even_sql(c, 2) + " as " + c for c in _A3)} from (
select device_id, avg(health_score) as health_mean, min(health_score) as health_min,
  stddev_samp(health_score) as health_std, avg(anomaly_score) as anomaly_mean,
  max(anomaly_score) as anomaly_max, {HOURS_SQL} as hours_max
from {SCORED} group by device_id) x
""", ids=("A3",))
def device_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return device_stats_of(scored_telemetry(spark, sf_dir))


# ---------------------------------------------------------------- A5
@register("dataset_kpis", f"""
select count(*) as n_rows, count(distinct device_id) as n_devices,
  round(avg(health_score), 6) as health_mean,
  round(avg(case when anomaly_score > 0.7 then 1e0 else 0e0 end), 6) as high_anomaly_share
from {SCORED}
""", ids=("A5",))
def dataset_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_telemetry(spark, sf_dir)
    return s.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("device_id").alias("n_devices"),
        rnd(F.avg("health_score"), 6).alias("health_mean"),
        rnd(F.avg((F.col("anomaly_score") > 0.7).cast("double")), 6).alias("high_anomaly_share"),
    )


# ---------------------------------------------------------------- A6
@register("hourly_anomaly", f"""
select cast(hour(ts) as bigint) as hour, round(avg(anomaly_score), 6) as anomaly_mean, count(*) as n
from {SCORED} group by 1
""", ids=("A6",))
def hourly_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_telemetry(spark, sf_dir)
    return (s.groupBy(F.hour("ts").cast("bigint").alias("hour"))
             .agg(rnd(F.avg("anomaly_score"), 6).alias("anomaly_mean"),
                  F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- A7
def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width histogram over [min, max]; last bin right-closed; empty bins kept.

    The range is one global aggregate brought to the driver (two numbers),
    then the bin index is a plain expression and the counts one groupBy.
    """
    spark = df.sparkSession
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    if lo is None:
        return spark.range(bins).select(
            F.col("id").alias("bin"), F.lit(None).cast("double").alias("bin_lo"),
            F.lit(None).cast("double").alias("bin_hi"), F.lit(0).cast("bigint").alias("n"))
    width = (hi - lo) / bins if hi > lo else 0.0
    v = F.col(col)
    b = (F.when(v.isNull(), F.lit(None))
         .when(F.lit(width) == 0, F.lit(0))
         .otherwise(F.least(F.lit(bins - 1), F.floor((v - F.lit(lo)) / F.lit(hi - lo) * bins)))
         ).cast("bigint")
    counts = df.select(b.alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"))
    spine = spark.range(bins).select(F.col("id").alias("bin"))
    return (spine.join(counts, "bin", "left")
            .select("bin",
                    rnd(F.lit(lo) + F.col("bin") * F.lit(width), 6).alias("bin_lo"),
                    rnd(F.lit(lo) + (F.col("bin") + 1) * F.lit(width), 6).alias("bin_hi"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def _hist_sql(col: str, bins: int, src: str) -> str:
    return f"""
with r as (select min({col}) as lo, max({col}) as hi from {src}),
b as (select cast(case when r.hi = r.lo then 0 else least({bins - 1}, floor(({col} - r.lo) / (r.hi - r.lo) * {bins})) end as bigint) as bin
      from {src}, r where {col} is not null),
c as (select bin, count(*) as n from b group by bin)
select s.i as bin, round(r.lo + s.i * ((r.hi - r.lo) / {bins}), 6) as bin_lo,
  round(r.lo + (s.i + 1) * ((r.hi - r.lo) / {bins}), 6) as bin_hi, cast(coalesce(c.n, 0) as bigint) as n
from range(0, {bins}) s(i) cross join r left join c on c.bin = s.i
"""


@register("health_histogram", _hist_sql("health_score", 20, SCORED), ids=("A7",))
def health_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(scored_telemetry(spark, sf_dir), "health_score", 20)


@register("temperature_histogram", _hist_sql("temperature", 30, TELE), ids=("A7",))
def temperature_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(telemetry(spark, sf_dir), "temperature", 30)


# ---------------------------------------------------------------- A8 / A9
CORR_COLS = list(TELEMETRY_SENSORS.values()) + ["health_score", "anomaly_score"]


def correlation_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson r for every ordered pair (pairwise-complete rows), one aggregate."""
    pairs = list(combinations(cols, 2))
    wide = df.selectExpr(*[f"corr(`{a}`, `{b}`) AS r{i}" for i, (a, b) in enumerate(pairs)])
    rows = [f"'{a}', '{b}', r{i}, '{b}', '{a}', r{i}" for i, (a, b) in enumerate(pairs)]
    rows += [f"'{c}', '{c}', 1.0D" for c in cols]
    n = 2 * len(pairs) + len(cols)
    return wide.selectExpr(f"stack({n}, {', '.join(rows)}) AS (col_a, col_b, r)")


def _corr_sql(cols: list[str], src: str) -> str:
    pairs = list(combinations(cols, 2))
    aggs = ", ".join(f"corr({a}, {b}) as r{i}" for i, (a, b) in enumerate(pairs))
    rows = []
    for i, (a, b) in enumerate(pairs):
        rows.append(f"select '{a}' as col_a, '{b}' as col_b, r{i} as r from w")
        rows.append(f"select '{b}' as col_a, '{a}' as col_b, r{i} as r from w")
    rows += [f"select '{c}' as col_a, '{c}' as col_b, 1e0 as r" for c in cols]
    return f"with w as (select {aggs} from {src}) " + " union all ".join(rows)


CORR_SQL = _corr_sql(CORR_COLS, SCORED)


@register("sensor_correlation", f"select col_a, col_b, round(r, 6) as r from ({CORR_SQL}) x",
          ids=("A8",))
def sensor_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = correlation_long(scored_telemetry(spark, sf_dir), CORR_COLS)
    return c.select("col_a", "col_b", rnd("r", 6).alias("r"))


def strong_pairs(corr: DataFrame, threshold: float = 0.7, k: int = 5) -> DataFrame:
    """Pairs (a < b by name) with |r| > threshold, top k by |r| then names (Q5: all columns)."""
    return (corr.where((F.col("col_a") < F.col("col_b")) & (F.abs("r") > threshold))
                .orderBy(F.abs("r").desc(), "col_a", "col_b").limit(k))


@register("correlated_pairs", f"""
select col_a, col_b, round(r, 6) as r from ({CORR_SQL}) x
where col_a < col_b and abs(r) > 0.7 order by abs(r) desc, col_a, col_b limit 5
""", ids=("A9", "O4"))
def correlated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = correlation_long(scored_telemetry(spark, sf_dir), CORR_COLS)
    return strong_pairs(c).select("col_a", "col_b", rnd("r", 6).alias("r"))


# ---------------------------------------------------------------- A10
def status_distribution_of(df: DataFrame, col: str = "status") -> DataFrame:
    """A10: count per value and its share of all rows (a window over the few groups)."""
    from pyspark.sql import Window
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return g.select(col, "n", rnd(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6)
                    .alias("pct"))


@register("status_distribution", f"""
select status, count(*) as n, round(count(*) * 100.0e0 / sum(count(*)) over (), 6) as pct
from {SCORED} group by status
""", ids=("A10",))
def status_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_distribution_of(scored_telemetry(spark, sf_dir))


# ---------------------------------------------------------------- A11
@register("time_span", f"""
select min(ts) as first_ts, max(ts) as last_ts,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) as duration_sec, count(*) as n_rows
from events
""", ids=("A11",))
def time_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                 rnd((F.max(_micros("ts")) - F.min(_micros("ts"))) / 1e6, 6).alias("duration_sec"),
                 F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- A12
def missing_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null count and percent per column, only columns with nulls; one aggregate + stack."""
    cols = cols or df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(cols)])
    stacked = ", ".join(f"'{c}', _m{i}" for i, c in enumerate(cols))
    long = agg.selectExpr("_n", f"stack({len(cols)}, {stacked}) as (column_name, n_missing)")
    return (long.where(F.col("n_missing") > 0)
                .select("column_name", F.col("n_missing").cast("bigint").alias("n_missing"),
                        rnd(F.col("n_missing") * 100.0 / F.col("_n"), 6).alias("pct_missing")))


TELE_COLS = ["event_id", "device_id", "ts"] + list(TELEMETRY_SENSORS.values())


@register("missing_profile", "select * from (" + " union all ".join(
    f"select '{c}' as column_name, cast(count(*) filter (where {c} is null) as bigint) as n_missing, "
    f"round(count(*) filter (where {c} is null) * 100.0e0 / count(*), 6) as pct_missing from {TELE}"
    for c in TELE_COLS) + ") x where n_missing > 0", ids=("A12",))
def missing_profile_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_profile(telemetry(spark, sf_dir), TELE_COLS)


# ---------------------------------------------------------------- A13
@register("score_summary", f"""
select round(avg(health_score), 6) as health_mean, round(min(health_score), 6) as health_min,
  round(max(health_score), 6) as health_max, round(avg(anomaly_score), 6) as anomaly_mean,
  round(min(anomaly_score), 6) as anomaly_min, round(max(anomaly_score), 6) as anomaly_max
from {SCORED}
""", ids=("A13",))
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_telemetry(spark, sf_dir)
    return s.agg(*[rnd(f(c), 6).alias(f"{c.split('_')[0]}_{n}")
                   for c in ("health_score", "anomaly_score")
                   for f, n in ((F.avg, "mean"), (F.min, "min"), (F.max, "max"))])


# ---------------------------------------------------------------- A14
def device_trend_of(scored: DataFrame) -> DataFrame:
    """One aggregate per device; 'current' values by max_by on (ts, event_id)."""
    key = F.struct("ts", "event_id")
    return scored.groupBy("device_id").agg(
        rnd(F.max_by("health_score", key), 6).alias("health_current"),
        rnd(F.avg("health_score"), 6).alias("health_mean"),
        rnd(F.min("health_score"), 6).alias("health_min"),
        rnd(F.max("health_score"), 6).alias("health_max"),
        rnd(F.stddev_samp("health_score"), 6).alias("health_std"),
        rnd(F.avg("anomaly_score"), 6).alias("anomaly_mean"),
        rnd(F.max("anomaly_score"), 6).alias("anomaly_max"),
        rnd(F.max_by("anomaly_score", key), 6).alias("anomaly_current"),
        rnd(_hours_span(), 6).alias("operating_hours"),
        F.count(F.lit(1)).alias("data_points"),
    )


@register("device_trend", f"""
select device_id,
  round(arg_max(health_score, (ts, event_id)), 6) as health_current,
  round(avg(health_score), 6) as health_mean, round(min(health_score), 6) as health_min,
  round(max(health_score), 6) as health_max, round(stddev_samp(health_score), 6) as health_std,
  round(avg(anomaly_score), 6) as anomaly_mean, round(max(anomaly_score), 6) as anomaly_max,
  round(arg_max(anomaly_score, (ts, event_id)), 6) as anomaly_current,
  round({HOURS_SQL}, 6) as operating_hours, count(*) as data_points
from {SCORED} group by device_id
""", ids=("A14",))
def device_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return device_trend_of(scored_telemetry(spark, sf_dir))


# ---------------------------------------------------------------- A20
@register("label_balance", f"""
with l as (select case when anomaly_score > 0.7 then 1 else 0 end as label from {SCORED}),
c as (select label, count(*) as n from l group by label),
v as (select * from (values (0), (1)) x(label))
select cast(v.label as bigint) as label, cast(coalesce(c.n, 0) as bigint) as n,
  round(coalesce(c.n, 0) * 1.0e0 / (select count(*) from l), 6) as share
from v left join c on c.label = v.label
""", ids=("A20", "F15"))
def label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_telemetry(spark, sf_dir)
    lab = label_generic(F.col("anomaly_score"), F.col("health_score"))
    agg = s.agg(F.count(F.lit(1)).alias("_n"), F.count_if(lab == 0).alias("_c0"),
                F.count_if(lab == 1).alias("_c1"))
    long = agg.selectExpr("_n", "stack(2, 0, _c0, 1, _c1) as (label, n)")
    return long.select(F.col("label").cast("bigint").alias("label"), F.col("n").cast("bigint").alias("n"),
                       rnd(F.when(F.col("_n") > 0, F.col("n") / F.col("_n")).otherwise(0.0), 6)
                       .alias("share"))


# ---------------------------------------------------------------- A21
def variance_top(df: DataFrame, cols: list[str], k: int = 50) -> DataFrame:
    """Sample variance per column in one aggregate, top k (ties by name)."""
    agg = df.agg(*[F.var_samp(c).alias(f"_v{i}") for i, c in enumerate(cols)])
    stacked = ", ".join(f"'{c}', _v{i}" for i, c in enumerate(cols))
    long = agg.selectExpr(f"stack({len(cols)}, {stacked}) as (column_name, variance)")
    return (long.orderBy(F.col("variance").desc_nulls_last(), "column_name").limit(k)
                .select("column_name", rnd("variance", 6).alias("variance")))


LINEITEM_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@register("variance_top", "select * from (" + " union all ".join(
    f"select '{c}' as column_name, round(var_samp({c}), 6) as variance from lineitem"
    for c in LINEITEM_NUM) + ") x order by variance desc nulls last, column_name limit 50",
    ids=("A21", "O4"))
def variance_top_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variance_top(table(spark, sf_dir, "lineitem"), LINEITEM_NUM, 50)


# ---------------------------------------------------------------- A23
@register("device_message_counts", f"""
select device_id, count(*) as n_messages, sum(count(*)) over () as n_total
from {TELE} group by device_id
""", ids=("A23", "S9", "O6"))
def device_message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = telemetry(spark, sf_dir).groupBy("device_id").agg(F.count(F.lit(1)).alias("n_messages"))
    return with_total(g, "n_messages", "n_total")


# ---------------------------------------------------------------- F1 / F2
@register("time_features", """
select event_id, cast(hour(ts) as bigint) as hour, cast(minute(ts) as bigint) as minute,
  cast(isodow(ts) - 1 as bigint) as day_of_week, cast(month(ts) as bigint) as month,
  cast(quarter(ts) as bigint) as quarter,
  cast(case when isodow(ts) in (6, 7) then 1 else 0 end as bigint) as is_weekend,
  case when hour(ts) > 0 and hour(ts) <= 6 then 'night' when hour(ts) > 6 and hour(ts) <= 12 then 'morning'
       when hour(ts) > 12 and hour(ts) <= 18 then 'afternoon' when hour(ts) > 18 then 'evening' end as time_period
from events
""", ids=("F1", "F2"))
def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = add_time_features(table(spark, sf_dir, "events").select("event_id", "ts"))
    return e.select("event_id", *[F.col(c).cast("bigint").alias(c) for c in
                                  ("hour", "minute", "day_of_week", "month", "quarter", "is_weekend")],
                    "time_period")


# ---------------------------------------------------------------- P6
def _validation_sql() -> str:
    parts = []
    for name, c in TELEMETRY_SENSORS.items():
        _, lo, hi = SENSOR_CATALOG[name]
        parts.append(f"case when {c} is not null and ({c} < {lo} or {c} > {2 * hi}) then 'range:{name}' end")
    arr = "list_filter([" + ", ".join(
        ["case when device_id is null then 'missing:device_id' end",
         "case when ts is null then 'missing:timestamp' end"] + parts) + "], lambda x: x is not null)"
    return f"""
select event_id, device_id, len(r) = 0 as valid, array_to_string(r, ',') as reasons
from (select *, {arr} as r from {TELE}) v
"""


def validate_readings(df: DataFrame, sensors: dict[str, str]) -> DataFrame:
    """Adds ``reasons`` (array) and ``valid``; split with ``where(valid)`` / ``where(!valid)``."""
    r = validation_reasons(sensors, {"device_id": F.col("device_id"), "timestamp": F.col("ts")})
    return df.withColumn("reasons", r).withColumn("valid", F.size("reasons") == 0)


@register("reading_validation", _validation_sql(), ids=("P6",))
def reading_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = validate_readings(telemetry(spark, sf_dir), TELEMETRY_SENSORS)
    return v.select("event_id", "device_id", "valid", F.array_join("reasons", ",").alias("reasons"))


# ---------------------------------------------------------------- P8
def _norm_sql() -> str:
    cols = ", ".join(
        f"round(greatest(0e0, least(1e0, {c} / {2 * SENSOR_CATALOG[n][0]}e0)), 6) as {c}"
        for n, c in TELEMETRY_SENSORS.items())
    return f"select event_id, {cols} from {TELE}"


@register("sensor_normalized", _norm_sql(), ids=("P8",))
def sensor_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    return t.select("event_id", *[rnd(normalize(n, F.col(c)), 6).alias(c)
                                  for n, c in TELEMETRY_SENSORS.items()])


# ---------------------------------------------------------------- F18
@register("sensor_faults", f"""
select event_id, device_id, ts from {TELE}
where temperature < 0 or temperature > 150 or vibration_x < 0 or vibration_x > 10
   or pressure < 0 or pressure > 10 or current_a < 0 or current_a > 50
""", ids=("F18",))
def sensor_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    return t.where(sensor_fault(TELEMETRY_SENSORS)).select("event_id", "device_id", "ts")


# ---------------------------------------------------------------- F7
@register("power_consumption", f"""
select event_id, {round_half_even_sql("(voltage * current_a * power_factor / 1000.0e0)", 2)} as power_consumption from {TELE}
""", ids=("F7",))
def power_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    return t.select("event_id", power_consumption("voltage", "current_a", "power_factor")
                    .alias("power_consumption"))


# ---------------------------------------------------------------- P7
def validate_frame(df: DataFrame, required: list[str]) -> DataFrame:
    """P7 as a report row: row count, required columns missing from the
    schema (checked on the driver), null count per present required column
    (one aggregate), and ``valid``."""
    present = [c for c in required if c in df.columns]
    missing = [c for c in required if c not in df.columns]
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in present])
    nulls = F.map_from_arrays(F.array(*[F.lit(c) for c in present]),
                              F.array(*[F.col(f"_null_{c}") for c in present])) if present \
        else F.create_map().cast("map<string,bigint>")
    out = agg.select("n_rows", F.array(*[F.lit(c) for c in missing]).cast("array<string>").alias("missing_columns"),
                     nulls.alias("null_counts"))
    return out.withColumn("valid", (F.col("n_rows") > 0) & (F.size("missing_columns") == 0)
                          & F.forall(F.map_values("null_counts"), lambda v: v == 0))


@register("frame_validation", f"""
select count(*) as n_rows, '' as missing_columns,
  {" || ',' || ".join(f"'{c}=' || cast(count(*) filter (where {c} is null) as varchar)" for c in ["device_id", "ts", "temperature", "pressure"])} as null_counts,
  count(*) > 0 and {" and ".join(f"count(*) filter (where {c} is null) = 0" for c in ["device_id", "ts", "temperature", "pressure"])} as valid
from {TELE}
""", ids=("P7",))
def frame_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = validate_frame(telemetry(spark, sf_dir), ["device_id", "ts", "temperature", "pressure"])
    return v.select("n_rows", F.array_join("missing_columns", ",").alias("missing_columns"),
                    F.array_join(F.transform(F.map_entries("null_counts"),
                                             lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))),
                                 ",").alias("null_counts"), "valid")


# ---------------------------------------------------------------- 2.13 fleet views
@register("device_list", f"""
select device_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) as operating_hours,
  round(arg_max(health_score, (ts, event_id)), 6) as health_score,
  arg_max(status, (ts, event_id)) as status, max(ts) as last_seen
from {SCORED} group by device_id
""", ids=("2.13", "W11", "S9"))
def device_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_telemetry(spark, sf_dir)
    key = F.struct("ts", "event_id")
    return s.groupBy("device_id").agg(
        rnd(_hours_span(), 6).alias("operating_hours"),
        rnd(F.max_by("health_score", key), 6).alias("health_score"),
        F.max_by("status", key).alias("status"), F.max("ts").alias("last_seen"))


RANGE_FROM, RANGE_TO = "2024-01-10 00:00:00", "2024-01-12 00:00:00"


@register("device_range", f"""
select event_id, device_id, ts, round(health_score, 6) as health_score, status from {SCORED}
where ts >= timestamp '{RANGE_FROM}' and ts < timestamp '{RANGE_TO}'
""", ids=("2.13",))
def device_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historical range for all devices: the time filter reaches the parquet scan."""
    s = scored_telemetry(spark, sf_dir).where(
        (F.col("ts") >= F.lit(RANGE_FROM).cast("timestamp_ntz")) & (F.col("ts") < F.lit(RANGE_TO).cast("timestamp_ntz")))
    return s.select("event_id", "device_id", "ts", rnd("health_score", 6).alias("health_score"), "status")
