"""Series queries: tag pivot/resample/fill, rolling features, steps, fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearsight.functions.numeric import rnd

from gearsight.operators.rolling import abs_step, ffill_then_zero, rolling_features
from gearsight.operators.series import interval_micros, regular_series
from gearsight.plans.registry import register
from gearsight.sources.tables import TAG_LONG_SQL, TELEMETRY_SQL, table, tag_long, telemetry

TELE = f"({TELEMETRY_SQL}) t"


def tag_series(spark: SparkSession, sf_dir: str, interval: str) -> DataFrame:
    long = tag_long(spark, sf_dir).where(F.col("status") == 0)  # P5
    names = EVENT_TYPES         # declared: no pass over the data to find them
    s = regular_series(long, ["device_id"], "ts", "tag", "tag_value", names, interval)
    return s.select("device_id", "ts", *[rnd(F.col(f"`{n}`"), 6).alias(n) for n in names])


def _tag_series_sql(interval: str, names: list[str], decimals: int | None = 6, tag_sql: str = "tag") -> str:
    iv = interval_micros(interval)
    piv = ", ".join(f"avg(v) filter (where tag = '{n}') as {n}" for n in names)
    fills = []
    for n in names:
        prev_p = (f"last_value(case when {n} is not null then p end ignore nulls) over "
                  f"(partition by device_id order by ts rows between unbounded preceding and current row)")
        prev_v = (f"last_value({n} ignore nulls) over "
                  f"(partition by device_id order by ts rows between unbounded preceding and current row)")
        next_p = (f"first_value(case when {n} is not null then p end ignore nulls) over "
                  f"(partition by device_id order by ts rows between current row and unbounded following)")
        next_v = (f"first_value({n} ignore nulls) over "
                  f"(partition by device_id order by ts rows between current row and unbounded following)")
        fills.append(f"{prev_p} as {n}_pp, {prev_v} as {n}_pv, {next_p} as {n}_np, {next_v} as {n}_nv")
    def fin(n: str) -> str:
        v = (f"case when {n} is not null then {n} "
             f"when {n}_pv is not null and {n}_nv is not null then {n}_pv + ({n}_nv - {n}_pv) * (p - {n}_pp) / ({n}_np - {n}_pp) "
             f"else coalesce({n}_pv, {n}_nv) end")
        return (f"round({v}, {decimals})" if decimals is not None else v) + f" as {n}"
    final = ", ".join(fin(n) for n in names)
    return f"""
with l as (select * exclude (tag), {tag_sql} as tag from ({TAG_LONG_SQL}) x where status = 0),
pv as (select device_id, ts, tag, avg(tag_value) as v from l where tag is not null group by device_id, ts, tag),
wide as (select device_id, ts, {piv} from pv group by device_id, ts),
bn as (select device_id, make_timestamp(cast(floor(epoch_us(ts) / {iv}) as bigint) * {iv}) as bin,
              {", ".join(f"avg({n}) as {n}" for n in names)} from wide group by 1, 2),
bounds as (select device_id, min(bin) as lo, max(bin) as hi from bn group by device_id),
spine as (select device_id, unnest(generate_series(lo, hi, to_microseconds({iv}))) as bin from bounds),
s as (select sp.device_id, sp.bin as ts, {", ".join(f"bn.{n}" for n in names)},
             cast(row_number() over (partition by sp.device_id order by sp.bin) as double) as p
      from spine sp left join bn on bn.device_id = sp.device_id and bn.bin = sp.bin),
f as (select *, {", ".join(fills)} from s)
select device_id, ts, {final} from f
"""


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@register("tag_series_daily", _tag_series_sql("1d", EVENT_TYPES), ids=("P5", "A1", "A2", "W6"))
def tag_series_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_series(spark, sf_dir, "1d")


@register("tag_series_6h", _tag_series_sql("6h", EVENT_TYPES), ids=("P5", "A1", "A2", "W6"))
def tag_series_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_series(spark, sf_dir, "6h")


@register("tag_pivot", f"""
select device_id, ts, {", ".join(f"round(avg(tag_value) filter (where tag = '{n}'), 6) as {n}" for n in EVENT_TYPES)}
from ({TAG_LONG_SQL}) x where status = 0 group by device_id, ts
""", ids=("A1", "P5"))
def tag_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = tag_long(spark, sf_dir).where(F.col("status") == 0)
    names = EVENT_TYPES
    s = regular_series(long, ["device_id"], "ts", "tag", "tag_value", names, None, fill=False)
    return s.select("device_id", "ts", *[rnd(F.col(f"`{n}`"), 6).alias(n) for n in names])


# ---------------------------------------------------------------- W1 + W2
ROLL_COLS = ["temperature", "pressure"]
ROLL_WINDOWS = [5, 15, 30]


def _rolling_sql(src: str, key: str, order: str, cols: list[str], windows: list[int],
                 stats=("mean", "std", "min", "max"), diff=True, pct=True, id_cols=("event_id",)) -> str:
    w = f"partition by {key} order by {order}"
    sel = []
    for c in cols:
        for n in windows:
            fr = f"over ({w} rows between {n - 1} preceding and current row)"
            if "mean" in stats:
                sel.append(f"round(avg({c}) {fr}, 6) as {c}_ma_{n}")
            if "std" in stats:
                sel.append(f"round(coalesce(stddev_samp({c}) {fr}, 0e0), 6) as {c}_std_{n}")
            if "min" in stats:
                sel.append(f"round(min({c}) {fr}, 6) as {c}_min_{n}")
            if "max" in stats:
                sel.append(f"round(max({c}) {fr}, 6) as {c}_max_{n}")
        if diff:
            sel.append(f"round(coalesce({c} - lag({c}) over ({w}), 0e0), 6) as {c}_diff")
    ff = ", ".join(f"last_value({c} ignore nulls) over ({w} rows between unbounded preceding and current row) as {c}__ff"
                   for c in cols)
    if pct:
        for c in cols:
            prev = f"lag({c}__ff) over ({w})"
            sel.append(f"round(case when {c}__ff is null or {prev} is null then 0e0 "
                       f"when {prev} = 0 then (case when {c}__ff = 0 then 0e0 when {c}__ff > 0 then 'inf'::double else '-inf'::double end) "
                       f"else {c}__ff / {prev} - 1e0 end, 6) as {c}_pct_change")
    ids = ", ".join(id_cols)
    inner = f"(select *, {ff} from {src})" if pct else src
    return f"select {ids}, {', '.join(sel)} from {inner} z"


def _round_all(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[rnd(c, 6).alias(c) for c in df.columns if c not in keep])


@register("rolling_features", _rolling_sql(TELE, "device_id", "ts, event_id", ROLL_COLS, ROLL_WINDOWS),
          ids=("W1", "W2"))
def rolling_features_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir).select("event_id", "device_id", "ts", *ROLL_COLS)
    r = rolling_features(t, ["device_id"], ["ts", "event_id"], ROLL_COLS, ROLL_WINDOWS, write_once=True)
    return _round_all(r.drop("device_id", "ts", *ROLL_COLS), ["event_id"])


LI_COLS = ["l_quantity", "l_extendedprice"]
LI_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber"]


@register("lineitem_rolling",
          _rolling_sql("lineitem", "l_suppkey", ", ".join(LI_ORDER), LI_COLS, [5, 15, 30],
                       stats=("mean", "std"), diff=True, pct=False,
                       id_cols=("l_orderkey", "l_linenumber")),
          ids=("W1", "W2"))
def lineitem_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", *LI_ORDER, *LI_COLS)
    r = rolling_features(li, ["l_suppkey"], LI_ORDER, LI_COLS, [5, 15, 30], stats=("mean", "std"), write_once=True,
                         with_pct=False)
    return _round_all(r.drop("l_suppkey", "l_shipdate", *LI_COLS), ["l_orderkey", "l_linenumber"])


@register("abs_step", f"""
select event_id, round(abs(temperature - lag(temperature) over (partition by device_id order by ts, event_id)), 6)
  as temperature_change from {TELE}
""", ids=("W5",))
def abs_step_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir).select("event_id", "device_id", "ts", "temperature")
    r = abs_step(t, ["device_id"], ["ts", "event_id"], {"temperature": "temperature_change"}, write_once=True)
    return r.select("event_id", rnd("temperature_change", 6).alias("temperature_change"))


@register("ffill_zero", f"""
select event_id, coalesce(last_value(temperature ignore nulls) over (partition by device_id order by ts, event_id
  rows between unbounded preceding and current row), 0e0) as temperature from {TELE}
""", ids=("W7",))
def ffill_zero_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir).select("event_id", "device_id", "ts", "temperature")
    return ffill_then_zero(t, ["device_id"], ["ts", "event_id"], ["temperature"], write_once=True).select(
        "event_id", "temperature")
