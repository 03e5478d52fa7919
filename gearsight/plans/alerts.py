"""Alerts in batch: rule table (L1, L4), rule match (J2), greedy cool-down
(W13), alert rows with id and message (L2, L3), manual alerts (L5), lifecycle
(J3, L8), active set / history / statistics / dashboard views (L6, O2, O3,
A16, A17), device-state banner (L7) and the stream's threshold alerts (ST3).

Alert time is event time (Q15). One pass evaluates every rule on a reading:
the matching rules are exploded from an array of structs, so the rule
count adds no join and no extra scan.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gearsight.config import DEFAULT, PRIORITIES, Thresholds
from gearsight.functions.numeric import rnd, round_half_even_sql
from gearsight.functions.sensors import sensor_fault
from gearsight.operators.cooldown import greedy_cooldown
from gearsight.operators.latest import latest_per_device
from gearsight.plans.fleet import scored_sql, scored_telemetry
from gearsight.plans.registry import register
from gearsight.session import materialize
from gearsight.sources.tables import TELEMETRY_SENSORS


@dataclass(frozen=True)
class Rule:
    name: str
    alert_type: str
    priority: str
    condition: str          # Spark SQL predicate over the reading columns
    message: str            # format_string template; args below
    message_args: tuple[str, ...]  # Spark SQL expressions, one per %-field
    cooldown_minutes: int


def _fmt(col: str, decimals: int) -> str:
    """A number for a ``%.Nf`` field, rounded first like Python's formatting
    (binary value, half-even); Java's formatter would round the decimal text
    half-up. F20."""
    return round_half_even_sql(f"`{col}`", decimals)


def default_rules(t: Thresholds = DEFAULT.thresholds) -> list[Rule]:
    """L1: the four default rules; a missing health is 100, a missing anomaly 0."""
    return [
        Rule("health_low", "health_low", "medium",
             f"coalesce(health_score, 100D) < {t.health_alert}",
             "Device %s health is %.1f%%, below the threshold.", ("device_id", _fmt("health_score", 1)),
             t.cooldown_minutes),
        Rule("health_critical", "health_low", "critical",
             f"coalesce(health_score, 100D) < {t.health_critical_alert}",
             "Device %s health is critical (%.1f%%); inspect it now.", ("device_id", _fmt("health_score", 1)),
             t.critical_cooldown_minutes),
        Rule("anomaly_high", "anomaly_high", "high",
             f"coalesce(anomaly_score, 0D) > {t.anomaly_alert}",
             "Device %s shows an anomaly pattern (anomaly score: %.3f).",
             ("device_id", _fmt("anomaly_score", 3)), t.cooldown_minutes),
        Rule("sensor_fault", "sensor_fault", "high", "sensor_fault",
             "Device %s reports a sensor fault.", ("device_id",), t.cooldown_minutes),
    ]


def add_rule(rules: list[Rule], rule: Rule) -> list[Rule]:
    """L4."""
    return [*rules, rule]


def remove_rule(rules: list[Rule], name: str) -> list[Rule]:
    """L4."""
    return [r for r in rules if r.name != name]


def with_cooldown(rules: list[Rule], minutes: int) -> list[Rule]:
    return [replace(r, cooldown_minutes=minutes) for r in rules]


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rule list as a (tiny, fixed-size) DataFrame, for statistics."""
    return spark.createDataFrame(
        [(i, r.name, r.alert_type, r.priority, r.condition, r.cooldown_minutes)
         for i, r in enumerate(rules)],
        "rule_order int, rule string, alert_type string, priority string, condition string, "
        "cooldown_minutes int")


def rule_matches(readings: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per (reading, matching rule), with the rule's attributes."""
    entries = []
    for i, r in enumerate(rules):
        msg = F.format_string(r.message, *[F.expr(a) for a in r.message_args])
        entries.append(F.when(F.expr(r.condition), F.struct(
            F.lit(i).alias("rule_order"), F.lit(r.name).alias("rule"),
            F.lit(r.alert_type).alias("alert_type"), F.lit(r.priority).alias("priority"),
            F.lit(r.cooldown_minutes * 60_000_000).cast("long").alias("cooldown_us"),
            msg.alias("message"))))
    m = readings.withColumn("_m", F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())))
    return m.select("*", "_m.*").drop("_m")


def undated_matches(readings: DataFrame, rules: list[Rule]) -> DataFrame:
    """Matches that raise no alert because their reading has no event time: a
    cool-down cannot place them. One row per (reading, rule), as a report."""
    return rule_matches(readings.where(F.col("ts").isNull()), rules).select(
        "device_id", "rule", "alert_type", "priority", "message")


def alert_id(device: Column, alert_type: Column, ts: Column) -> Column:
    """L3: device_type_epochSeconds."""
    secs = F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000).cast("long")
    return F.concat_ws("_", device, alert_type, secs.cast("string"))


def evaluate_rules(readings: DataFrame, rules: list[Rule], tiebreak: str = "event_id") -> DataFrame:
    """L2: matched, cooled-down alert rows (the alert history). Readings without
    an event time raise none; :func:`undated_matches` lists them."""
    m = rule_matches(readings, rules)
    fired = greedy_cooldown(m, ["rule", "device_id"], "ts", tiebreak, F.col("cooldown_us"))
    # the reading that raised the alert, as text
    metadata = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in readings.columns]),
                                              F.array(*[F.col(c).cast("string") for c in readings.columns])),
                            lambda _, v: v.isNotNull()).alias("metadata")
    return fired.select(
        alert_id(F.col("device_id"), F.col("alert_type"), F.col("ts")).alias("alert_id"),
        "rule", "rule_order", "device_id", "alert_type", "priority", "message",
        F.col("ts").alias("ts"), F.col(tiebreak).alias(tiebreak),
        "health_score", "anomaly_score", F.lit("active").alias("status"), metadata)


def manual_alerts(requests: DataFrame) -> DataFrame:
    """``requests(device_id, message, ts, priority)`` as rows of the alert
    history (union them by name); other priorities than the known are left out."""
    secs = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    return requests.where(F.col("priority").isin(*PRIORITIES)).select(
        F.concat_ws("_", F.lit("manual"), "device_id", secs.cast("string")).alias("alert_id"),
        F.lit("manual").alias("rule"), F.lit(-1).alias("rule_order"), "device_id",
        F.lit("system_error").alias("alert_type"), "priority", "message", "ts",
        F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("double").alias("health_score"),
        F.lit(None).cast("double").alias("anomaly_score"), F.lit("active").alias("status"),
        F.create_map(F.lit("manual"), F.lit("true")).alias("metadata"))


def manual_alert(spark: SparkSession, device_id: str, message: str, at, priority: str = "medium"
                 ) -> DataFrame:
    """One manual alert; an unknown priority is an error."""
    if priority not in PRIORITIES:
        raise ValueError(f"unknown priority {priority}")
    return manual_alerts(spark.createDataFrame([(device_id, message, at, priority)],
                                               "device_id string, message string, ts timestamp_ntz, priority string"))


def apply_actions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Acknowledge and resolve by alert id.

    ``actions`` = (alert_id, action in {acknowledge, resolve}, user, at). An id
    names its active alert: the last in time, then rule order; earlier alerts of
    the same id keep their state. The first resolve ends the alert; actions
    before the alert or after its resolve, and actions for unknown ids, are
    refused. Of several acknowledgements the last one stays.
    """
    w = Window.partitionBy("alert_id")
    a = alerts.withColumn("_last", F.struct("ts", "rule_order") == F.max(F.struct("ts", "rule_order")).over(w))
    raised = a.where("_last").select("alert_id", F.col("ts").alias("_raised"))
    valid = actions.join(raised, "alert_id").where(F.col("at") >= F.col("_raised"))
    ends = valid.where("action = 'resolve'").groupBy("alert_id").agg(F.min("at").alias("_end"))
    acks = (valid.where("action = 'acknowledge'").join(ends, "alert_id", "left")
            .where(F.col("_end").isNull() | (F.col("at") <= F.col("_end")))
            .groupBy("alert_id").agg(F.max(F.struct("at", "user")).alias("_ack")))
    j = a.join(acks, "alert_id", "left").join(ends, "alert_id", "left")
    mine = F.col("_last")
    return (j.withColumn("acknowledged_by", F.when(mine, F.col("_ack.user")))
             .withColumn("acknowledged_at", F.when(mine, F.col("_ack.at")))
             .withColumn("resolved_at", F.when(mine, F.col("_end")))
             .withColumn("status", F.when(F.col("resolved_at").isNotNull(), F.lit("resolved"))
                         .when(F.col("acknowledged_at").isNotNull(), F.lit("acknowledged"))
                         .otherwise(F.col("status")))
             .drop("_ack", "_end", "_last"))


def severity(priority: Column) -> Column:
    """0 = critical ... 3 = low."""
    return (F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), priority) - 1).cast("int")


def active_order(order: str = "severity") -> list[Column]:
    """O2 sort key: severity first, newest first (``order="reference"``
    reverses the whole key as the reference does, Q6)."""
    if order == "reference":
        return [F.col("severity").desc(), F.col("ts").desc(), F.col("alert_id").desc()]
    return [F.col("severity").asc(), F.col("ts").desc(), F.col("alert_id").asc()]


def active_alerts(history: DataFrame) -> DataFrame:
    """One alert per id (the last in time, then rule order), not resolved.

    Sort with ``orderBy(*active_order())`` at the sink; ``limit`` makes it a
    distributed top-k.
    """
    w = Window.partitionBy("alert_id")
    last = history.withColumn("_k", F.max(F.struct("ts", "rule_order")).over(w)) \
                  .where(F.struct("ts", "rule_order") == F.col("_k")).drop("_k")
    return last.where(F.col("status") != "resolved").withColumn("severity", severity(F.col("priority")))


def alert_history(history: DataFrame, limit: int = 100) -> DataFrame:
    """O3: the newest ``limit`` alerts (top-k), returned oldest first."""
    newest = history.orderBy(F.col("ts").desc(), F.col("alert_id").desc(), F.col("rule_order").desc()) \
                    .limit(limit)
    return newest.orderBy("ts", "alert_id", "rule_order")


def alert_statistics(history: DataFrame, active: DataFrame, n_rules: int, as_of=None) -> DataFrame:
    """A16 as (metric, key, n); "recent_24h" counts alerts newer than
    ``as_of`` - 24 h. ``as_of`` defaults to the newest alert time (one
    scalar aggregate), never the wall clock."""
    if as_of is None:
        as_of = history.agg(F.max("ts")).first()[0]
    recent = history.agg(F.count_if(F.col("ts") > F.lit(as_of) - F.expr("INTERVAL 24 HOURS")).alias("n")) \
        if as_of is not None else history.agg(F.lit(0).alias("n"))
    parts = [
        history.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("metric"), F.lit("all").alias("key"), "n"),
        active.agg(F.count(F.lit(1)).alias("n")).select(F.lit("active").alias("metric"), F.lit("all").alias("key"), "n"),
        recent.select(F.lit("recent_24h").alias("metric"), F.lit("all").alias("key"), "n"),
        history.groupBy(F.col("alert_type").alias("key")).agg(F.count(F.lit(1)).alias("n"))
               .select(F.lit("by_type").alias("metric"), "key", "n"),
        history.groupBy(F.col("priority").alias("key")).agg(F.count(F.lit(1)).alias("n"))
               .select(F.lit("by_priority").alias("metric"), "key", "n"),
        history.sparkSession.range(1).select(F.lit("rules").alias("metric"), F.lit("all").alias("key"),
                                             F.lit(n_rules).cast("long").alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("metric", "key", F.col("n").cast("bigint").alias("n"))


def alert_dashboard(active: DataFrame, top: int = 10) -> DataFrame:
    """Per priority (all four, zero-filled) the active count, plus the
    top alerts by the active order as (section, key, n, alert_id)."""
    spark = active.sparkSession
    pr = spark.createDataFrame([(p,) for p in PRIORITIES], "priority string")
    counts = active.groupBy("priority").agg(F.count(F.lit(1)).alias("n"))
    by_pr = pr.join(counts, "priority", "left").select(
        F.lit("by_priority").alias("section"), F.col("priority").alias("key"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.lit(None).cast("string").alias("alert_id"))
    total = active.agg(F.count(F.lit(1)).cast("bigint").alias("n")).select(
        F.lit("active").alias("section"), F.lit("all").alias("key"), "n",
        F.lit(None).cast("string").alias("alert_id"))
    # distributed top-k, then a rank over the k rows only
    top_rows = active.orderBy(*active_order()).limit(top) \
        .withColumn("_rk", F.row_number().over(Window.orderBy(*active_order())))
    tops = top_rows.select(
        F.lit("top").alias("section"), F.col("_rk").cast("string").alias("key"),
        F.col("_rk").cast("bigint").alias("n"), "alert_id")
    return by_pr.unionByName(total).unionByName(tops)


def device_banner(latest: DataFrame) -> DataFrame:
    """One line per device whose latest status is critical or warning."""
    bad = latest.where(F.col("status").isin("critical", "warning"))
    return bad.select("device_id", "status", F.format_string(
        "Device %s is %s (health %.1f%%)", F.col("device_id"), F.col("status"),
        F.expr(_fmt("health_score", 1))).alias("message"))


def threshold_alerts(readings: DataFrame, t: Thresholds = DEFAULT.thresholds) -> DataFrame:
    """ST3: stateless stream rule. anomaly > 0.7 -> anomaly_threshold (high if
    > 0.9 else medium); otherwise health < 30 -> health_critical (critical).
    No cool-down; the anomaly branch hides the health branch (Q19)."""
    a = F.coalesce(F.col("anomaly_score"), F.lit(0.0))
    h = F.coalesce(F.col("health_score"), F.lit(100.0))
    typ = (F.when(a > t.stream_anomaly, F.lit("anomaly_threshold"))
           .when(h < t.stream_health_critical, F.lit("health_critical")))
    pri = (F.when(a > t.stream_anomaly, F.when(a > t.stream_anomaly_high, F.lit("high")).otherwise(F.lit("medium")))
           .when(h < t.stream_health_critical, F.lit("critical")))
    msg = (F.when(a > t.stream_anomaly, F.format_string(
               "Device %s has an anomaly score above the threshold (" + str(t.stream_anomaly) + ").", F.col("device_id")))
           .when(h < t.stream_health_critical, F.format_string(
               "Device %s is at a critical health level (%.1f%%).", F.col("device_id"), F.expr(_fmt("health_score", 1)))))
    return readings.withColumn("alert_type", typ).withColumn("priority", pri).withColumn("message", msg) \
                   .where(F.col("alert_type").isNotNull())


def of_devices(alerts: DataFrame, devices: list[str]) -> DataFrame:
    """History or active alerts of some devices."""
    return alerts.where(F.col("device_id").isin(*devices))


# ---------------------------------------------------------------- readings

def alert_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_telemetry(spark, sf_dir)
    return s.withColumn("sensor_fault", sensor_fault(TELEMETRY_SENSORS))


def history_of(spark: SparkSession, sf_dir: str, rules: list[Rule] | None = None) -> DataFrame:
    return evaluate_rules(alert_readings(spark, sf_dir), rules or default_rules())


def stored_history(spark: SparkSession, sf_dir: str, rules: list[Rule] | None = None) -> DataFrame:
    """The alert history written once (the alert table the views read);
    without it every branch of a view would re-run the cool-down."""
    return materialize(history_of(spark, sf_dir, rules))


# ---------------------------------------------------------------- oracle SQL

def _matches_sql(rules: list[Rule]) -> str:
    fault = ("(temperature < 0 or temperature > 150 or vibration_x < 0 or vibration_x > 10 "
             "or pressure < 0 or pressure > 10 or current_a < 0 or current_a > 50)")
    conds = {"health_low": "coalesce(health_score, 100) < 70",
             "health_critical": "coalesce(health_score, 100) < 30",
             "anomaly_high": "coalesce(anomaly_score, 0) > 0.7",
             "sensor_fault": f"coalesce({fault}, false)",
             "pressure_high": "coalesce(pressure, 0) > 4.0"}
    def msg(r: Rule) -> str:
        args = ", ".join(a.replace("`", "") for a in r.message_args)
        return f"printf('{r.message}', {args})"
    parts = [f"select {i} as rule_order, '{r.name}' as rule, '{r.alert_type}' as alert_type, "
             f"'{r.priority}' as priority, {r.cooldown_minutes * 60_000_000} as cd_us, "
             f"device_id, ts, event_id, health_score, anomaly_score, {msg(r)} as message "
             f"from sc where {conds[r.name]}"
             for i, r in enumerate(rules)]
    return " union all ".join(parts)


def fired_sql(rules: list[Rule]) -> str:
    """W13 oracle: recursive CTE over each key's matches."""
    return f"""
with recursive sc as ({scored_sql()}),
m as ({_matches_sql(rules)}),
mm as (select *, row_number() over (partition by rule, device_id order by ts, event_id) as rn from m),
nx as (select a.rule, a.device_id, a.rn, min(b.rn) as nxt from mm a left join mm b
         on b.rule = a.rule and b.device_id = a.device_id and b.rn > a.rn
        and epoch_us(b.ts) >= epoch_us(a.ts) + a.cd_us
       group by a.rule, a.device_id, a.rn),
fired(rule, device_id, rn) as (
  select rule, device_id, rn from mm where rn = 1
  union all
  select f.rule, f.device_id, nx.nxt from fired f
  join nx on nx.rule = f.rule and nx.device_id = f.device_id and nx.rn = f.rn where nx.nxt is not null),
hist as (select concat_ws('_', mm.device_id, mm.alert_type, cast(floor(epoch_us(mm.ts) / 1000000) as bigint)) as alert_id,
                mm.* from fired join mm using (rule, device_id, rn))
"""


def _hist_cols_sql() -> str:
    return ("alert_id, rule, device_id, alert_type, priority, ts, event_id, message, "
            "round(health_score, 6) as health_score, round(anomaly_score, 6) as anomaly_score")


def _hist_cols(h: DataFrame) -> DataFrame:
    return h.select("alert_id", "rule", "device_id", "alert_type", "priority", "ts", "event_id", "message",
                    rnd("health_score", 6).alias("health_score"),
                    rnd("anomaly_score", 6).alias("anomaly_score"))


DAILY = with_cooldown(default_rules(), 24 * 60)


@register("alerts_fired", fired_sql(default_rules()) + f"select {_hist_cols_sql()} from hist",
          ids=("L1", "L2", "L3", "J2", "W13", "F18", "F20"))
def alerts_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hist_cols(history_of(spark, sf_dir))


@register("alerts_fired_daily_cooldown", fired_sql(DAILY) + f"select {_hist_cols_sql()} from hist",
          ids=("W13", "L2"))
def alerts_fired_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hist_cols(history_of(spark, sf_dir, DAILY))


_SEV_SQL = "case priority when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end"

ACTIVE_SQL = fired_sql(DAILY) + f""",
last as (select * from (select *, row_number() over (partition by alert_id order by ts desc, rule_order desc) as q
                        from hist) where q = 1),
act as (select *, {_SEV_SQL} as severity from last)
"""


@register("active_alerts", ACTIVE_SQL + """
select alert_id, device_id, alert_type, priority, ts, cast(severity as integer) as severity from act
""", ids=("L6", "Q7"))
def active_alerts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = active_alerts(stored_history(spark, sf_dir, DAILY))
    return a.select("alert_id", "device_id", "alert_type", "priority", "ts", "severity")


@register("alert_history", fired_sql(DAILY) + """
select alert_id, rule, device_id, ts from
  (select * from hist order by ts desc, alert_id desc, rule_order desc limit 100) x
""", ids=("O3", "O4"))
def alert_history_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_history(stored_history(spark, sf_dir, DAILY)).select("alert_id", "rule", "device_id", "ts")


@register("alert_statistics", ACTIVE_SQL + """
select 'total' as metric, 'all' as key, count(*) as n from hist
union all select 'active', 'all', count(*) from act
union all select 'recent_24h', 'all', count(*) from hist where ts > (select max(ts) from hist) - interval 24 hours
union all select 'by_type', alert_type, count(*) from hist group by alert_type
union all select 'by_priority', priority, count(*) from hist group by priority
union all select 'rules', 'all', 4
""", ids=("A16",))
def alert_statistics_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = stored_history(spark, sf_dir, DAILY)
    return alert_statistics(h, active_alerts(h), len(DAILY))


@register("alert_dashboard", ACTIVE_SQL + f"""
, ranked as (select *, row_number() over (order by severity asc, ts desc, alert_id asc) as rk from act),
pr as (select * from (values ('critical'), ('high'), ('medium'), ('low')) v(priority))
select 'by_priority' as section, pr.priority as key, cast(count(a.alert_id) as bigint) as n, cast(null as varchar) as alert_id
  from pr left join act a on a.priority = pr.priority group by pr.priority
union all select 'active', 'all', count(*), null from act
union all select 'top', cast(rk as varchar), rk, alert_id from ranked where rk <= 10
""", ids=("A17", "O2", "O4"))
def alert_dashboard_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = stored_history(spark, sf_dir, DAILY)
    return alert_dashboard(materialize(active_alerts(h)))


def _fmt_sql(expr: str, decimals: int) -> str:
    """A double as text with ``decimals`` places, rounded from its exact binary
    value, half to even (both engines get the same digits from the decimal)."""
    return f"printf('%.{decimals}f', {expr})"


THRESHOLD_SQL = f"""
select event_id, device_id, ts,
  case when coalesce(anomaly_score, 0) > 0.7 then 'anomaly_threshold' else 'health_critical' end as alert_type,
  case when coalesce(anomaly_score, 0) > 0.7 then (case when anomaly_score > 0.9 then 'high' else 'medium' end)
       else 'critical' end as priority,
  case when coalesce(anomaly_score, 0) > 0.7
       then 'Device ' || device_id || ' has an anomaly score above the threshold (0.7).'
       else 'Device ' || device_id || ' is at a critical health level (' || {_fmt_sql("health_score", 1)} || '%).' end as message,
  round(health_score, 6) as health_score, round(anomaly_score, 6) as anomaly_score
from ({scored_sql()}) s
where coalesce(anomaly_score, 0) > 0.7 or coalesce(health_score, 100) < 30
"""


@register("threshold_alerts", THRESHOLD_SQL, ids=("ST3",))
def threshold_alerts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_alerts(scored_telemetry(spark, sf_dir)).select(
        "event_id", "device_id", "ts", "alert_type", "priority", "message",
        rnd("health_score", 6).alias("health_score"), rnd("anomaly_score", 6).alias("anomaly_score"))


# One rule added, one removed (L4): the last rule gives way to a pressure rule.
EDITED = add_rule(remove_rule(DAILY, "sensor_fault"), Rule(
    "pressure_high", "anomaly_detected", "low", "coalesce(pressure, 0) > 4.0",
    "Device %s reports high pressure.", ("device_id",), 24 * 60))


def _action_rows(history: DataFrame) -> DataFrame:
    """Actions derived from fired alerts by their reading's number: who does what
    when, including late, early, repeated and unknown ones."""
    def act(kind: str, user: str, hours: int, when: str):
        return history.where(when).select("alert_id", F.lit(kind).alias("action"), F.lit(user).alias("user"),
                                          (F.col("ts") + F.expr(f"interval {hours} hours")).alias("at"))
    parts = [act("acknowledge", "early", -1, "event_id % 2 = 0"), act("acknowledge", "ann", 1, "event_id % 2 = 0"),
             act("acknowledge", "bob", 2, "event_id % 4 = 0"), act("resolve", "cem", 3, "event_id % 3 = 0"),
             act("resolve", "dan", 5, "event_id % 3 = 0"), act("acknowledge", "late", 6, "event_id % 3 = 0"),
             act("acknowledge", "eve", 1, "event_id % 5 = 0").withColumn("alert_id", F.lit("unknown"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("alert_lifecycle", fired_sql(EDITED) + """,
manual as (
  select 'manual_' || device_id || '_' || cast(cast(floor(epoch_us(ts) / 1000000) as bigint) as varchar) as alert_id,
         'manual' as rule, -1 as rule_order, device_id, 'system_error' as alert_type, ts,
         null::bigint as event_id, 'check ' || device_id as message
  from sc where event_id % 50 = 0),
alerts as (
  select alert_id, rule, rule_order, device_id, alert_type, ts, event_id, message from hist
  union all select * from manual),
last as (select alert_id, max(ts) as raised from alerts group by 1),
flagged as (select a.*, (a.ts, a.rule_order) = (select (b.ts, b.rule_order) from alerts b where b.alert_id = a.alert_id
                                              order by b.ts desc, b.rule_order desc limit 1) as mine from alerts a),
acts as (
  select alert_id, 'acknowledge' as action, 'early' as who, ts - interval 1 hour as done from hist where event_id % 2 = 0
  union all select alert_id, 'acknowledge', 'ann', ts + interval 1 hour from hist where event_id % 2 = 0
  union all select alert_id, 'acknowledge', 'bob', ts + interval 2 hours from hist where event_id % 4 = 0
  union all select alert_id, 'resolve', 'cem', ts + interval 3 hours from hist where event_id % 3 = 0
  union all select alert_id, 'resolve', 'dan', ts + interval 5 hours from hist where event_id % 3 = 0
  union all select alert_id, 'acknowledge', 'late', ts + interval 6 hours from hist where event_id % 3 = 0),
valid as (select v.* from acts v join last using (alert_id) where done >= raised),
ends as (select alert_id, min(done) as ended from valid where action = 'resolve' group by 1),
acks as (select alert_id, arg_max(who, (done, who)) as who, max(done) as done from valid left join ends using (alert_id)
         where action = 'acknowledge' and (ended is null or done <= ended) group by 1)
select f.alert_id, f.rule, f.device_id, f.alert_type, f.ts, f.event_id, f.message,
       case when mine then acks.who end as acknowledged_by, case when mine then acks.done end as acknowledged_at,
       case when mine then ends.ended end as resolved_at,
       case when mine and ends.ended is not null then 'resolved' when mine and acks.done is not null then 'acknowledged'
            else 'active' end as status
from flagged f left join acks on acks.alert_id = f.alert_id left join ends on ends.alert_id = f.alert_id
""", ids=("J3", "L4", "L5", "L8"))
def alert_lifecycle_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = stored_history(spark, sf_dir, EDITED)
    asked = scored_telemetry(spark, sf_dir).where("event_id % 50 = 0").select(
        "device_id", F.concat(F.lit("check "), "device_id").alias("message"), "ts", F.lit("medium").alias("priority"))
    alerts = h.unionByName(manual_alerts(asked))
    return apply_actions(alerts, _action_rows(h)).select(
        "alert_id", "rule", "device_id", "alert_type", "ts", "event_id", "message", "acknowledged_by",
        "acknowledged_at", "resolved_at", "status")


@register("device_alerts", ACTIVE_SQL + """
select alert_id, device_id, ts from act where device_id in ('DEVICE_00001', 'DEVICE_00007')
""", ids=("L6", "P9"))
def device_alerts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    act = active_alerts(stored_history(spark, sf_dir, DAILY))
    return of_devices(act, ["DEVICE_00001", "DEVICE_00007"]).select("alert_id", "device_id", "ts")


@register("device_banner", f"""
select device_id, status, 'Device ' || device_id || ' is ' || status || ' (health ' || printf('%.1f', health_score) || '%)' as message
from (select *, row_number() over (partition by device_id order by ts desc, event_id desc) as rn
  from ({scored_sql()}) s) x where rn = 1 and status in ('critical', 'warning')
""", ids=("L7",))
def device_banner_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = latest_per_device(scored_telemetry(spark, sf_dir), "device_id", ["ts", "event_id"])
    return device_banner(latest).select("device_id", "status", "message")
