"""Sequences, scaling, split, classifier, prediction and evaluation
(M2-M8, W8, W9, A22, S13).

The reference trains a recurrent network on (L x F) windows. Here the same
samples feed a ``pyspark.ml`` LogisticRegression on the flattened window
(re-aimed, M6): the data work — features, scaling, windows, split,
prediction for every device at once, evaluation — is the same, and every
step is a distributed DataFrame/ML job.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gearsight.config import DEFAULT, ModelSettings
from gearsight.functions.calendar import add_time_features
from gearsight.functions.numeric import rnd
from gearsight.functions import rowwise
from gearsight.functions.sensors import (failure_risk, finite_or_zero, label_generic,
                                         prediction_risk, risk_advice)
from gearsight.operators.ordered import ordered_window, with_positions
from gearsight.operators.sequences import latest_sequence, sequence_samples
from gearsight.plans.fleet import scored_sql, scored_telemetry
from gearsight.plans.registry import register
from gearsight.session import materialize
from gearsight.sources.tables import TELEMETRY_SENSORS

# ---------------------------------------------------------------- M2 / M8


def prepare_features(readings: DataFrame, ts: str = "ts", key: list[str] | None = None,
                     order: list[str] | None = None) -> DataFrame:
    """M2 for sensor readings: calendar parts, basic rolling when missing (W3,
    needs ``key``/``order``), composites where their columns are there (F10 over
    named cartesian axes, F11 sums over joints), generic label (F15), risk bin (F16)."""
    if key and order:
        from gearsight.plans.robot import numeric_columns
        readings = ensure_basic_rolling(readings, key, order, numeric_columns(readings))
    readings = add_composites(readings)
    cols = set(readings.columns)
    a = F.col("anomaly_score") if "anomaly_score" in cols else None
    h = F.col("health_score") if "health_score" in cols else None
    out = add_time_features(readings, ts, with_minute=False)
    return out.withColumns({"maintenance_needed": label_generic(a, h), "failure_risk": failure_risk(a)})


def add_composites(df: DataFrame) -> DataFrame:
    """M2: distance from the origin, summed position errors and torques, each only
    if its input columns exist."""
    new = {}
    xyz = [f"cartesian_{a}" for a in ("x", "y", "z")]
    if set(xyz) <= set(df.columns):
        new["cartesian_distance"] = rowwise.vector_norm_null_zero(xyz)
    for part, name in (("pos_error", "total_pos_error"), ("torque_cmd", "total_torque_cmd")):
        if cols := [c for c in df.columns if part in c and c.startswith("joint") and c.rstrip("0123456789").endswith(part)]:
            new[name] = rowwise.row_abs_sum(cols)
    return df.withColumns(new)


def ensure_basic_rolling(df: DataFrame, key: list[str], order: list[str], features: list[str]) -> DataFrame:
    """When fewer than 5 rolling columns exist, add per-device mean 5/15,
    std 5 and trend (diff, 0 first) for the first 10 joint columns."""
    have = [c for c in df.columns if "_ma_" in c or "_std_" in c]
    joints = [c for c in features if any(j in c for j in ("joint1", "joint2", "joint3", "joint6"))][:10]
    if len(have) >= 5 or not joints:
        return df

    def build(w):
        out = {}
        for c in joints:
            out[f"{c}_ma_5"] = F.avg(c).over(w.rowsBetween(-4, 0))
            out[f"{c}_ma_15"] = F.avg(c).over(w.rowsBetween(-14, 0))
            out[f"{c}_std_5"] = F.coalesce(F.stddev_samp(c).over(w.rowsBetween(-4, 0)), F.lit(0.0))
            out[f"{c}_trend"] = F.coalesce(F.col(c) - F.lag(c, 1).over(w), F.lit(0.0))
        return out
    return ordered_window(df, key, order, build, lookback=14).drop("_pos")


def variance_ranked(df: DataFrame, cols: list[str], k: int) -> list[str]:
    """A21 applied: keep the k columns of largest sample variance (ties by
    name); one aggregate, 2 numbers per column to the driver."""
    if len(cols) <= k:
        return cols
    v = df.agg(*[F.var_samp(c).alias(c) for c in cols]).first().asDict()
    return sorted(cols, key=lambda c: (-(v[c] if v[c] is not None else float("-inf")), c))[:k]


# ---------------------------------------------------------------- M3

def fit_scaler(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """M3: mean and population std per feature (zero std -> 1), one aggregate.
    NaN/infinity count as 0 first (P12)."""
    clean = df.select(*[finite_or_zero(F.col(c)).alias(c) for c in features])
    r = clean.agg(*[x for c in features for x in (F.avg(c).alias(f"m_{c}"),
                                                  F.stddev_pop(c).alias(f"s_{c}"))]).first()
    out = {}
    for c in features:
        s = r[f"s_{c}"]
        out[c] = (r[f"m_{c}"] or 0.0, s if s not in (None, 0.0) else 1.0)
    return out


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (finite_or_zero(F.col(c)) - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()})


# ---------------------------------------------------------------- M5

def stratified_split(df: DataFrame, label: str, key: list[str], share: float) -> DataFrame:
    """M5: exact, repeatable stratified hold-out. Within each class, samples are
    ranked by the md5 of their key and the first round(share * n_class) are held
    out (``_test``). A class is a hot key, so :func:`with_positions` numbers it
    by slices of the digest (counts per slice -> running offsets -> row_number
    inside a slice), never in one task. Null labels are a class of their own."""
    h = df.withColumn("_h", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key])))
    h = h.withColumn("_class", F.struct(label))
    ranked = with_positions(h, ["_class"], ["_h"], F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    sizes = h.groupBy("_class").agg(F.count(F.lit(1)).alias("_n"))
    # one row per class: a fixed-size table
    ranked = ranked.join(F.broadcast(sizes), "_class")
    test = F.col("_pos") < F.round(F.col("_n") * share)
    return ranked.withColumn("_test", test).drop("_h", "_class", "_pos", "_n")


def split_samples(samples: DataFrame, settings: ModelSettings) -> DataFrame:
    """The one split that scaler, training and evaluation share."""
    return stratified_split(samples, "label", SAMPLE_KEY, settings.validation_split)


# ---------------------------------------------------------------- M6 / M7 / A22

def train(samples: DataFrame, settings: ModelSettings = DEFAULT.model, max_iter: int = 50
          ) -> tuple[PipelineModel, DataFrame]:
    """M6 on samples (seq array, label); returns the model and the hold-out
    predictions. ``settings`` choose the classifier: logistic regression or
    gradient-boosted trees. The samples are written once, as every pass of the
    optimiser reads them. A single-class training set raises (Q12)."""
    s = materialize(split_samples(samples, settings)).withColumn("features", array_to_vector("seq")).withColumn(
        "label", F.col("label").cast("double"))
    tr, te = s.where(~F.col("_test")), s.where(F.col("_test"))
    classes = tr.agg(F.countDistinct("label")).first()[0]
    if classes < 2:
        raise ValueError("training labels hold a single class; need both classes to train")
    model = Pipeline(stages=[_classifier(settings, max_iter)]).fit(tr)
    return model, model.transform(te)


def _classifier(settings: ModelSettings, max_iter: int):
    if settings.classifier == "logistic":
        return LogisticRegression(maxIter=max_iter, regParam=0.01)
    if settings.classifier == "tree":
        return GBTClassifier(maxIter=settings.tree_rounds, maxDepth=settings.tree_depth, seed=settings.seed)
    raise ValueError(f"no classifier named {settings.classifier!r}")


def feature_importance(spark: SparkSession, model: PipelineModel, features: list[str]) -> DataFrame:
    """M6: ``(feature, importance)`` of a tree model, most important first; a
    feature's places in the window are summed, all features sum to 1."""
    weights = model.stages[-1].featureImportances.toArray().reshape(-1, len(features)).sum(axis=0)
    return spark.createDataFrame([(f, float(w)) for f, w in zip(features, weights)],
                                 "feature string, importance double").orderBy(F.desc("importance"), "feature")


def evaluation(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A22 of a classifier's predictions."""
    return evaluation_of(pred, vector_to_array("probability")[1], threshold)


def evaluation_of(pred: DataFrame, probability: Column, threshold: float = 0.5) -> DataFrame:
    """Per class precision, recall, f1, support from one confusion
    aggregate (zero on an empty denominator)."""
    cm = pred.select(F.col("label").cast("int").alias("y"), (probability > threshold).cast("int").alias("p"))
    agg = cm.agg(*[F.count_if((F.col("y") == a) & (F.col("p") == b)).alias(f"c{a}{b}")
                   for a in (0, 1) for b in (0, 1)])
    rows = []
    for k in (0, 1):
        o = 1 - k
        tp, fp, fn = F.col(f"c{k}{k}"), F.col(f"c{o}{k}"), F.col(f"c{k}{o}")
        prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
        rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
        f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
        rows.append(agg.select(F.lit(k).alias("label"), rnd(prec, 6).alias("precision"),
                               rnd(rec, 6).alias("recall"), rnd(f1, 6).alias("f1"),
                               (tp + fn).cast("bigint").alias("support")))
    return rows[0].unionByName(rows[1])


def predict_all(model: PipelineModel, latest: DataFrame, key: str = "device_id", *,
                settings: ModelSettings, method: str = "sequence_logistic") -> DataFrame:
    """M7 for every device at once; short histories give an error row. ``settings``
    are those the model was trained with."""
    def probability(ok: DataFrame) -> DataFrame:
        scored = model.transform(ok.withColumn("features", array_to_vector("seq")))
        return scored.withColumn("maintenance_probability", vector_to_array("probability")[1])
    return predict_with(probability, latest, key, settings=settings, method=method)


def predict_with(probability: Callable[[DataFrame], DataFrame], latest: DataFrame, key: str = "device_id", *,
                 settings: ModelSettings, method: str) -> DataFrame:
    """M7 with any scorer: ``probability`` adds ``maintenance_probability`` to rows that hold ``seq``."""
    scored = probability(latest.where(F.col("seq").isNotNull()))
    t = DEFAULT.thresholds
    good = scored.select(
        key, "maintenance_probability",
        (F.col("maintenance_probability") > t.maintenance_threshold).alias("maintenance_needed"),
        prediction_risk(F.col("maintenance_probability")).alias("risk_level"),
        F.lit(settings.prediction_horizon).alias("prediction_horizon_minutes"),
        F.col("ts").alias("timestamp"), F.lit(method).alias("method"), F.lit(None).cast("string").alias("error"))
    short = latest.where(F.col("seq").isNull()).select(
        key, F.lit(None).cast("double").alias("maintenance_probability"),
        F.lit(None).cast("boolean").alias("maintenance_needed"), F.lit(None).cast("string").alias("risk_level"),
        F.lit(settings.prediction_horizon).alias("prediction_horizon_minutes"),
        F.col("ts").alias("timestamp"), F.lit(method).alias("method"),
        F.lit("not enough data").alias("error"))
    return good.unionByName(short).withColumn("advice", risk_advice(F.col("risk_level")))


def save_model(model: PipelineModel, path: str, features: list[str], settings: ModelSettings,
               spark: SparkSession, scaler: dict[str, tuple[float, float]] | None = None) -> None:
    """The fitted pipeline, and beside it one row of metadata with the scaler
    (exact decimal text of its doubles), so a loaded model scores raw rows."""
    model.write().overwrite().save(f"{path}/pipeline")
    meta = {"sequence_length": settings.sequence_length, "prediction_horizon": settings.prediction_horizon,
            "feature_columns": features, "model_type": f"sequence_{settings.classifier}",
            "scaler": {c: [float(m).hex(), float(s).hex()] for c, (m, s) in scaler.items()} if scaler else None}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """The pipeline and its metadata; ``scaler`` as :func:`apply_scaler` takes it."""
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    if meta.get("scaler"):
        meta["scaler"] = {c: (float.fromhex(m), float.fromhex(s)) for c, (m, s) in meta["scaler"].items()}
    return PipelineModel.load(f"{path}/pipeline"), meta


def predict_saved(spark: SparkSession, path: str, rows: DataFrame, key: str = "device_id",
                  order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """M7 from a saved model and raw feature rows: scaled as in training, newest
    window per device, scored."""
    model, meta = load_model(spark, path)
    scaled = apply_scaler(rows, meta["scaler"]) if meta.get("scaler") else rows
    latest = latest_sequence(scaled, [key], list(order), meta["feature_columns"], meta["sequence_length"])
    settings = replace(DEFAULT.model, sequence_length=meta["sequence_length"], prediction_horizon=meta["prediction_horizon"])
    return predict_all(model, latest, key, settings=settings, method=meta["model_type"])


def model_information(spark: SparkSession, path: str) -> DataFrame:
    """2.13: what a saved model is, one row: type, window, horizon, number of
    features, whether it carries its scaler."""
    meta = F.from_json("value", "model_type string, sequence_length int, prediction_horizon int, "
                                "feature_columns array<string>, scaler map<string, array<string>>")
    return spark.read.text(f"{path}/metadata").select(meta.alias("m")).select(
        "m.model_type", "m.sequence_length", "m.prediction_horizon", F.size("m.feature_columns").alias("n_features"),
        F.array_join("m.feature_columns", ",").alias("features"), F.col("m.scaler").isNotNull().alias("has_scaler"))


# ---------------------------------------------------------------- registered queries
# Telemetry has about two readings per device and day, so the registered
# sequence queries use a window of 10 readings and a 2-reading horizon.
SEQ_LEN, SEQ_H = 10, 2
SAMPLE_KEY = ["device_id", "event_id"]
SETTINGS = replace(DEFAULT.model, sequence_length=SEQ_LEN, prediction_horizon=SEQ_H)
FEATURES = list(TELEMETRY_SENSORS.values())


def telemetry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 per-reading frame: key, order, finite features, label."""
    f = prepare_features(scored_telemetry(spark, sf_dir))
    return f.select("device_id", "ts", "event_id", *[finite_or_zero(F.col(c)).alias(c) for c in FEATURES],
                    "maintenance_needed")


def telemetry_samples(spark: SparkSession, sf_dir: str, length: int = SEQ_LEN, horizon: int = SEQ_H,
                      scaler: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    rows = telemetry_rows(spark, sf_dir)
    if scaler:
        rows = apply_scaler(rows, scaler)
    return sequence_samples(rows, ["device_id"], ["ts", "event_id"], FEATURES, "maintenance_needed",
                            length, horizon, write_once=True)


def training_scaler(spark: SparkSession, sf_dir: str) -> dict[str, tuple[float, float]]:
    """M3 fitted on the readings that end a training sample of the split that
    training uses (Q11: not on one device); no reading that ends a held-out
    sample takes part."""
    ends = split_samples(telemetry_samples(spark, sf_dir), SETTINGS).where(~F.col("_test")).select(*SAMPLE_KEY)
    return fit_scaler(telemetry_rows(spark, sf_dir).join(ends, SAMPLE_KEY, "left_semi"), FEATURES)


def _seq_sql(length: int, horizon: int) -> str:
    w = "partition by device_id order by ts, event_id"
    rowsum = " + ".join(f"coalesce({c}, 0e0)" for c in FEATURES)
    return f"""
with s as ({scored_sql()}),
f as (select device_id, ts, event_id, ({rowsum}) as rs, case when anomaly_score > 0.7 then 1 else 0 end as y,
             row_number() over ({w}) - 1 as pos from s),
g as (select *, sum(rs) over ({w} rows between {length - 1} preceding and current row) as seq_sum,
             lead(y, {horizon}) over ({w}) as label from f)
select device_id, ts, event_id, round(seq_sum, 6) as seq_sum, cast({length * len(FEATURES)} as integer) as seq_size,
       cast(label as integer) as label
from g where pos >= {length - 1} and label is not null
"""


@register("sequence_samples", _seq_sql(SEQ_LEN, SEQ_H), ids=("W8", "M2", "M4", "F15", "P12"))
def sequence_samples_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = telemetry_samples(spark, sf_dir)
    return s.select("device_id", "ts", "event_id",
                    rnd(F.aggregate("seq", F.lit(0.0), lambda a, x: a + x), 6).alias("seq_sum"),
                    F.size("seq").alias("seq_size"), F.col("label").cast("int").alias("label"))


@register("latest_sequences", f"""
with s as ({scored_sql()}),
r as (select *, row_number() over (partition by device_id order by ts desc, event_id desc) as rn from s),
l as (select * from r where rn <= {SEQ_LEN})
select device_id, max(ts) as ts, count(*) as n_rows,
  case when count(*) >= {SEQ_LEN} then round(sum({" + ".join(f"coalesce({c}, 0e0)" for c in FEATURES)}), 6) end as seq_sum
from l group by device_id
""", ids=("W9", "W10"))
def latest_sequences_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_telemetry(spark, sf_dir).select("device_id", "ts", "event_id",
                                               *[finite_or_zero(F.col(c)).alias(c) for c in FEATURES])
    ls = latest_sequence(s, ["device_id"], ["ts", "event_id"], FEATURES, SEQ_LEN)
    return ls.select("device_id", "ts", "n_rows",
                     rnd(F.aggregate("seq", F.lit(0.0), lambda a, x: a + x), 6).alias("seq_sum"))


def _trained(spark: SparkSession, sf_dir: str, settings: ModelSettings = SETTINGS):
    scaler = training_scaler(spark, sf_dir)
    model, held_out = train(telemetry_samples(spark, sf_dir, scaler=scaler), settings, max_iter=30)
    return model, held_out, scaler


@register("model_evaluation", None, ids=("M5", "M6", "A22"))
def model_evaluation_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, held_out, _ = _trained(spark, sf_dir)
    return evaluation(held_out)


@register("tree_evaluation", None, ids=("M5", "M6", "A22"))
def tree_evaluation_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, held_out, _ = _trained(spark, sf_dir, replace(SETTINGS, classifier="tree"))
    return evaluation(held_out)


@register("device_predictions", None, ids=("M7", "F17", "2.13"))
def device_predictions_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _, scaler = _trained(spark, sf_dir)
    rows = apply_scaler(telemetry_rows(spark, sf_dir), scaler)
    latest = latest_sequence(rows, ["device_id"], ["ts", "event_id"], FEATURES, SEQ_LEN)
    return predict_all(model, latest, settings=SETTINGS)


def _split_sql() -> str:
    """The samples of the registered model with their class rank and split."""
    return f"""
smp as ({_seq_sql(SEQ_LEN, SEQ_H)}),
rk as (select *, row_number() over (partition by label order by md5(concat_ws('|', device_id, cast(event_id as varchar)))) - 1 as pos,
              count(*) over (partition by label) as n from smp),
sp as (select device_id, event_id, label, pos < round(n * {DEFAULT.model.validation_split}) as test from rk)
"""


@register("sample_split", f"with {_split_sql()} select device_id, event_id, label, test from sp", ids=("M5",))
def sample_split_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_samples(telemetry_samples(spark, sf_dir), SETTINGS).select(
        *SAMPLE_KEY, F.col("label").cast("int").alias("label"), F.col("_test").alias("test"))


def _report_sql(cut: float) -> str:
    """A22 of the held-out samples, with the current anomaly score as the stored probability."""
    def of(k: int) -> str:
        tp, fp, fn = (f"count(*) filter (y {a} {k} and p {b} {k})" for a, b in (("=", "="), ("<>", "="), ("=", "<>")))
        return (f"select {k} as label, {tp} as tp, {fp} as fp, {fn} as fn from c")
    return f"""with {_split_sql()},
c as (select sp.label as y, case when sc.anomaly_score > {cut}e0 then 1 else 0 end as p from sp
      join ({scored_sql()}) sc on sc.device_id = sp.device_id and sc.event_id = sp.event_id where sp.test),
k as ({of(0)} union all {of(1)}),
m as (select label, tp + fn as support, case when tp + fp > 0 then tp / (tp + fp) else 0e0 end as prec,
             case when tp + fn > 0 then tp / (tp + fn) else 0e0 end as rec from k)
select label, round(prec, 6) as precision, round(rec, 6) as recall,
       round(case when prec + rec > 0 then 2 * prec * rec / (prec + rec) else 0e0 end, 6) as f1, support from m"""


@register("score_report", _report_sql(0.3), ids=("A22", "M5"))
def score_report_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22 on a stored score: does the anomaly score now tell the label two readings on."""
    held_out = split_samples(telemetry_samples(spark, sf_dir), SETTINGS).where("_test").select(*SAMPLE_KEY, "label")
    scores = scored_telemetry(spark, sf_dir).select(*SAMPLE_KEY, "anomaly_score")
    return evaluation_of(held_out.join(scores, SAMPLE_KEY), F.col("anomaly_score"), 0.3)


@register("feature_scaler", f"with {_split_sql()}, tr as (select sc.* from ({scored_sql()}) sc semi join "
          "(select * from sp where not test) x on x.device_id = sc.device_id and x.event_id = sc.event_id) "
          + " union all ".join(f"select '{c}' as feature, round(avg(coalesce({c}, 0e0)), 6) as mean, "
                               f"round(case when stddev_pop(coalesce({c}, 0e0)) = 0 then 1e0 "
                               f"else stddev_pop(coalesce({c}, 0e0)) end, 6) as scale from tr" for c in FEATURES),
          ids=("M3",))
def feature_scaler_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 statistics on the training share of the per-reading features."""
    sc = training_scaler(spark, sf_dir)
    return spark.createDataFrame([(c, float(m), float(s)) for c, (m, s) in sc.items()],
                                 "feature string, mean double, scale double").select(
        "feature", rnd("mean", 6).alias("mean"), rnd("scale", 6).alias("scale"))
