"""Sequence model end to end on sf0.001: train, evaluate, predict, save/load."""

import tempfile

from gearsight.operators.sequences import latest_sequence
from gearsight.plans.model import (apply_scaler, evaluation, load_model, predict_all,
                                   save_model, telemetry_rows, telemetry_samples, train, training_scaler,
                                   FEATURES, SEQ_LEN, SETTINGS, split_samples)
from gearsight.config import DEFAULT

SF = "/root/testdata/sf0.01"


def test_train_predict_save_load(spark):
    sc = training_scaler(spark, SF)
    assert all(s > 0 for _, s in sc.values())
    model, held = train(telemetry_samples(spark, SF, scaler=sc), SETTINGS, max_iter=10)
    ev = {r.label: r for r in evaluation(held).collect()}
    assert set(ev) == {0, 1} and all(0 <= r.precision <= 1 for r in ev.values())
    rows = apply_scaler(telemetry_rows(spark, SF), sc)
    pred = predict_all(model, latest_sequence(rows, ["device_id"], ["ts", "event_id"], FEATURES, SEQ_LEN), settings=SETTINGS)
    p = pred.collect()
    assert len(p) == 150
    assert {r.prediction_horizon_minutes for r in p} == {2}         # the model's own horizon
    ends = split_samples(telemetry_samples(spark, SF), SETTINGS)
    split = {(r.device_id, r.event_id): r._test for r in ends.collect()}
    assert {(r.device_id, r.event_id) for r in held.collect()} == {k for k, t in split.items() if t}
    assert all((r.error is None) == (r.maintenance_probability is not None) for r in p)
    assert all(r.risk_level in (None, "low", "medium", "high") for r in p)
    path = tempfile.mkdtemp(prefix="gearsight-model-", dir="/tmp")
    save_model(model, path, FEATURES, SETTINGS, spark)
    m2, meta = load_model(spark, path)
    assert meta["feature_columns"] == FEATURES and (meta["sequence_length"], meta["prediction_horizon"]) == (10, 2)
    again = predict_all(m2, latest_sequence(rows, ["device_id"], ["ts", "event_id"], FEATURES, SEQ_LEN), settings=SETTINGS)
    a = {r.device_id: r.maintenance_probability for r in again.collect()}
    assert all(a[r.device_id] == r.maintenance_probability for r in p)


def test_saved_model_scores_raw_rows(spark):
    from gearsight.plans.model import device_predictions_q, model_information, predict_saved
    from gearsight.plans.model import _trained
    model, _, scaler = _trained(spark, SF)
    path = tempfile.mkdtemp(prefix="gearsight-model-", dir="/tmp")
    save_model(model, path, FEATURES, SETTINGS, spark, scaler)
    assert load_model(spark, path)[1]["scaler"] == scaler
    before = {r.device_id: r for r in device_predictions_q(spark, SF).collect()}
    after = {r.device_id: r for r in predict_saved(spark, path, telemetry_rows(spark, SF)).collect()}
    assert before.keys() == after.keys()
    for d, r in before.items():
        p, q = r.maintenance_probability, after[d].maintenance_probability
        assert (p is None and q is None) or abs(p - q) < 1e-9
    info = model_information(spark, path).first()
    assert (info.n_features, info.sequence_length, info.has_scaler) == (len(FEATURES), SEQ_LEN, True)


def test_single_class_raises(spark):
    import pytest
    s = spark.createDataFrame([("D", i, [0.1 * i, 0.2], 0) for i in range(20)],
                              "device_id string, event_id long, seq array<double>, label int")
    with pytest.raises(ValueError):
        train(s, DEFAULT.model, max_iter=5)


def test_stratified_split_exact_share(spark):
    from pyspark.sql import functions as F
    from gearsight.plans.model import stratified_split
    df = spark.range(0, 1037).withColumn("label", (F.col("id") % 7 == 0).cast("int"))
    s = stratified_split(df, "label", ["id"], 0.2)
    got = {(r.label, r._test): r["count"] for r in s.groupBy("label", "_test").count().collect()}
    n1 = len([i for i in range(1037) if i % 7 == 0]); n0 = 1037 - n1
    assert got[(1, True)] == round(n1 * 0.2) and got[(0, True)] == round(n0 * 0.2)
    again = {r.id for r in stratified_split(df, "label", ["id"], 0.2)
             .where("_test").collect()}
    assert again == {r.id for r in s.where("_test").collect()}


def test_tree_classifier(spark):
    """Labels that only a product of two features tells: trees learn them, and
    name the features; a loaded tree model scores alike and knows its type."""
    import random
    from dataclasses import replace
    import pytest
    from gearsight.plans.model import feature_importance, model_information
    rng = random.Random(1)
    rows = []
    for i in range(600):
        x = [rng.uniform(-1, 1) for _ in range(6)]                   # two steps of three features
        rows.append(("D", i, x, int(x[0] * x[4] > 0)))
    s = spark.createDataFrame(rows, "device_id string, event_id long, seq array<double>, label int")
    settings = replace(DEFAULT.model, classifier="tree", sequence_length=2)
    model, held = train(s, settings)
    assert all(r.recall > 0.8 for r in evaluation(held).collect())
    linear, plain = train(s, DEFAULT.model)
    assert min(r.recall for r in evaluation(plain).collect()) < 0.7
    top = feature_importance(spark, model, ["a", "b", "c"]).collect()
    assert {r.feature for r in top[:2]} == {"a", "b"} and abs(sum(r.importance for r in top) - 1) < 1e-9
    path = tempfile.mkdtemp(prefix="gearsight-model-", dir="/tmp")
    save_model(model, path, ["a", "b", "c"], settings, spark)
    again = load_model(spark, path)[0].transform(held.select("features", "event_id"))
    want = {r.event_id: r.probability for r in held.collect()}
    assert all(want[r.event_id] == r.probability for r in again.collect())
    assert model_information(spark, path).first().model_type == "sequence_tree"
    with pytest.raises(ValueError):
        train(s, replace(DEFAULT.model, classifier="other"))
