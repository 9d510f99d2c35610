"""Study loops and training jobs on the small fixture."""

import os

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from wearline import jobs
from wearline.operators import models, splits
from wearline.plans.models import RUL_FEATURES, rul_features
from wearline.sources import artifacts, tables
from conftest import SF_SMALL


def _obs(spark):
    return tables.obs(spark, SF_SMALL).select("unit_id", "cycle", "type", "air_temperature", "process_temperature",
                                              "rotational_speed", "torque", "tool_wear", "failure")


def _logistic():
    return Pipeline(stages=models.machine_preprocessing() + [models.classifier("logistic", n_rows=4000)])


def test_feature_ablation(spark):
    f = splits.group_kfold(rul_features(spark, SF_SMALL), "unit_id", 3, 42).cache()
    sets = {"raw": ["cycle", "sensor_1", "sensor_4"], "raw+temporal": RUL_FEATURES}
    res = models.feature_ablation(f, "fold", 3, sets, lambda feats: models.rul_pipeline(feats, "ridge", 6000, True),
                                  "capped_rul", ["unit_id", "cycle"])
    got = {r.feature_set: r for r in res.collect()}
    assert set(got) == set(sets) and got["raw+temporal"].n_features > got["raw"].n_features
    assert all(r.rmse > 0 for r in got.values())


def test_nested_calibration_and_threshold_stability(spark):
    o = _obs(spark).cache()
    oof = models.nested_calibrated_oof(o, ["unit_id", "cycle"], "failure", _logistic, "sigmoid", 2, 2, 42)
    assert oof.count() == o.count()
    assert oof.where("calibrated_probability < 0 OR calibrated_probability > 1").count() == 0
    st = models.threshold_stability(o, ["unit_id", "cycle"], "failure", _logistic, seeds=(42, 52), outer=2, inner=2)
    rows = {r.policy: r for r in st.collect()}
    assert set(rows) >= {"medium", "best_f1"} and all(r.seeds == 2 for r in rows.values())


def test_anomaly_training_job(spark, tmp_dir):
    meta = jobs.train_anomaly(spark, SF_SMALL, os.path.join(tmp_dir, "anomaly"), n_trees=30, max_samples=64)
    nodes, ref, params = artifacts.load_forest(spark, os.path.join(tmp_dir, "anomaly"))
    assert params["n_trees"] == 30 and ref.count() == meta["training_row_count"]
    m = artifacts.read_metadata(spark, os.path.join(tmp_dir, "anomaly", "metadata"))
    v = {r.rule: r.violated for r in artifacts.metadata_violations(m, ref.select(F.col("score"))).collect()}
    assert not v["threshold_finite"] and not v["p97_5_matches_threshold"] and not v["reference_finite"]
