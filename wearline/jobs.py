"""Training jobs (M31): load -> prepare -> fit -> diagnose -> save.

    spark-submit wearline/jobs.py anomaly --data <sf_dir> --out <folder>
    spark-submit wearline/jobs.py rul     --data <sf_dir> --out <folder>
    spark-submit wearline/jobs.py failure --data <sf_dir> --out <folder>

Outputs go to a shared folder (never a machine-local path on a cluster):
the fitted model (MLlib writer / Parquet node table), the reference scores
and a one-row JSON metadata table.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys

if __package__ in (None, ""):  # run as a script (spark-submit wearline/jobs.py ...)
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.ml import Pipeline  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from wearline import contracts as C  # noqa: E402
from wearline.operators import detect, forest, metrics, models, ordered, splits  # noqa: E402
from wearline.session import get_session, materialize, ship_package  # noqa: E402
from wearline.sources import artifacts, tables  # noqa: E402

ANOMALY_SENSORS = ["sensor_1", "sensor_2", "sensor_3", "sensor_4", "sensor_5"]


def train_anomaly(spark: SparkSession, sf_dir: str, out: str, n_trees: int = 300, max_samples: int = 256) -> dict:
    """M15 + M30: scaler and isolation forest on the healthy reference,
    reference scores, .975 threshold, production-policy diagnostics."""
    r = detect.add_rul_targets(tables.traj(spark, sf_dir))
    scored = detect.statistical_scores(r, ANOMALY_SENSORS)
    z = [f"z_{s}" for s in ANOMALY_SENSORS]
    ref = scored.where(F.col("raw_rul") > C.NORMAL_REFERENCE_RUL)
    nodes, psi = forest.fit_isolation_forest(ref, z, n_trees, max_samples)
    nodes = nodes.cache()
    # read by the threshold, the diagnostics and the bundle: scored once
    all_scores = materialize(forest.score_isolation_forest(scored.select("unit_id", "cycle", "raw_rul", *z), nodes, psi, z), "train-scores")
    ref_scores = all_scores.where(F.col("raw_rul") > C.NORMAL_REFERENCE_RUL).select("score")
    th = ordered.exact_quantiles(ref_scores, "score", [C.THRESHOLD_QUANTILE]).first()["value"]
    flagged = all_scores.withColumn("exceeded", F.col("score") > F.lit(th))
    pol = detect.alert_policies(flagged)
    obs = detect.observation_rates(pol, "exceeded").first()
    units = detect.unit_alert_summary(pol, "three_of_five")
    u = units.agg(F.avg(F.col("premature").cast("double")).alias("premature"),
                  F.avg(F.col("critical_alert").cast("double")).alias("coverage"),
                  F.count_if(F.col("lead_time").isNull()).alias("never")).first()
    artifacts.save_forest(nodes, ref_scores, {"psi": psi, "threshold": th, "n_trees": n_trees}, out)
    meta = {"model_name": "fleet anomaly isolation forest", "model_version": "1.0.0", "predictor_columns": z,
            "threshold_quantile": C.THRESHOLD_QUANTILE, "threshold_raw_score": th, "p97_5": th,
            "calibration_method": "none", "thresholds": {}, "training_row_count": ref.count(),
            "metrics": {"healthy_observation_pct": obs["healthy_observation_pct"],
                        "critical_observation_pct": obs["critical_observation_pct"],
                        "premature_unit_pct": 100 * u["premature"], "critical_unit_coverage_pct": 100 * u["coverage"],
                        "units_never_alerted": float(u["never"])}}
    artifacts.write_metadata(spark, meta, os.path.join(out, "metadata"))
    artifacts.require_metadata(spark, os.path.join(out, "metadata"), "anomaly", z,
                               scores_path=os.path.join(out, "reference_scores"))
    return meta


def train_rul(spark: SparkSession, sf_dir: str, out: str) -> dict:
    """M27 model: imputer + forest on every unit; group-fold OOF metrics."""
    from wearline.plans.models import RUL_FEATURES, rul_features
    f = rul_features(spark, sf_dir).cache()
    folds = splits.group_kfold(f, "unit_id", 5, 42)
    oof = models.out_of_fold(folds, "fold", 5, lambda d: models.rul_pipeline(RUL_FEATURES, "forest").fit(d),
                             ["unit_id", "cycle", "capped_rul"], "prediction")
    m = metrics.regression_metrics(oof, "prediction", "capped_rul").first()
    model = models.rul_pipeline(RUL_FEATURES, "forest").fit(f)
    artifacts.save_pipeline(model, os.path.join(out, "model"))
    meta = {"model_name": "fleet RUL forest", "model_version": "1.0.0", "predictor_columns": RUL_FEATURES,
            "training_row_count": f.count(),
            "metrics": {"rmse": m["rmse"], "mae": m["mae"], "r2": m["r2"], "penalty_mean": m["penalty_mean"]}}
    artifacts.write_metadata(spark, meta, os.path.join(out, "metadata"))
    artifacts.require_metadata(spark, os.path.join(out, "metadata"), "rul", RUL_FEATURES)
    return meta


def train_failure(spark: SparkSession, sf_dir: str, out: str, thresholds: dict | None = None) -> dict:
    """M11/M26 model: sigmoid-calibrated boosting over 5 stratified folds,
    evaluated on the stratified 20 % holdout (Brier, log loss, AUC, AP)."""
    o = tables.obs(spark, sf_dir)
    split = splits.stratified_holdout(o, ["unit_id", "cycle"], "failure", 0.2, 42).cache()
    train = splits.stratified_kfold(split.where("split = 'train'").drop("split"), ["unit_id", "cycle"], "failure")
    test = split.where("split = 'test'")
    base = lambda: Pipeline(stages=models.machine_preprocessing(binned=True) + [models.classifier("boosting")])
    cal = models.CalibratedClassifier(base, "sigmoid", 5).fit(train)
    p = cal.transform(test, ["failure"])
    pb = metrics.probability_scores(p, "calibrated_probability", "failure").first()
    auc = metrics.roc_auc(p, "calibrated_probability", "failure").first()["roc_auc"]
    ap = metrics.average_precision(metrics.pr_curve(p, "calibrated_probability", "failure")).first()[0]
    cal.save(os.path.join(out, "model"))
    meta = {"model_name": "fleet failure risk", "model_version": "1.0.0",
            "predictor_columns": C.MACHINE_RAW_FEATURES, "calibration_method": "sigmoid",
            "thresholds": thresholds or {"medium": 0.3, "high": 0.6, "critical": 0.9},
            "training_row_count": train.count(),
            "metrics": {"brier": pb["brier"], "log_loss": pb["log_loss"], "roc_auc": auc, "average_precision": ap,
                        **{f"platt_a_{i}": a for i, (_, (a, b)) in enumerate(cal.members)},
                        **{f"platt_b_{i}": b for i, (_, (a, b)) in enumerate(cal.members)}}}
    artifacts.write_metadata(spark, meta, os.path.join(out, "metadata"))
    artifacts.require_metadata(spark, os.path.join(out, "metadata"), "failure", C.MACHINE_RAW_FEATURES)
    return meta


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("job", choices=["anomaly", "rul", "failure"])
    ap.add_argument("--data", required=True)
    ap.add_argument("--out", required=True)
    args = ap.parse_args()
    spark = get_session()
    ship_package(spark)
    fn = {"anomaly": train_anomaly, "rul": train_rul, "failure": train_failure}[args.job]
    meta = fn(spark, args.data, args.out)
    print(json.dumps({"job": args.job, "finished_utc": dt.datetime.now(dt.timezone.utc).isoformat(),
                      "metrics": meta.get("metrics", {})}, default=str))


if __name__ == "__main__":
    main()
