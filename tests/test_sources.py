"""Readers and artifacts (S1-S3, S7-S11) on files written from driver data."""

import json
import os

import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from wearline import contracts as C
from wearline.operators import models
from wearline.sources import artifacts, readers, tables
from conftest import SF_SMALL


def test_machine_csv(spark, tmp_dir):
    o = tables.obs(spark, SF_SMALL).limit(200).toPandas()
    pdf = pd.DataFrame({
        "UDI": range(1, len(o) + 1), "Product ID": [f"P{i}" for i in range(len(o))], "Type": "M",
        "Air temperature [K]": o.air_temperature, "Process temperature [K]": o.process_temperature,
        "Rotational speed [rpm]": o.rotational_speed.round().astype(int), "Torque [Nm]": o.torque,
        "Tool wear [min]": o.tool_wear.astype(int), "Machine failure": o.failure,
        "TWF": o.twf, "HDF": o.hdf, "PWF": o.pwf, "OSF": o.osf, "RNF": o.rnf})
    path = os.path.join(tmp_dir, "ai4i.csv")
    pdf.to_csv(path, index=False)
    df = readers.read_machine_csv(spark, path)
    assert df.count() == len(o) and "air_temperature" in df.columns and "failure" in df.columns
    assert df.agg(F.sum("failure")).first()[0] == int(o.failure.sum())


def test_whitespace_trajectories(spark, tmp_dir):
    t = tables.traj(spark, SF_SMALL).where("unit_id < 3").toPandas()
    path = os.path.join(tmp_dir, "train.txt")
    with open(path, "w") as f:
        for r in t.itertuples():
            vals = [r.unit_id, r.cycle, 0.1, 0.2, 100.0] + [r.sensor_1, r.sensor_2] + [1.0] * 19
            f.write(" ".join(str(v) for v in vals) + "  \n")
        f.write("\n")
    df = readers.read_trajectory_text(spark, path)
    assert df.count() == len(t) and df.where("_fields != 26").count() == 0
    assert df.columns[:5] == ["unit_id", "cycle", "operational_setting_1", "operational_setting_2",
                              "operational_setting_3"]


def test_positional_labels(spark, tmp_dir):
    path = os.path.join(tmp_dir, "rul.txt")
    values = [112, 98, 69, 82, 91, 7]
    with open(path, "w") as f:
        f.write("\n".join(str(v) + " " for v in values) + "\n")
    got = readers.read_positional_labels(spark, path).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 7)) and [r.provided_rul for r in got] == values


def test_csv_quarantine(spark, tmp_dir):
    req = ["cycle", "sensor_2", "sensor_3"]
    good = "﻿cycle, sensor_2 ,sensor_3\n1,1.0,2.0\n2,1.5,2.5\n"
    bad_rows = "cycle,sensor_2,sensor_3\n1,1.0,abc\n2.5,1,1\n3,1\n4,true,1\n"
    dup = "cycle,cycle,sensor_3\n1,2,3\n"
    for name, text in [("good.csv", good), ("bad.csv", bad_rows), ("dup.csv", dup)]:
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write(text)
    ok, bad = readers.read_trajectory_csv(spark, tmp_dir, required=req, allow_booleans=False)
    assert ok.count() == 2
    reasons = {(os.path.basename(r.file), r.line): r.reason for r in bad.collect()}
    assert reasons[("bad.csv", 1)] == "non-numeric value"
    assert reasons[("bad.csv", 2)] == "non-integer cycle"
    assert reasons[("bad.csv", 3)] == "wrong number of fields"
    assert reasons[("bad.csv", 4)] == "boolean value"
    assert reasons[("dup.csv", 1)] in ("duplicate header", "missing header")


def test_trajectory_csv_quotes_lines_and_cycle_order(spark, tmp_dir):
    rows = ['"cycle","sensor_2"', "1,1.0", '"2"," 2.5 "', "2,3.0", "3,4.0", "6,4.0", "5,1.0", "0,1.0"]
    rows += [f"{k},1.0" for k in range(1, 5000)] + ['5000,"x,y"']
    with open(os.path.join(tmp_dir, "one.csv"), "w") as f:
        f.write("\n".join(rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")  # several splits
    try:
        ok, bad = readers.read_trajectory_csv(spark, tmp_dir, required=["cycle", "sensor_2"])
        reasons = {r.line: r.reason for r in bad.collect()}
        assert reasons == {
            3: "duplicate cycle", 5: "cycle not consecutive", 6: "cycle not increasing", 7: "non-positive cycle",
            5007: "non-numeric value",
        }
        assert ok.count() == len(rows) - 1 - len(reasons)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_file_with_a_rejected_line_is_refused_whole(spark, tmp_dir):
    for name, cycles in (("good", [1, 2, 3]), ("gap", [1, 2, 4, 5]), ("blank", [1, "", 3])):
        with open(os.path.join(tmp_dir, f"{name}.csv"), "w") as f:
            f.write("\n".join(["cycle,sensor_2", *[f"{c},1.5" for c in cycles]]))
    ok, bad = readers.read_trajectory_csv(spark, tmp_dir, required=["cycle", "sensor_2"], whole_files=True)
    assert sorted((os.path.basename(r.file), r.cycle) for r in ok.collect()) == [("good.csv", 1), ("good.csv", 2), ("good.csv", 3)]
    assert {(os.path.basename(r.file), r.line) for r in bad.collect()} >= {("gap.csv", 3), ("blank.csv", 2)}
    loose, _ = readers.read_trajectory_csv(spark, tmp_dir, required=["cycle", "sensor_2"])
    assert loose.count() > ok.count()


def test_positional_labels_need_one_file(spark, tmp_dir):
    for name in ("a.txt", "b.txt"):
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write("1\n2\n")
    with pytest.raises(ValueError, match="one file"):
        readers.read_positional_labels(spark, tmp_dir)


def test_request_json(spark):
    body_ok = json.dumps({"unit_id": "7", "observations": [{"cycle": 1, "sensor_2": 1.0}, {"cycle": 2, "sensor_2": 2.0}]})
    df = spark.createDataFrame([(1, body_ok), (2, "{not json"), (3, json.dumps({"unit_id": "8", "observations": []}))],
                               "request_id int, body string")
    rows, bad = readers.parse_requests(df, fields=["cycle", "sensor_2"])
    got = rows.orderBy("arrival").collect()
    assert [(r.arrival, r.cycle) for r in got] == [(0, 1), (1, 2)]
    assert {r.request_id: r.reason for r in bad.collect()} == {2: "malformed JSON", 3: "no observations"}


def test_metadata_rules_follow_the_kind(spark, tmp_dir):
    path = os.path.join(tmp_dir, "rul-meta")
    artifacts.write_metadata(spark, {"model_name": "rul", "model_version": "1", "predictor_columns": ["cycle"]}, path)
    artifacts.require_metadata(spark, path, "rul", ["cycle"])
    with pytest.raises(ValueError, match="predictors_match_contract"):
        artifacts.require_metadata(spark, path, "rul", ["cycle", "sensor_2"])
    with pytest.raises(ValueError, match="risk_thresholds_ordered"):
        artifacts.require_metadata(spark, path, "failure", ["cycle"])


def test_pipeline_artifact_roundtrip(spark, tmp_dir):
    o = tables.obs(spark, SF_SMALL)
    model = Pipeline(stages=models.machine_preprocessing() + [models.classifier("logistic", n_rows=6000)]).fit(o)
    path = os.path.join(tmp_dir, "model")
    artifacts.save_pipeline(model, path)
    again = artifacts.load_pipeline(path)
    a = models.positive_probability(model.transform(o)).select("p_failure").collect()
    b = models.positive_probability(again.transform(o)).select("p_failure").collect()
    assert a == b


def test_metadata_and_rules(spark, tmp_dir):
    meta = {"model_name": "fleet anomaly", "model_version": "1.0.0", "predictor_columns": C.ANOMALY_SENSORS,
            "threshold_quantile": 0.975, "threshold_raw_score": 0.52, "p97_5": 0.52, "calibration_method": "sigmoid",
            "thresholds": {"medium": 0.3, "high": 0.6, "critical": 0.9}, "metrics": {"rmse": 1.0},
            "training_row_count": 10}
    path = os.path.join(tmp_dir, "meta")
    artifacts.write_metadata(spark, meta, path)
    m = artifacts.read_metadata(spark, path)
    ref = spark.createDataFrame([(0.1,), (0.5,)], "score double")
    v = {r.rule: r.violated for r in artifacts.metadata_violations(m, ref, C.ANOMALY_SENSORS).collect()}
    assert not any(v.values())
    bad = dict(meta, thresholds={"medium": 0.6, "high": 0.3, "critical": 0.9}, p97_5=0.6, model_name=" ")
    artifacts.write_metadata(spark, bad, path)
    v = {r.rule: r.violated for r in artifacts.metadata_violations(artifacts.read_metadata(spark, path)).collect()}
    assert v["risk_thresholds_ordered"] and v["p97_5_matches_threshold"] and v["name_present"]


def test_forest_bundle_roundtrip(spark, tmp_dir):
    from wearline.operators import forest
    df = spark.createDataFrame([(i, 1, float(i % 7), float(i % 5)) for i in range(400)],
                               "unit_id long, cycle long, a double, b double")
    nodes, psi = forest.fit_isolation_forest(df, ["a", "b"], n_trees=10, max_samples=64)
    ref = forest.score_isolation_forest(df, nodes, psi, ["a", "b"]).select("score")
    artifacts.save_forest(nodes, ref, {"psi": psi, "version": "1"}, os.path.join(tmp_dir, "forest"))
    n2, r2, p2 = artifacts.load_forest(spark, os.path.join(tmp_dir, "forest"))
    assert p2["psi"] == psi and n2.count() == nodes.count() and r2.count() == 400
