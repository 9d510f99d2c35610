"""Fleet-wide trajectory rules, precedence and column contracts."""

import datetime as dt

from pyspark.sql import functions as F

from wearline.operators import validate


def _traj(spark):
    t0 = dt.datetime(2024, 1, 1)
    cases = {
        "ok": [(1, "1", "1.0"), (1, "2", "2.0"), (1, "3", "3.0")],
        "dup": [(2, "1", "1"), (2, "2", "1"), (2, "2", "1")],
        "gap": [(3, "1", "1"), (3, "2", "1"), (3, "4", "1")],
        "order": [(4, "1", "1"), (4, "3", "1"), (4, "2", "1")],
        "nonpos": [(5, "0", "1"), (5, "1", "1")],
        "frac": [(6, "1.5", "1"), (6, "2.5", "1")],
        "nonnum": [(7, "1", "abc"), (7, "2", "1")],
        "unitnull": [(None, "1", "1"), (8, "2", "1")],
        "multi": [(9, "1", "1"), (10, "2", "1")],
        "both": [(11, "1", "x"), (11, "1", "1")],
        "whole_float": [(12, "3.0", "1"), (12, "4.0", "1")],
    }
    rows = [(k, u, c, v, t0 + dt.timedelta(minutes=i)) for k, rs in cases.items() for i, (u, c, v) in enumerate(rs)]
    return spark.createDataFrame(rows, "key string, unit_id long, cycle string, value string, ts timestamp")


def test_rules_and_first_error(spark):
    dim = spark.createDataFrame([(k,) for k in ["ok", "dup", "gap", "order", "nonpos", "frac", "nonnum", "unitnull",
                                                "multi", "both", "whole_float", "missing"]], "key string")
    out = {r.key: r for r in validate.trajectory_violations(
        _traj(spark), "key", "unit_id", "cycle", "ts", ["value"], expected=dim).collect()}
    assert out["ok"].first_error is None and out["whole_float"].first_error is None
    assert out["missing"].first_error == "empty" and out["missing"].n_rows == 0
    assert out["dup"].first_error == "duplicate_cycle"
    assert out["gap"].first_error == "not_consecutive"
    assert out["order"].first_error == "not_increasing"
    assert out["nonpos"].first_error == "non_positive_cycle"
    assert out["frac"].first_error == "non_integer_cycle"
    assert out["nonnum"].first_error == "non_numeric"
    assert out["unitnull"].first_error == "unit_missing"
    assert out["multi"].first_error == "unit_not_unique"
    assert out["both"].non_numeric and out["both"].duplicate_cycle and out["both"].first_error == "non_numeric"


def test_integer_typed_cycle_rule(spark):
    df = spark.createDataFrame([("a", 1, 3.0, "1", dt.datetime(2024, 1, 1))],
                               "key string, unit_id long, cycle double, value string, ts timestamp")
    r = validate.trajectory_violations(df, "key", "unit_id", "cycle", "ts", ["value"], integer_typed_cycle=True).first()
    assert r.non_integer_cycle


def test_column_contract():
    assert validate.column_contract(["a", "b"], ["a", "b"]) == []
    probs = validate.column_contract(["a", "a", " RUL ", "x"], ["a", "b"], forbid_extra=True)
    text = " | ".join(probs)
    assert "duplicate" in text and "missing" in text and "rul" in text and "unexpected" in text


def test_allow_list_drops_leakage(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1)], "a double, b double, failure int")
    assert validate.allow_list(df, ["b", "a"]).columns == ["b", "a"]


def test_dataset_gate(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "unit_id int, x double")
    import pytest
    with pytest.raises(ValueError):
        validate.dataset_gate(df, "unit_id")
    assert validate.dataset_gate(df.where(F.col("x").isNotNull()), "unit_id", 1, 1)["rows"] == 1
