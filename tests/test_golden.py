"""Golden vectors of the reference's tests, rewritten from their stated semantics."""

import math

import pytest
from pyspark.sql import functions as F

from wearline import contracts as C
from wearline.functions import columns as X
from wearline.operators import detect, ordered, windows


def test_machine_features_golden(spark):
    df = spark.createDataFrame([(300.0, 311.5, 1500.0, 40.0, 100.0)], "air double, proc double, speed double, "
                                                                      "torque double, wear double")
    r = df.select(X.temperature_difference("proc", "air").alias("d"), X.power_proxy("speed", "torque").alias("p"),
                  X.strain_proxy("torque", "wear").alias("s")).first()
    assert (r.d, r.p, r.s) == (11.5, 60000.0, 4000.0)


def test_temporal_features_golden(spark):
    df = spark.createDataFrame([(1, c, 400.0 + c) for c in range(1, 7)], "unit_id long, cycle long, sensor_4 double")
    r = windows.add_temporal_features(df, ["sensor_4"]).where("cycle = 6").first()
    assert r.sensor_4_lag_1 == 405 and r.sensor_4_lag_5 == 401
    assert r.sensor_4_rolling_mean_5 == 404
    assert math.isclose(r.sensor_4_rolling_std_5, math.sqrt(2))
    assert r.sensor_4_delta_1 == 1
    first = windows.add_temporal_features(df, ["sensor_4"]).where("cycle = 1").first()
    assert first.sensor_4_lag_1 is None and first.sensor_4_rolling_std_5 == 0.0


def test_ecdf_golden(spark):
    ref = spark.createDataFrame([(v,) for v in [1.0, 2.0, 2.0, 4.0]], "score double")
    q = spark.createDataFrame([(i, v) for i, v in enumerate([-1.0, 1.0, 2.0, 3.0, 5.0])], "i int, score double")
    got = [r.p for r in ordered.ecdf_percentile(q, "score", ref, "score", "p").orderBy("i").collect()]
    assert got == [0.0, 25.0, 75.0, 75.0, 100.0]


def test_strict_exceedance_golden(spark):
    df = spark.createDataFrame([(0.4,), (0.5,), (0.6,)], "s double")
    assert [r.e for r in df.select(X.exceeded("s", 0.5).alias("e")).collect()] == [False, False, True]
    assert [r.d for r in df.select(X.decision("s", 0.5).alias("d")).collect()] == [False, True, True]


@pytest.mark.parametrize("pattern,alert", [
    ("TTTFF", True), ("TTFFF", False), ("TTTTF", True), ("T" * 10 + "F" * 5, False), ("TTT", False)])
def test_last_five_persistence(spark, pattern, alert):
    rows = [(1, i + 1, ch == "T") for i, ch in enumerate(pattern)]
    df = spark.createDataFrame(rows, "unit_id long, cycle long, exceeded boolean")
    out = windows.trailing_columns(df, {**windows.persistence_columns("exceeded"),
                                        **windows.recent_pattern_columns("exceeded")}, lookback=4)
    last = out.orderBy(F.desc("cycle")).first()
    assert last.persistent is alert
    assert "".join("T" if x else "F" for x in last.recent_pattern) == pattern[-5:]


def test_persistence_probe(spark):
    scores = [0, 1, 1, 0, 1, 1]
    df = spark.createDataFrame([(1, i + 1, float(s)) for i, s in enumerate(scores)],
                               "unit_id long, cycle long, score double").withColumn("exceeded", X.exceeded("score", 0.5))
    out = windows.trailing_columns(df, {**windows.consecutive_columns("exceeded"),
                                        **windows.persistence_columns("exceeded", 5, 3, min_periods=1)}, lookback=4)
    rows = out.orderBy("cycle").collect()
    assert [r.two_consecutive for r in rows] == [False, False, True, False, False, True]
    assert [r.persistent for r in rows] == [False, False, False, False, True, True]


def test_penalty_sanity(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (-10.0,)], "d double")
    p = [r.p for r in df.select(X.asymmetric_penalty(F.col("d"), F.lit(0.0)).alias("p")).collect()]
    assert p[0] == 0 and p[1] > p[2] > 0


def test_risk_category_boundaries(spark):
    t = {"medium": 0.3, "high": 0.6, "critical": 0.9}
    vals = [0.3 - 1e-9, 0.3, 0.6 - 1e-9, 0.6, 0.9 - 1e-9, 0.9, 1.0, 0.0]
    df = spark.createDataFrame([(v,) for v in vals], "s double")
    got = [r.c for r in df.select(X.risk_category("s", t["medium"], t["high"], t["critical"]).alias("c")).collect()]
    assert got == ["Low Risk", "Medium Risk", "Medium Risk", "High Risk", "High Risk", "Critical Risk",
                   "Critical Risk", "Low Risk"]
    bad = spark.createDataFrame([(1.5,)], "s double").select(X.risk_category("s", 0.3, 0.6, 0.9).alias("c"))
    with pytest.raises(Exception):
        bad.collect()


def test_rul_display_half_even(spark):
    df = spark.createDataFrame([(2.25,), (119.95,), (120.0,), (0.0,)], "b double")
    got = [r.t for r in df.select(X.rul_display("b").alias("t")).collect()]
    assert got[0] == "Estimated Remaining Useful Life: 2.2 cycles"
    assert got[2] == C.HORIZON_TEXT and got[3].endswith("0.0 cycles")


def test_rul_guard(spark):
    ok = spark.createDataFrame([(125.0 + 1e-10,), (-1e-10,)], "p double").select(X.guard_rul_prediction("p").alias("g"))
    assert len(ok.collect()) == 2
    with pytest.raises(Exception):
        spark.createDataFrame([(126.0,)], "p double").select(X.guard_rul_prediction("p")).collect()


def test_stages_are_right_inclusive(spark):
    df = spark.createDataFrame([(v,) for v in [30, 31, 60, 61, 125, 126]], "r long")
    got = [r.s for r in df.select(X.lifecycle_stage("r").alias("s")).collect()]
    assert got == ["Critical late life", "Near failure", "Near failure", "Degrading", "Degrading", "Healthy / early"]
    bands = [r.b for r in df.select(X.rul_band("r").alias("b")).collect()]
    assert bands[0] == C.RUL_BANDS[0] and bands[1] == C.RUL_BANDS[1] and bands[-1] == C.RUL_BANDS[2]


def test_scaler_population_std_and_zero_scale(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    p = detect.scaler_params(df, ["a", "b"]).first()
    assert p.a_mean == 2.0 and p.a_scale == 1.0 and p.b_scale == 1.0
    z = detect.standardize(df, detect.scaler_params(df, ["a", "b"]), ["a", "b"]).orderBy("a").collect()
    assert [r.z_a for r in z] == [-1.0, 1.0] and [r.z_b for r in z] == [0.0, 0.0]


def test_top_deviations_order(spark):
    df = spark.createDataFrame([(3.0, -3.0, 1.0, 0.0, 0.0, 0.0)],
                               "s1 double, s2 double, s3 double, s1_mean double, s2_mean double, s3_mean double")
    df = df.withColumns({"z_s1": F.col("s1"), "z_s2": F.col("s2"), "z_s3": F.col("s3")})
    top = df.select(detect.top_deviations(["s1", "s2", "s3"], 2).alias("t")).first().t
    assert [d.sensor for d in top] == ["s1", "s2"]
    assert [d.direction for d in top] == ["above_normal", "below_normal"]
    with pytest.raises(ValueError):
        detect.top_deviations(["s1"], 2)


def test_feature_family(spark):
    names = ["cycle", "operational_setting_1", "sensor_4_rolling_mean_5", "sensor_4_rolling_std_5",
             "sensor_4_delta_1", "sensor_4_lag_5", "sensor_9"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.f for r in df.select(X.feature_family("n").alias("f")).collect()]
    assert got == ["cycle", "operating setting", "rolling mean", "rolling std", "delta", "lag", "raw sensor"]


def test_nan_is_not_finite(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (1.0,)], "x double")
    assert [r.f for r in df.select(X.is_finite("x").alias("f")).collect()] == [False, False, False, True]
