"""Anomaly detector as Estimator and Model: saved bundles, pipelines, the gate in front."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from wearline.operators import detector

S = ["a", "b", "c"]


def fleet(spark, units=6, cycles=40):
    rng = np.random.default_rng(2)
    rows = [(u, c, c, *map(float, rng.normal(size=2)), 5.0) for u in range(units) for c in range(1, cycles + 1)]
    return spark.createDataFrame(rows, "unit_id long, arrival long, cycle long, a double, b double, c double")


def scores(model, df):
    return [tuple(r) for r in model.transform(df).select("unit_id", "cycle", "score", "exceeded", "raw_threshold").orderBy("unit_id", "cycle").collect()]


@pytest.mark.parametrize("kind", ["statistical", "forest"])
def test_saved_bundles_score_the_same_alone_and_in_a_pipeline(spark, tmp_dir, kind):
    df = fleet(spark)
    estimator = detector.AnomalyDetector(sensors=S, kind=kind, trees=15, samples=64)
    model = estimator.fit(df)
    model.write().overwrite().save(f"{tmp_dir}/model")
    again = detector.AnomalyDetectorModel.load(f"{tmp_dir}/model")
    assert scores(model, df) == scores(again, df)
    assert again.scores.count() == df.count() and again.getOrDefault("sensors") == S
    whole = Pipeline(stages=[estimator]).fit(df)
    whole.write().overwrite().save(f"{tmp_dir}/pipeline")
    assert scores(PipelineModel.load(f"{tmp_dir}/pipeline"), df) == scores(whole, df)
    values = [s for _, _, s, _, _ in scores(model, df)]
    threshold = model.getOrDefault("threshold")
    assert threshold == pytest.approx(np.quantile(values, 0.975), abs=1e-12)
    assert [e for *_, e, _ in scores(model, df)] == [v > threshold for v in values]


def test_statistical_scores_are_the_rms_of_scaled_sensors(spark):
    df = fleet(spark)
    x = df.orderBy("unit_id", "cycle").select(*S).toPandas().to_numpy()
    scale = x.std(axis=0)
    scale[scale == 0] = 1
    expected = np.sqrt((((x - x.mean(axis=0)) / scale) ** 2).mean(axis=1))
    got = [s for _, _, s, _, _ in scores(detector.AnomalyDetector(sensors=S).fit(df), df)]
    assert np.allclose(got, expected)


def test_observations_with_missing_sensors_are_refused_and_an_empty_reference_fails(spark):
    df = fleet(spark)
    model = detector.AnomalyDetector(sensors=S).fit(df)
    odd = df.limit(4).withColumn("a", F.when(F.col("cycle") % 2 == 0, F.col("a"))).withColumn("b", F.when(F.col("cycle") == 1, float("nan")).otherwise(F.col("b")))
    good, bad = detector.score_observations(model, odd)
    assert good.count() + bad.count() == 4
    assert good.where("score IS NULL OR isnan(score)").isEmpty() and bad.where("a IS NOT NULL AND NOT isnan(b)").isEmpty()
    with pytest.raises(ValueError, match="no row"):
        detector.AnomalyDetector(sensors=S).fit(df.limit(0))


def test_faulty_units_get_no_status_and_short_ones_no_alert(spark):
    df = fleet(spark)
    model = detector.AnomalyDetector(sensors=S).fit(df)
    loud = F.col("unit_id").isin(0, 1, 2) & (F.col("cycle") > 36)
    rows = df.withColumn("a", F.when(loud, 9.0).otherwise(F.col("a")))
    rows = rows.where("unit_id <> 1 OR cycle <> 20")                                      # a gap
    rows = rows.unionByName(rows.where("unit_id = 3 AND cycle = 5").withColumn("arrival", F.lit(99).cast("long")))  # a repeat
    rows = rows.withColumn("b", F.when((F.col("unit_id") == 4) & (F.col("cycle") == 2), None).otherwise(F.col("b")))  # a missing value
    rows = rows.where("unit_id <> 5 OR cycle <= 3")                                       # a short history
    got = {r.unit_id: r for r in detector.alert_status(model, rows, top_n=1).collect()}
    assert set(got) == {0, 2, 5}
    assert got[0].alert_active and got[2].alert_active and got[0].recent_exceedance_pattern.endswith("T,T,T,T")
    assert got[0].top_sensor_deviations.startswith("a:") and got[0].history_cycle_count == 40
    assert not got[5].alert_active and got[5].persistence_status == "insufficient_history" and got[5].recent_window_size == 3
