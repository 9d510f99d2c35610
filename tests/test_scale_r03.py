"""Findings F11, F20, F21, F24 of round 3: what is fitted, asked and stored, on rows of the tests' own."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import Window
from pyspark.sql import functions as F

from wearline.operators import models, splits, validate
from wearline.plans import anomaly, anomaly_eval
from wearline.sources import tables


def observations(spark, n=1200):
    i = F.col("id")
    rows = spark.range(n).select(
        i.alias("unit_id"), F.element_at(F.array(F.lit("L"), F.lit("M"), F.lit("H")), (i % 3 + 1).cast("int")).alias("type"),
        (F.lit(290.0) + i % 4).alias("air_temperature"), (F.lit(300.0) + i % 3).alias("process_temperature"),
        (F.lit(1000.0) + i % 5 * 10.0).alias("rotational_speed"), (i % 6 * 1.0).alias("torque"), (i % 4 * 30.0).alias("tool_wear"),
        ((i % 6) * (i % 4) + (i % 5) > 12).cast("int").alias("failure"))
    return rows


def test_boosting_goes_over_cells_and_gives_the_model_of_the_rows(spark, monkeypatch):
    o, seen, fit = observations(spark).cache(), [], GBTClassifier._fit_java
    plain = Pipeline(stages=models.machine_preprocessing() + [GBTClassifier(
        labelCol="failure", featuresCol="features", maxIter=3, maxDepth=3, stepSize=0.1, seed=42)]).fit(o)

    def counted(self, dataset):
        seen.append(dataset.count())
        return fit(self, dataset)

    monkeypatch.setattr(GBTClassifier, "_fit_java", counted)
    ours = Pipeline(stages=models.machine_preprocessing(binned=True) + [models.classifier("boosting").setMaxIter(3)]).fit(o)
    assert seen == [60]  # 1200 rows: 60 kinds
    p = lambda m: {r.unit_id: r.p_failure for r in models.positive_probability(m.transform(o)).collect()}
    assert p(ours) == pytest.approx(p(plain))


def test_bins_are_cut_midway_and_a_cut_belongs_to_the_lower_bin(spark):
    assert models.bin_cuts([1.0, 1.0, 2.0, 4.0], 32) == [1.5, 3.0]
    assert models.bin_cuts([float(x) for x in range(8)], 4) == [1.5, 3.5, 5.5]
    assert models.bin_cuts([5.0] * 9, 4) == []
    df = spark.createDataFrame([(1.0,), (2.0,), (1.5,), (9.0,)], "x double")
    got = models.FeatureBinsModel(inputCols=["x"], cuts=[[1.5, 3.0]]).transform(df).collect()
    assert [r.binned_x for r in got] == [0.0, 1.0, 0.0, 2.0]


def test_holdout_ranks_a_share_of_the_rows(spark, monkeypatch):
    o = observations(spark).withColumn("failure", F.when(F.col("unit_id") % 100 != 7, F.col("failure")))
    o = o.select(F.when(F.col("unit_id") % 50 != 3, F.col("unit_id")).alias("unit_id"), "failure")
    o = o.unionAll(o.limit(40))
    ranked, sums = [], splits.prefix_sums

    def counted(df, *args, **kwargs):
        ranked.append(df.count())
        return sums(df, *args, **kwargs)

    monkeypatch.setattr(splits, "prefix_sums", counted)
    monkeypatch.setattr(splits, "COARSE_BITS", 6)
    got = splits.stratified_holdout(o, ["unit_id"], "failure", 0.2, 42)
    tuples = o.where("failure IS NOT NULL").groupBy("failure", "unit_id").count().withColumn("_h", splits.hash_key(["unit_id"], 42))
    order = Window.partitionBy("failure").orderBy("_h", "unit_id").rowsBetween(Window.unboundedPreceding, 0)
    want = tuples.withColumn("_cum", F.sum("count").over(order)).withColumn("_n", F.sum("count").over(Window.partitionBy("failure"))).select(
        "unit_id", "failure", F.when(F.col("_cum") <= F.ceil(F.col("_n") * 0.2), "test").otherwise("train").alias("split"), "count")
    assert sorted(got.groupBy(*got.columns).count().collect(), key=str) == sorted(want.collect(), key=str)
    assert ranked[-1] < 120  # of 1200 keys


def test_gate_moves_rows_once_and_finds_duplicates_apart(spark):
    rows = [("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 1.0), ("b", 2, 2.0), ("b", 3, 1.0), ("c", 1, None), ("c", 2, 1.0)]
    df = spark.createDataFrame(rows, "k string, arrival long, cycle double").withColumns(
        {"key": F.col("k"), "ts": F.timestamp_seconds("arrival"), "x": F.lit(1.0)})
    out = validate.trajectory_violations(df, "key", "k", "cycle", "ts", ["x"])
    got = {r.key: (r.duplicate_cycle, r.not_increasing, r.unit_not_unique) for r in out.collect()}
    assert got == {"a": (False, False, False), "b": (True, True, False), "c": (True, False, False)}
    mixed = validate.trajectory_violations(df.withColumn("key", F.lit("all")), "key", "k", "cycle", "ts", ["x"]).first()
    assert mixed.unit_not_unique
    small = out._jdf.queryExecution().executedPlan().toString().split("Union")[-1].split("LeftSemi")[0]
    assert "Expand" not in small


def test_validated_fleet_asks_the_gate_once(spark, monkeypatch, tmp_dir):
    n, asked, gate = 200, [], validate.trajectory_violations
    spark.range(3 * n).select(
        *[(F.col("id") % 3).alias("l_suppkey"), F.timestamp_seconds(F.col("id") * 86400).alias("l_shipdate"), F.col("id").alias("l_orderkey")],
        F.lit(1).alias("l_linenumber"), F.col("id").alias("l_partkey"), (F.col("id") % 7 + 1.0).alias("l_quantity"),
        (F.col("id") % 91 * 10.0).alias("l_extendedprice"), F.lit(0.01).alias("l_discount"), (F.col("id") % 5 / 100).alias("l_tax"),
        F.lit("N").alias("l_returnflag")).write.parquet(f"{tmp_dir}/lineitem.parquet")
    monkeypatch.setattr(tables, "_VIEWS", {})
    monkeypatch.setattr(validate, "trajectory_violations", lambda *a, **b: asked.append(1) or gate(*a, **b))
    assert anomaly.validated_fleet_alert(spark, tmp_dir).count() == 3
    assert len(asked) == 1
    # stored are the rows and the scaler, not z values; policies of the units shown only
    assert anomaly_eval.top_rows_sensor_profile(spark, tmp_dir).count() == 5
    assert anomaly_eval.lifecycle_inference(spark, tmp_dir).count() == 4
    stored = {k[2]: v for k, v in tables._VIEWS.items()}
    assert "policies" not in stored
    assert not [c for v in stored.values() for c in v.columns if c.startswith("z_")]
