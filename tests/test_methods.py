"""p-values, dealt folds, keyed permutations, stored order, calibration tables and split studies against brute force."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import functions as F

from wearline.functions import special
from wearline.operators import models, splits, studies
from wearline.sources import artifacts


# A22 -------------------------------------------------------------------------

def series_p(t, df):
    """Two-sided p of integer degrees by the finite series."""
    theta = math.atan(abs(t) / math.sqrt(df))
    c2 = math.cos(theta) ** 2
    term, total = 1.0, 0.0
    if df % 2 == 0:
        for k in range(df // 2):
            total += term
            term *= c2 * (2 * k + 1) / (2 * k + 2)
        return 1 - math.sin(theta) * total
    for k in range((df - 1) // 2):
        total += term
        term *= c2 * (2 * k + 2) / (2 * k + 3)
    return 1 - 2 / math.pi * (theta + math.sin(theta) * math.cos(theta) * total)


def test_p_values_of_both_signs(spark):
    cases = [(t, df) for df in (1, 2, 3, 4, 7, 30, 101, 600, 5001) for t in (-3.1, -1.0, -1e-3, 0.0, 0.4, 1.96, 4.0)]
    got = spark.createDataFrame([(float(t), float(d)) for t, d in cases], "t double, d double").select(special.t_p_value(F.col("t"), F.col("d"))).collect()
    assert max(abs(r[0] - series_p(t, d)) for r, (t, d) in zip(got, cases, strict=True)) < 1e-11


def test_p_value_golden_and_edges(spark):
    rows = [(1.0, 1.0), (-1.0, 1.0), (2.0, 2.0), (0.0, 5.0), (float("inf"), 5.0), (1.0, 0.0), (None, 3.0), (40.0, 60_000.0), (1.959963984540054, 1e9)]
    got = [r[0] for r in spark.createDataFrame(rows, "t double, d double").select(special.t_p_value(F.col("t"), F.col("d"))).collect()]
    assert got[:2] == [pytest.approx(0.5, abs=1e-12)] * 2
    assert got[2] == pytest.approx(1 - 2 / math.sqrt(6), abs=1e-12) and got[3] == pytest.approx(1, abs=1e-12)
    assert got[4] == 0 and got[5] is None and got[6] is None and 0 <= got[7] < 1e-100
    assert got[8] == pytest.approx(0.05, abs=1e-8)


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 171.0, 5e4, 1e9]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(special.log_gamma(F.col("x"))).collect()
    assert all(r[0] == pytest.approx(math.lgamma(x), rel=1e-13, abs=1e-13) for r, x in zip(got, xs, strict=True))


# R3 --------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(12))
def test_dealt_sizes_equal_greedy_dealing(seed):
    rng = random.Random(seed)
    k = rng.choice([1, 2, 3, 5])
    counts = {rng.randrange(1, 40): rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))}
    load, expected = [0] * k, {}
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            j = load.index(min(load))
            load[j] += size
            expected[size, j] = expected.get((size, j), 0) + 1
    dealt = splits.deal_sizes(list(counts.items()), k)
    assert {(s, j): last - first + 1 for s, j, first, last in dealt} == expected
    assert max(load) - min(load) <= max(counts)
    for size, n in counts.items():
        own = sorted((first, last) for s, _, first, last in dealt if s == size)
        assert [x for a, b in own for x in range(a, b + 1)] == list(range(1, n + 1))


def test_balanced_folds_keep_units_whole(spark):
    rows = [(u, i) for u in range(60) for i in range(1 + (u * 7) % 23)]
    out = splits.balanced_group_kfold(spark.createDataFrame(rows, "unit_id long, i long"), "unit_id", 4).toPandas()
    assert sorted(out.unit_id) == list(range(60))
    per = out.groupby("fold")["rows"].sum()
    assert per.max() - per.min() <= 23 and per.sum() == len(rows)


# M20 -------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 100, 1023, 4097])
def test_keyed_positions_are_bijections(spark, n):
    df = spark.range(n).select(*[models.permuted_position(F.col("id"), n, k).alias(k) for k in ("a", "b")])
    a, b = zip(*[(r.a, r.b) for r in df.collect()])
    assert sorted(a) == sorted(b) == list(range(n))
    if n >= 100:
        assert a != b and sum(i == p for i, p in enumerate(a)) < n / 10


def test_permutation_importance_equals_arithmetic_on_a_linear_model(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3))
    y = x @ [2.0, -1.0, 0.0] + rng.normal(size=500)
    df = spark.createDataFrame([(i % 9, i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))],
                               "unit_id long, cycle long, a double, b double, c double, y double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"),
                             LinearRegression(featuresCol="features", labelCol="y")]).fit(df)
    got = {r.feature: (r.rmse_increase_mean, r.rmse_increase_std) for r in
           models.permutation_importance(model, df, ["a", "b", "c"], "y", ["unit_id", "cycle"], repeats=2, seed=5).collect()}
    order = sorted(range(500), key=lambda i: (i % 9, i))
    x, y = x[order], y[order]
    w, c = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
    rmse = lambda m: float(np.sqrt(np.mean((m @ w + c - y) ** 2)))
    for j, name in enumerate("abc"):
        increases = []
        for r in range(2):
            p = [q[0] for q in spark.range(500).select(models.permuted_position(F.col("id"), 500, f"5:{r}")).collect()]
            changed = x.copy()
            changed[:, j] = x[p, j]
            increases.append(rmse(changed))
        assert got[name] == (pytest.approx(np.mean(increases) - rmse(x)), pytest.approx(np.std(increases), abs=1e-12))


def test_permutation_plan_joins_on_positions_without_a_product(spark):
    df = spark.range(50).select(F.col("id").alias("unit_id"), F.col("id").alias("cycle"), F.rand(1).alias("a"), F.rand(2).alias("y"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="features"), LinearRegression(featuresCol="features", labelCol="y")]).fit(df)
    plan = models.permutation_importance(model, df, ["a"], "y", ["unit_id", "cycle"], 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Cross") + plan.count("Join Inner\n") <= 1  # the one-row base value


# S11 -------------------------------------------------------------------------

def stored(spark, values, path, files):
    cuts = np.linspace(0, len(values), files + 1).astype(int)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        import pandas as pd
        os.makedirs(path, exist_ok=True)
        pd.DataFrame({"score": values[a:b]}).astype({"score": "float64"}).to_parquet(os.path.join(path, f"part-{i:05d}.parquet"), index=False)
    return path


def test_swapped_pairs_are_found_wherever_borders_lie(spark, tmp_dir):
    values = [i / 7 for i in range(1000)]
    assert artifacts.order_breaks(spark, stored(spark, values, f"{tmp_dir}/ok", 4), chunk=64).first()[0] == 0
    for at in (10, 63, 127, 249, 499, 998):  # inside a chunk, across chunks, across files
        swapped = list(values)
        swapped[at], swapped[at + 1] = swapped[at + 1], swapped[at]
        path = stored(spark, swapped, f"{tmp_dir}/swap{at}", 4)
        assert artifacts.order_breaks(spark, path, chunk=64).first()[0] == 1, at
    ties = stored(spark, [1.0, 1.0, None, 1.0, 2.0], f"{tmp_dir}/ties", 2)
    assert artifacts.order_breaks(spark, ties).first()[0] == 0
    assert artifacts.order_breaks(spark, stored(spark, [], f"{tmp_dir}/none", 1)).first()[0] == 0


def test_saved_reference_scores_are_in_order_and_checked(spark, tmp_dir):
    nodes = spark.createDataFrame([(0, 0, -1, 0.0, -1, -1, True, 0, 1)], "tree long, node long, feature int, threshold double, left long, right long, leaf boolean, depth int, size long")
    scores = spark.range(5000).select(F.rand(3).alias("score")).repartition(5)
    artifacts.save_forest(nodes, scores, {}, f"{tmp_dir}/forest")
    meta = spark.createDataFrame([{"model_name": "m", "model_version": "1"}], artifacts.METADATA_SCHEMA)
    rules = lambda path: {r.rule: r.violated for r in artifacts.metadata_violations(meta, kind="rul", scores_path=path).collect()}
    assert rules(f"{tmp_dir}/forest/reference_scores")["reference_ascending"] is False
    scores.write.parquet(f"{tmp_dir}/loose")
    assert rules(f"{tmp_dir}/loose")["reference_ascending"] is True


# M12, S9 ---------------------------------------------------------------------

@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_calibrated_ensembles_survive_saving(spark, tmp_dir, method):
    rng = np.random.default_rng(1)
    rows = [(float(v), int(rng.random() < 1 / (1 + math.exp(-v))), i % 2) for i, v in enumerate(rng.normal(size=400))]
    df = spark.createDataFrame(rows, "v double, failure int, fold int")
    base = lambda: Pipeline(stages=[VectorAssembler(inputCols=["v"], outputCol="features"), LogisticRegression(featuresCol="features", labelCol="failure")])
    cal = models.CalibratedClassifier(base, method, 2).fit(df)
    cal.save(f"{tmp_dir}/cal")
    again = models.CalibratedClassifier.load(f"{tmp_dir}/cal")
    scores = lambda c: [r[1] for r in sorted(c.transform(df, ["v"]).collect())]
    assert scores(cal) == scores(again) and all(0 <= s <= 1 for s in scores(cal))


def test_a_hundred_thousand_isotonic_steps(spark):
    n = 100_000
    table = spark.range(n).select(F.col("id").cast("double").alias("x"), (F.col("id") / n).alias("y"))
    steps = IsotonicRegression(featuresCol="f", labelCol="y").fit(VectorAssembler(inputCols=["x"], outputCol="f").transform(table))
    assert len(steps.boundaries) == n
    train = spark.createDataFrame([(0.0, 0), (1.0, 1), (2.0, 0), (3.0, 1)], "v double, failure int")
    model = Pipeline(stages=[VectorAssembler(inputCols=["v"], outputCol="features"), LogisticRegression(featuresCol="features", labelCol="failure")]).fit(train)
    cal = models.CalibratedClassifier(None, "isotonic", 1)
    cal.members = [(model, steps)]
    df = spark.createDataFrame([(-5.0,), (0.0,), (2.5,), (1e6,)], "v double")
    got = sorted((r.v, r.p) for r in cal.transform(df, ["v"], "p").collect())
    margins = [float(model.stages[-1].coefficients[0]) * v + float(model.stages[-1].intercept) for v, _ in got]
    expected = np.interp(margins, np.arange(n), np.arange(n) / n)
    assert np.allclose([p for _, p in got], expected)


# M23 -------------------------------------------------------------------------

def fleet(spark, units=20, cycles=60):
    rng = np.random.default_rng(7)
    rows = [(u, c, cycles - c, float(rng.normal()), float(rng.normal() + (6 if cycles - c <= 5 else 0))) for u in range(units) for c in range(1, cycles + 1)]
    df = spark.createDataFrame(rows, "unit_id long, cycle long, raw_rul long, a double, b double")
    return df.join(studies.held_bits(df.select("unit_id").distinct(), [1, 2, 3]), "unit_id").cache()


def test_held_bits_hold_out_the_share_and_conditional_quantiles_are_exact(spark):
    df = fleet(spark)
    pdf = df.toPandas()
    per = pdf.drop_duplicates("unit_id").held_bits
    assert [int(((per.to_numpy() >> b) & 1).sum()) for b in range(3)] == [4, 4, 4]
    pairs = studies.pairs_of([1, 2, 3], [10, 30])
    values = [F.when(p.reference(), F.col("a")) for p in pairs] + [F.lit(None).cast("double"), F.lit(2.0), F.when(F.col("cycle") == 1, F.col("b"))]
    for q in (0.0, 0.5, 0.975, 1.0):
        got = studies.conditional_quantile(df, values, q)
        keep = [pdf[((pdf.held_bits.to_numpy() >> p.bit) & 1 == 0) & (pdf.raw_rul > p.cutoff)].a for p in pairs]
        assert got[:6] == pytest.approx([np.quantile(x, q) for x in keep], abs=1e-12)
        assert got[6] is None and got[7] == 2.0 and got[8] == pytest.approx(np.quantile(pdf[pdf.cycle == 1].b, q))


def test_forest_study_has_one_row_per_pair_and_sees_late_life(spark):
    df = fleet(spark)
    pairs = studies.pairs_of([1, 2, 3], [10, 30])
    nodes, psi = studies.grow_forests(df, ["a", "b"], pairs, 20, 32)
    assert set(psi.values()) == {32}
    assert {(r.pair, r.trees) for r in nodes.groupBy("pair").agg(F.count_distinct("tree").alias("trees")).collect()} == {(k, 20) for k in range(6)}
    assert nodes.where("node = 0 AND size <> 32").isEmpty()
    scores = studies.forest_scores(df, nodes, psi, ["a", "b"], pairs)
    scored = df.select("unit_id", "raw_rul", "held_bits", scores.alias("scores"))
    needed = F.array(*[p.held() | (F.col("raw_rul") > p.cutoff) for p in pairs])
    wrong = scored.where(F.exists(F.arrays_zip(needed.alias("n"), F.col("scores").alias("s")), lambda x: x["n"] != x["s"].isNotNull()))
    assert wrong.isEmpty()
    table = studies.evaluate(scored, pairs).toPandas()
    assert len(table) == 6 and set(table.held_out_units) == {4} and (table.threshold.between(0, 1)).all()
    assert (table.spearman < 0).all() and table.critical_alert_pct.mean() > 1.5 * 2.5


# M17, M18 --------------------------------------------------------------------

def test_candidates_score_every_row_once_on_shared_folds(spark):
    from conftest import SF_SMALL
    from wearline.operators import selection
    from wearline.sources import tables

    o = tables.obs(spark, SF_SMALL).select("unit_id", "cycle", "type", *selection.RAW_NUMERIC, "failure")
    folded = splits.stratified_kfold(o, ["unit_id", "cycle"], "failure", 2, 1).cache()
    both = [selection.Candidate("plain", "logistic", tuple(selection.RAW_NUMERIC)), selection.Candidate("balanced", "logistic", balanced=True)]
    oof = selection.out_of_fold(folded, both).cache()
    per = {(r.candidate, r.fold): r["count"] for r in oof.groupBy("candidate", "fold").count().collect()}
    size = {r.fold: r["count"] for r in folded.groupBy("fold").count().collect()}
    assert per == {(c.name, f): n for c in both for f, n in size.items()}
    table = selection.compare(folded, both).toPandas().set_index("candidate")
    assert list(table.loc[["plain", "balanced"], "numeric_features"]) == [5, 8] and (table.rows == o.count()).all()
    assert table.loc["balanced", "recall_mean"] > table.loc["plain", "recall_mean"] and table.filter(like="_mean").ge(0).all().all()
    assert [c.numeric[5:] for c in selection.ablation()] == [(), ("temperature_difference",), ("power_proxy",), ("strain_proxy",), tuple(selection.ENGINEERED)]


def test_a_classifier_of_other_classes_is_refused(spark):
    df = spark.createDataFrame([(float(i), i % 3) for i in range(30)], "v double, failure int")
    model = Pipeline(stages=[VectorAssembler(inputCols=["v"], outputCol="features"), LogisticRegression(featuresCol="features", labelCol="failure")]).fit(df)
    with pytest.raises(ValueError, match="classes"):
        models.require_two_classes(model)


def test_large_fits_run_one_at_a_time(spark, monkeypatch):
    from wearline.operators import selection
    assert [selection.side_by_side(n) for n in (0, 1000, 1_000_000, 1_500_000, 36_000_000)] == [4, 4, 4, 2, 1]
    seen = []
    monkeypatch.setattr(selection, "ROWS_AT_ONCE", 4)
    monkeypatch.setattr(selection, "ThreadPoolExecutor", lambda n: seen.append(n) or (_ for _ in ()).throw(StopIteration()))
    with pytest.raises(StopIteration):
        selection.compare(spark.range(4).selectExpr("id % 2 AS fold", "1 AS failure"), selection.classifiers(1))
    assert seen == [1]
