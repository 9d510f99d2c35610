"""Spearman by ranges against ranks in pandas: ties, nulls, groups, constants, many batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearline.operators import stats


def _expected(p):
    rank = lambda c: p[c].astype(float).fillna(-np.inf).rank()  # noqa: E731  nulls come first and tie
    rx, ry = rank("x"), rank("y")
    return None if rx.nunique() < 2 or ry.nunique() < 2 else float(np.corrcoef(rx, ry)[0, 1])


def _rows():
    rng = np.random.default_rng(5)
    p = pd.DataFrame({"g": rng.choice(["a", "b", "c", None], 3000), "x": rng.normal(size=3000).round(1), "y": rng.integers(0, 40, 3000)})
    p["x"] = (p["x"] + p["y"] / 20).where(rng.random(3000) > 0.02)
    p = pd.concat([p, pd.DataFrame({"g": ["one"], "x": [1.0], "y": [2]}), pd.DataFrame({"g": "flat", "x": 3.0, "y": range(5)}),
                   pd.DataFrame({"g": "level", "x": np.arange(5.0), "y": 7})], ignore_index=True)
    return p.astype({"y": "int64"})


@pytest.mark.parametrize("few", [0, 500_000])
@pytest.mark.parametrize("batch", ["7", "10000"])
def test_spearman_by_group_and_overall(spark, monkeypatch, few, batch):
    monkeypatch.setattr(stats, "FEW_RANKS", few)
    p = _rows()
    df = spark.createDataFrame([(None if g is None or g != g else g, None if x != x else float(x), int(y)) for g, x, y in p.itertuples(index=False)],
                               "g string, x double, y long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.g: (r.spearman, r.n) for r in stats.spearman(df, "x", "y", ["g"]).collect()}
        whole, none = stats.spearman(df, "x", "y").first(), stats.spearman(df.where("false"), "x", "y").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g, part in p.fillna({"g": "-"}).groupby("g"):
        value, n = got.pop(None if g == "-" else g)
        assert n == len(part) and (value is None) == (_expected(part) is None) and (value is None or abs(value - _expected(part)) < 1e-12)
    assert not got and whole.n == len(p) and abs(whole.spearman - _expected(p)) < 1e-12
    assert [(r.spearman, r.n) for r in none] == [(None, 0)]


def test_rows_move_once_when_y_has_few_values(spark):
    """One exchange carries the rows (before: one each for grouping, ranges, windows and both sides of the join back)."""
    df = spark.range(2000).select(F.rand(1).alias("x"), (F.col("id") % 9).alias("y"))
    plan = stats.spearman(df, "x", "y")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("rangepartitioning(_x") == 1 and "hashpartitioning(_x" not in plan
