"""Distributed ordered helpers vs brute force."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wearline.operators import ordered


def _values(seed=7, n=3000):
    rng = np.random.default_rng(seed)
    v = np.round(rng.exponential(3.0, n), 1)  # many ties, skewed
    v[: n // 3] = 0.5  # one value holds a third of all rows
    g = rng.integers(0, 4, n)
    return pd.DataFrame({"g": g.astype(int), "v": v})


def test_prefix_sums_match_cumsum(spark):
    pdf = _values().groupby(["g", "v"], as_index=False).size().rename(columns={"size": "c"})
    df = spark.createDataFrame(pdf)
    out = ordered.prefix_sums(df, "v", ["c"], ["g"], buckets=6).toPandas().sort_values(["g", "v"])
    exp = pdf.sort_values(["g", "v"]).groupby("g")["c"].cumsum()
    assert out["cum_c"].tolist() == exp.tolist()
    desc = ordered.prefix_sums(df, "v", ["c"], ["g"], descending=True, buckets=6).toPandas().sort_values(["g", "v"])
    exp_d = pdf.sort_values(["g", "v"], ascending=[True, False]).groupby("g")["c"].cumsum()
    assert desc.set_index(["g", "v"])["cum_c"].sort_index().tolist() == \
        pdf.assign(x=exp_d).set_index(["g", "v"])["x"].sort_index().tolist()


def test_average_rank_matches_pandas(spark):
    pdf = _values().reset_index().rename(columns={"index": "id"})
    out = ordered.average_rank(spark.createDataFrame(pdf), "v", ["g"], "r", buckets=5).toPandas().sort_values("id")
    exp = pdf.groupby("g")["v"].rank(method="average")
    assert np.allclose(out["r"].to_numpy(), exp.sort_index().to_numpy())


def test_exact_quantiles_match_numpy(spark):
    pdf = _values()
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.975, 1.0]
    glob = ordered.exact_quantiles(spark.createDataFrame(pdf), "v", probs, buckets=5).toPandas().sort_values("q")
    assert np.allclose(glob["value"].to_numpy(), np.quantile(pdf["v"].to_numpy(), probs))
    grp = ordered.exact_quantiles(spark.createDataFrame(pdf), "v", [0.5, 0.9], ["g"], buckets=5).toPandas()
    for (g, q), val in grp.set_index(["g", "q"])["value"].items():
        assert np.isclose(val, np.quantile(pdf.loc[pdf.g == g, "v"].to_numpy(), q))


def test_sequence_number_exact(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"u": rng.integers(0, 3, 2000), "day": rng.integers(0, 50, 2000), "k": rng.permutation(2000)})
    df = spark.createDataFrame(pdf)
    out = ordered.sequence_number(df, ["u"], ["day", "k"], F.col("day"), "seq").toPandas()
    ordered_pdf = pdf.sort_values(["u", "day", "k"])
    expected = dict(zip(ordered_pdf["k"], ordered_pdf.groupby("u").cumcount() + 1))
    assert dict(zip(out["k"], out["seq"])) == expected


def test_ecdf_right_inclusive_and_clipped(spark):
    pdf = _values()
    ref = spark.createDataFrame(pdf[["v"]])
    qs = spark.createDataFrame(pd.DataFrame({"i": range(5), "s": [-1.0, 0.5, 1.0, 3.0, 1e9]}))
    got = ordered.ecdf_percentile(qs, "s", ref, "v", "p").toPandas().sort_values("i")["p"].tolist()
    sorted_ref = np.sort(pdf["v"].to_numpy())
    exp = [100.0 * np.searchsorted(sorted_ref, s, side="right") / len(sorted_ref) for s in [-1.0, 0.5, 1.0, 3.0, 1e9]]
    assert np.allclose(got, exp)


def test_prefix_sums_keep_null_large_and_string_keys(spark):
    big = 2**60
    rows = [(None, "a", 1), (big, "b", 2), (big + 1, "c", 3), (big + 2, "d", 4), (big + 3, None, 5)]
    df = spark.createDataFrame(rows, "k long, s string, c long")
    by_id = {r.k: r.cum_c for r in ordered.prefix_sums(df, "k", ["c"], buckets=4).collect()}
    assert by_id == {None: 1, big: 3, big + 1: 6, big + 2: 10, big + 3: 15}
    by_name = {r.s: r.cum_c for r in ordered.prefix_sums(df, "s", ["c"], buckets=3).collect()}
    assert by_name == {None: 5, "a": 6, "b": 8, "c": 11, "d": 15}


def test_null_keys_and_scores_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1), ("u", None), ("u", 2)], "u string, o int")
    assert ordered.sequence_number(df, ["u"], ["o"], F.col("o"), "n").count() == 3
    q = spark.createDataFrame([(1.0,), (None,)], "s double")
    got = {r.s: r.p for r in ordered.ecdf_percentile(q, "s", spark.createDataFrame([(0.0,), (2.0,)], "v double"), "v", "p").collect()}
    assert got == {1.0: 50.0, None: None}
