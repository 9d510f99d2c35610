"""Steps whose work is to grow no faster than their input."""

from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from wearline.operators.ordered import sequence_number
from wearline.plans import REGISTRY
from wearline.plans.registry import finish, round_significant
from wearline.sources import readers, tables
from wearline.streaming.units import UnitProcessor


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_only_large_partitions_are_numbered_by_bucket(spark):
    rows = [(unit, day, day * 10 + i) for unit, n in ((1, 3), (2, 7), (None, 4)) for day in range(n) for i in range(3)]
    df = spark.createDataFrame(rows, "unit long, day int, id long")
    want = [(u, d, i, k) for u in (1, 2, None) for k, (_, d, i) in enumerate(sorted((r for r in rows if r[0] == u), key=lambda r: r[2]), 1)]
    for whole in (1, 10, 100):
        got = sequence_number(df, ["unit"], ["id"], bucket=F.col("day"), name="n", whole=whole)
        assert got.schema["n"].dataType.simpleString() == "bigint"
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_wide_results_are_rounded_as_single_values(spark):
    values = [None, 0.0, float("nan"), float("inf"), -1e300, 5e-324, 1234567.85, -12345678.5, 0.49999999999999994, 2.0 ** 53 - 1, 1 / 3]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, x double")
    plain = F.round(F.col("x") * F.pow(F.lit(10.0), F.least(F.lit(12), F.greatest(F.lit(0), F.lit(7) - F.floor(F.log10(F.abs("x")))))), 0)
    scale = F.pow(F.lit(10.0), F.least(F.lit(12), F.greatest(F.lit(0), F.lit(7) - F.floor(F.log10(F.abs("x"))))))
    special = F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf")) | (F.col("x") == 0)
    want = {r["k"]: repr(r["y"]) for r in df.select("k", F.when(special, F.col("x")).otherwise(plain / scale).alias("y")).collect()}
    wide = finish(df.select("k", *[F.col("x").alias(f"x{i}") for i in range(30)], F.lit("t").alias("t")))
    assert wide.columns == ["k", *[f"x{i}" for i in range(30)], "t"]
    for r in wide.collect():
        assert {repr(r[f"x{i}"]) for i in range(30)} == {want[r["k"]]}
    assert {r["k"]: repr(r["y"]) for r in df.select("k", round_significant(F.col("x")).alias("y")).collect()} == want
    # the rounding is written once, not once for every column
    assert _plan(wide).count("log10") == 1


def test_group_shuffle_joins_units_not_rows(spark, monkeypatch):
    rows = [(u, c) for u in [*range(10), None] for c in range(1, 4)]
    traj = spark.createDataFrame(rows, "unit_id long, cycle long")
    monkeypatch.setattr(tables, "traj", lambda *_: traj)
    got = REGISTRY["group_shuffle_membership"].build(spark, "")
    found = {r["split"]: (r["rows"], r["units"]) for r in got.collect()}
    assert sum(n for n, _ in found.values()) == len(rows)
    assert sum(u for _, u in found.values()) == 10
    assert "distinct" not in _plan(got).split("join leftsemi")[0] and "count(distinct" not in _plan(got)


def test_csv_lines_are_checked_once_for_good_rows_and_quarantine(spark, tmp_path):
    files = {"a.csv": "cycle,sensor_2\n1,5\n2,\"6\"\n3,7\n", "b.csv": "sensor_2,cycle,more\n5,1,x\n6,3,y\n7\n8,zz,\n\n", "c.csv": "cycle\n1\n"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    good, bad = readers.read_trajectory_csv(spark, str(tmp_path), required=["cycle", "sensor_2"], whole_files=True)
    base = F.regexp_extract("file", r"([^/]+)$", 1)
    assert sorted(map(tuple, good.select(base, "cycle", "sensor_2").collect())) == [("a.csv", 1, 5.0), ("a.csv", 2, 6.0), ("a.csv", 3, 7.0)]
    assert sorted(map(tuple, bad.select(base, "line", "reason").collect())) == [
        ("b.csv", 2, "cycle not consecutive"), ("b.csv", 3, "wrong number of fields"), ("b.csv", 4, "non-numeric value"),
        ("b.csv", 5, "blank row"), ("c.csv", 1, "missing header")]
    assert all("inmemoryrelation" in _plan(df) for df in (good, bad))


def test_unit_without_an_accepted_row_keeps_its_rejected_ones():
    held = []
    processor = UnitProcessor(["s"], 5, 3, None, 1 << 16)
    processor.unit = SimpleNamespace(exists=lambda: bool(held), get=lambda: held[-1], update=held.append)
    rows = pd.DataFrame({"unit_id": [7, 7], "cycle": [0, 2], "arrival": [1, 2], "exceeded": [False, True], "s": [1.0, float("nan")]})
    out = processor.advance((7,), rows)
    assert out["status"].tolist() == ["non_positive", "non_numeric"] and not held
    assert out.drop(columns=["unit_id", "cycle", "status"]).isna().all(axis=None)
    out = processor.advance((7,), rows.assign(cycle=[1, 2], s=[1.0, 3.0]))
    assert out["status"].tolist() == ["ok", "ok"] and out["s_delta_1"].tolist()[1] == 2.0 and out["recent_size"].tolist() == [1, 2]
    assert out["recent_size"].dtype == "Int64" and out["alert_active"].dtype == "boolean"
