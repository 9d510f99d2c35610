"""Chunked trailing windows equal plain per-unit windows; no look-ahead."""

from pyspark.sql import functions as F

from wearline.operators import windows
from wearline.sources import tables
from conftest import SF_SMALL

SENSORS = ["sensor_1", "sensor_4"]


def _feats(df, chunk):
    cols = {**windows.temporal_feature_columns(SENSORS),
            **windows.persistence_columns("hot"), **windows.recent_pattern_columns("hot")}
    return windows.trailing_columns(df, cols, lookback=5, chunk=chunk)


def test_halo_chunks_equal_unit_windows(spark):
    t = tables.traj(spark, SF_SMALL).select("unit_id", "cycle", *SENSORS).withColumn("hot", F.col("sensor_4") > 0.05)
    a = _feats(t, chunk=7).orderBy("unit_id", "cycle").collect()  # many chunk edges
    b = _feats(t, chunk=None).orderBy("unit_id", "cycle").collect()
    assert len(a) == len(b) == t.count()
    for x, y in zip(a, b):
        for k, v in x.asDict().items():
            w = y[k]
            assert (v == w) or (isinstance(v, float) and abs(v - w) < 1e-9), (k, v, w)


def test_future_rows_do_not_change_the_past(spark):
    t = tables.traj(spark, SF_SMALL).select("unit_id", "cycle", *SENSORS).withColumn("hot", F.lit(False))
    changed = t.withColumn("sensor_4", F.when(F.col("cycle") == 50, F.lit(1e6)).otherwise(F.col("sensor_4")))
    a = _feats(t, 16).where("cycle < 50").orderBy("unit_id", "cycle").collect()
    b = _feats(changed, 16).where("cycle < 50").orderBy("unit_id", "cycle").collect()
    assert a == b


def test_no_cross_unit_leakage(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 100.0), (2, 2, 200.0)],
                               "unit_id long, cycle long, sensor_1 double")
    out = windows.add_temporal_features(df, ["sensor_1"]).where("cycle = 1").collect()
    assert all(r.sensor_1_lag_1 is None for r in out)


def test_hot_unit_spreads_over_chunks(spark):
    """One unit with a third of all rows: its window work is split into many
    (unit, chunk) partitions and still equals the per-unit window."""
    hot = spark.range(1, 30_001).select(F.lit(0).cast("long").alias("unit_id"), F.col("id").alias("cycle"))
    cold = spark.range(0, 60_000).select((F.col("id") % 600 + 1).alias("unit_id"),
                                         (F.floor(F.col("id") / 600) + 1).cast("long").alias("cycle"))
    df = hot.unionByName(cold).withColumn("sensor_1", F.sin(F.col("cycle") * 0.7) + F.col("unit_id"))
    df = df.withColumn("sensor_4", F.cos(F.col("cycle"))).withColumn("hot", F.col("sensor_4") > 0.2)
    chunk = 4096
    spread = df.where("unit_id = 0").select(F.floor((F.col("cycle") - 1) / chunk).alias("c")).distinct().count()
    assert spread >= 7  # the hot unit's rows land in >= 7 window partitions
    a = _feats(df, chunk=chunk).where("unit_id = 0").orderBy("cycle").collect()
    b = _feats(df, chunk=None).where("unit_id = 0").orderBy("cycle").collect()
    assert len(a) == len(b) == 30_000
    for x, y in zip(a, b):
        for k, v in x.asDict().items():
            w = y[k]
            assert (v == w) or (isinstance(v, float) and abs(v - w) < 1e-9), (k, v, w)
