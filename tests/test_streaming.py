"""Structured Streaming jobs: stream results equal the batch operators."""

import os

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from wearline.operators import models, windows
from wearline.sources import tables
from wearline.streaming import monitor
from conftest import SF_SMALL

SENSORS = ["sensor_1", "sensor_4"]


def _land_files(spark, tmp_dir, extra=None):
    t = tables.traj(spark, SF_SMALL).select("unit_id", "cycle", *SENSORS).withColumn(
        "exceeded", F.col("sensor_4") > 0.06).withColumn("arrival", F.col("cycle")).toPandas()
    src = os.path.join(tmp_dir, "landing")
    os.makedirs(src)
    cuts = [0, 150, 300, 450, 10**9]
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        t[(t.cycle > lo) & (t.cycle <= hi)].to_parquet(os.path.join(src, f"part-{i:03d}.parquet"), index=False)
    if extra is not None:
        extra.to_parquet(os.path.join(src, "part-999.parquet"), index=False)
    schema = spark.read.parquet(os.path.join(src, "part-000.parquet")).schema
    return t, src, schema


def _run(spark, stream, name, tmp_dir, sink="memory", batch_fn=None):
    w = stream.writeStream.option("checkpointLocation", os.path.join(tmp_dir, f"ckpt-{name}"))
    q = (w.foreachBatch(batch_fn) if batch_fn else w.format("memory").queryName(name)).outputMode("append").start()
    q.processAllAvailable()
    q.stop()


def test_state_stream_equals_batch(spark, tmp_dir):
    t, src, schema = _land_files(spark, tmp_dir)
    stream = monitor.observation_stream(spark, src, schema)
    _run(spark, monitor.unit_state_stream(stream, SENSORS), "state_eq", tmp_dir)
    got = spark.sql("SELECT * FROM state_eq").toPandas().sort_values(["unit_id", "cycle"]).reset_index(drop=True)
    assert len(got) == len(t) and set(got.status) == {"ok"}
    batch = windows.trailing_columns(
        spark.createDataFrame(t), {**windows.temporal_feature_columns(SENSORS), **windows.persistence_columns("exceeded")},
        lookback=5).toPandas().sort_values(["unit_id", "cycle"]).reset_index(drop=True)
    for c in [f"{s}_{x}" for s in SENSORS for x in ["lag_1", "lag_5", "rolling_mean_5", "rolling_std_5", "delta_1"]]:
        a, b = got[c].astype(float), batch[c].astype(float)
        assert ((a - b).abs() < 1e-9).where(b.notna(), a.isna()).all(), c
    assert (got["alert_active"] == batch["persistent"]).all()
    assert (got["recent_count"] == batch["recent_count"]).all()


def test_rejects_out_of_order_duplicates_and_gaps(spark, tmp_dir):
    extra = pd.DataFrame({"unit_id": [0, 0, 0], "cycle": [3, 10_000, 10], "sensor_1": [1.0] * 3,
                          "sensor_4": [0.0] * 3, "exceeded": [False] * 3, "arrival": [1, 2, 3]})
    late = pd.DataFrame({"unit_id": [99_999, 99_999, 99_999], "cycle": [5, 6, 2], "sensor_1": [1.0] * 3,
                         "sensor_4": [0.0] * 3, "exceeded": [False] * 3, "arrival": [1, 2, 3]})
    extra = pd.concat([extra, late], ignore_index=True)
    t, src, schema = _land_files(spark, tmp_dir, extra.astype({"unit_id": "int64", "cycle": "int64"}))
    stream = monitor.observation_stream(spark, src, schema)
    _run(spark, monitor.unit_state_stream(stream, SENSORS), "rejects", tmp_dir)
    got = spark.sql("SELECT cycle, status FROM rejects WHERE unit_id = 0 AND status <> 'ok'").collect()
    assert {(r.cycle, r.status) for r in got} == {(3, "duplicate"), (10000, "gap"), (10, "duplicate")}
    late = spark.sql("SELECT cycle, status FROM rejects WHERE unit_id = 99999").collect()
    assert {(r.cycle, r.status) for r in late} == {(5, "ok"), (6, "ok"), (2, "out_of_order")}


def test_latest_status_sink(spark, tmp_dir):
    t, src, schema = _land_files(spark, tmp_dir)
    out = os.path.join(tmp_dir, "status")
    stream = monitor.unit_state_stream(monitor.observation_stream(spark, src, schema), SENSORS)
    _run(spark, stream, "latest", tmp_dir, batch_fn=monitor.latest_status_writer(out))
    latest = monitor.read_latest_status(spark, out).toPandas()
    exp = t.groupby("unit_id")["cycle"].max()
    assert dict(zip(latest.unit_id, latest.cycle)) == exp.to_dict()


def test_stream_scoring(spark, tmp_dir):
    o = tables.obs(spark, SF_SMALL)
    model = Pipeline(stages=models.machine_preprocessing() + [models.classifier("logistic", n_rows=6000)]).fit(o)
    src = os.path.join(tmp_dir, "obs")
    o.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(src)
    scored = monitor.score_observations(stream, model, {"medium": 0.3, "high": 0.6, "critical": 0.9})
    _run(spark, scored, "scored_stream", tmp_dir)
    res = spark.sql("SELECT * FROM scored_stream")
    assert res.count() == o.count()
    assert res.where("p_failure < 0 OR p_failure > 1").count() == 0


class _State:
    """Group state of one unit, without a stream."""

    def __init__(self):
        self.value, self.timeout, self.hasTimedOut = None, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_non_finite_rows_are_rejected_in_every_batch_shape_and_idle_state_goes():
    update = monitor._update_unit(["s"], 5, 3, idle_ms=1000)

    def run(rows):
        state = _State()
        pdf = pd.DataFrame([(i, c, v, False) for i, (c, v) in enumerate(rows)], columns=["arrival", "cycle", "s", "exceeded"])
        out = pd.concat(list(update((7,), iter([pdf]), state)))
        return out.set_index(["cycle", "status"])["s_rolling_mean_5"].dropna().to_dict(), list(out["status"]), state

    clean, status, state = run([(1, 1.0), (2, float("nan")), (2, 3.0)])
    assert clean == {(1, "ok"): 1.0, (2, "ok"): 2.0} and status == ["ok", "non_numeric", "ok"]
    mixed, status, _ = run([(1, 1.0), (2, float("nan")), (1, 5.0), (2, 3.0)])
    assert mixed == clean and status == ["ok", "non_numeric", "duplicate", "ok"]
    assert state.timeout == 1000
    state.hasTimedOut = True
    assert list(update((7,), iter([]), state)) == [] and not state.exists
