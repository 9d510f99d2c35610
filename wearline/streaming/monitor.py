"""Structured Streaming jobs.

The request/response path of the reference (callers resend the whole
history) becomes a stream of observations keyed by unit:

* W1 :func:`score_observations` - stateless scoring of each micro-batch.
* W2-W4 :func:`unit_state_stream` - ``applyInPandasWithState`` per unit:
  a ring buffer of the last rows gives the temporal features (lag 1 / 5,
  rolling mean / std over 5, delta) and the 3-of-5 persistence alert exactly
  as the batch windows do.  Cycles must arrive in order without gaps or
  duplicates (the trajectory contract): anything else is emitted with a
  reject status and never enters the state (no reordering, no padding).
* W5 :func:`latest_status_writer` - ``foreachBatch`` merge of the newest row
  per unit into a status table (latest cycle wins).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import contracts as C
from ..functions import columns as X
from ..session import ship_package

BUFFER = 6  # rows needed for lag_5


def observation_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """Parquet files landing in ``path`` as a stream (one or more files per
    micro-batch)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def score_observations(stream: DataFrame, model, thresholds: dict) -> DataFrame:
    """Model -> probability -> 0-100 score, risk category, action."""
    from ..operators.models import positive_probability
    p = positive_probability(model.transform(stream))
    cat = X.risk_category("p_failure", thresholds["medium"], thresholds["high"], thresholds["critical"])
    return p.select("unit_id", "cycle", "p_failure", X.score_0_100("p_failure").alias("risk_score"),
                    cat.alias("risk_category"), X.recommended_action(cat).alias("recommended_action"))


def _output_schema(sensors: Sequence[str]) -> T.StructType:
    fields = [T.StructField("unit_id", T.LongType()), T.StructField("cycle", T.LongType()),
              T.StructField("status", T.StringType())]
    for s in sensors:
        fields += [T.StructField(f"{s}_{x}", T.DoubleType()) for x in C.TEMPORAL_SUFFIXES]
    fields += [T.StructField("exceeded", T.BooleanType()), T.StructField("recent_count", T.LongType()),
               T.StructField("recent_size", T.LongType()), T.StructField("alert_active", T.BooleanType())]
    return T.StructType(fields)


STATE_SCHEMA = T.StructType([
    T.StructField("first", T.LongType()),
    T.StructField("cycles", T.ArrayType(T.LongType())),
    T.StructField("values", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("flags", T.ArrayType(T.BooleanType())),
])


def _fast_rows(key, cycles, values, flags, pdf, sensors, window, required):
    """Vectorised update when the batch continues the unit's contiguous cycles.

    Windows end at every new row and reach back into the carried buffer
    (the last ``BUFFER`` accepted rows); statistics match the row loop.
    """
    from numpy.lib.stride_tricks import sliding_window_view
    k = len(sensors)
    new_v = pdf[list(sensors)].to_numpy(dtype=float)
    new_f = pdf["exceeded"].to_numpy(dtype=bool)
    buf_v = np.array(values, dtype=float).reshape(-1, k)
    all_v = np.vstack([buf_v, new_v])
    all_f = np.concatenate([np.array(flags, dtype=bool), new_f])
    b, m = len(buf_v), len(all_v)
    idx = np.arange(b, m)
    pad = np.vstack([np.full((4, k), np.nan), all_v])
    win = sliding_window_view(pad, 5, axis=0)[idx]          # (n, k, 5)
    mean = np.nanmean(win, axis=2)
    std = np.nanstd(win, axis=2)
    lag1 = np.where((idx >= 1)[:, None], all_v[np.maximum(idx - 1, 0)], np.nan)
    lag5 = np.where((idx >= 5)[:, None], all_v[np.maximum(idx - 5, 0)], np.nan)
    fw = sliding_window_view(np.concatenate([np.zeros(window - 1), all_f.astype(np.int64)]), window)[idx]
    cw = sliding_window_view(np.concatenate([np.zeros(window - 1), np.ones(m, dtype=np.int64)]), window)[idx]
    out = {"unit_id": np.full(len(idx), int(key[0]), dtype=np.int64), "cycle": pdf["cycle"].to_numpy(np.int64),
           "status": "ok"}
    for j, s in enumerate(sensors):
        out[f"{s}_lag_1"] = lag1[:, j]
        out[f"{s}_lag_5"] = lag5[:, j]
        out[f"{s}_rolling_mean_5"] = mean[:, j]
        out[f"{s}_rolling_std_5"] = std[:, j]
        out[f"{s}_delta_1"] = all_v[idx, j] - lag1[:, j]
    out["exceeded"] = all_f[idx]
    out["recent_count"] = fw.sum(axis=1)
    out["recent_size"] = cw.sum(axis=1)
    out["alert_active"] = (out["recent_size"] >= window) & (out["recent_count"] >= required)
    new_cycles = list(cycles) + [int(c) for c in pdf["cycle"]]
    keep = slice(-BUFFER, None)
    return (pd.DataFrame(out), new_cycles[keep], [[float(x) for x in r] for r in all_v[keep]],
            [bool(x) for x in all_f[keep]])


def _update_unit(sensors: Sequence[str], window: int, required: int, idle_ms: int | None = None):
    def fn(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        if state.exists:
            first, cycles, values, flags = state.get
            cycles, values, flags = list(cycles), [list(v) for v in values], list(flags)
        else:
            first, cycles, values, flags = None, [], [], []
        out = []
        pdf = pd.concat(list(batches), ignore_index=True)
        pdf = pdf.sort_values("arrival", kind="stable")
        cols = [f.name for f in _output_schema(sensors).fields]
        cyc = pdf["cycle"].to_numpy(dtype=np.int64)
        start = cycles[-1] + 1 if cycles else (int(cyc[0]) if len(cyc) else 1)
        finite = np.isfinite(pdf[list(sensors)].to_numpy(dtype=float)).all(axis=1)
        if len(cyc) and start > 0 and finite.all() and np.array_equal(cyc, np.arange(start, start + len(cyc))):
            res, cycles, values, flags = _fast_rows(key, cycles, values, flags, pdf, sensors, window, required)
            state.update((first if first is not None else int(cyc[0]), cycles, values, flags))
            yield res[cols]
            return
        for row, usable in zip(pdf.itertuples(index=False), finite, strict=True):
            cyc = int(row.cycle)
            rec = {"unit_id": int(key[0]), "cycle": cyc}
            if not usable:
                rec["status"] = "non_numeric"
                out.append(rec)
                continue
            if cycles and cyc <= cycles[-1]:
                # accepted cycles are one contiguous range [first, last]
                rec["status"] = "duplicate" if cyc >= first else "out_of_order"
                out.append(rec)
                continue
            if cycles and cyc != cycles[-1] + 1:
                rec["status"] = "gap"
                out.append(rec)
                continue
            if not cycles and cyc <= 0:
                rec["status"] = "non_positive"
                out.append(rec)
                continue
            first = cyc if first is None else first
            vals = [float(getattr(row, s)) for s in sensors]
            cycles, values, flags = (cycles + [cyc])[-BUFFER:], (values + [vals])[-BUFFER:], (
                flags + [bool(row.exceeded)])[-BUFFER:]
            arr = np.array(values)
            rec["status"] = "ok"
            for j, s in enumerate(sensors):
                col = arr[:, j]
                last5 = col[-5:]
                rec[f"{s}_lag_1"] = float(col[-2]) if len(col) >= 2 else math.nan
                rec[f"{s}_lag_5"] = float(col[-6]) if len(col) >= 6 else math.nan
                rec[f"{s}_rolling_mean_5"] = float(last5.mean())
                rec[f"{s}_rolling_std_5"] = float(last5.std(ddof=0))
                rec[f"{s}_delta_1"] = float(col[-1] - col[-2]) if len(col) >= 2 else math.nan
            recent = flags[-window:]
            rec["exceeded"] = flags[-1]
            rec["recent_count"] = int(sum(recent))
            rec["recent_size"] = len(recent)
            rec["alert_active"] = len(recent) >= window and sum(recent) >= required
            out.append(rec)
        state.update((first, cycles, values, flags))
        res = pd.DataFrame(out, columns=cols)
        yield res.astype({"unit_id": "int64", "cycle": "int64"})

    return fn


def unit_state_stream(stream: DataFrame, sensors: Sequence[str], window: int = C.PERSISTENCE_WINDOW,
                      required: int = C.PERSISTENCE_REQUIRED_COUNT, idle_ms: int | None = None) -> DataFrame:
    """Per-unit state -> temporal features, persistence alert, rejects.

    A row with a missing or non-finite sensor value is rejected, whatever else
    its batch holds.  The state of a unit that sends nothing for ``idle_ms``
    milliseconds is dropped (kept for ever if None); its next row starts anew.

    ``stream`` needs unit_id, cycle, arrival (order within the unit),
    ``exceeded`` and the sensor columns.  Output mode append, one output row
    per input row.
    """
    ship_package(stream.sparkSession)
    return stream.groupBy("unit_id").applyInPandasWithState(
        _update_unit(list(sensors), window, required, idle_ms), _output_schema(sensors), STATE_SCHEMA, "append",
        GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Version folders under ``path`` via the Hadoop FileSystem (any shared FS)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]
    return sorted(n for n in names if n.startswith("v"))


def latest_status_writer(path: str):
    """``foreachBatch`` sink keeping the newest row per unit.

    Batch ``b`` merges its newest row per unit into the previous version and
    writes version ``v{b}``; a retried batch rewrites the same version, so the
    sink is idempotent.  Readers take the highest version
    (:func:`read_latest_status`).  The table holds one row per unit.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cols = [c for c in batch.columns if c != "unit_id"]
        newest = batch.where(F.col("status") == "ok").groupBy("unit_id").agg(
            F.max_by(F.struct(*cols), F.col("cycle")).alias("s")).select("unit_id", "s.*")
        previous = [v for v in _versions(spark, path) if v < f"v{batch_id:010d}"]
        merged = newest
        if previous:
            merged = spark.read.parquet(f"{path}/{previous[-1]}").unionByName(newest)
        best = merged.groupBy("unit_id").agg(F.max_by(F.struct(*cols), F.col("cycle")).alias("s")).select(
            "unit_id", "s.*")
        best.write.mode("overwrite").parquet(f"{path}/v{batch_id:010d}")

    return write


def read_latest_status(spark: SparkSession, path: str) -> DataFrame:
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/{versions[-1]}")
