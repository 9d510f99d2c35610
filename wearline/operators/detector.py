"""Anomaly detector as a Spark ML Estimator and Model.

The fitted bundle is the sensors' means and scales, the alert threshold, the
sorted reference scores and, for the forest, its node table.  It is saved by
the ML writer with the two tables beside the parameters, and works as a stage
of a Pipeline.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import columns as X
from ..session import materialize
from . import detect, forest, validate
from .ordered import ecdf_percentile, exact_quantiles
from .windows import pattern_text, persistence_columns, recent_pattern_columns, trailing_columns


class _DetectorParams(Params):
    sensors = Param(Params._dummy(), "sensors", "sensor columns", TypeConverters.toListString)
    kind = Param(Params._dummy(), "kind", "statistical or forest", TypeConverters.toString)
    quantile = Param(Params._dummy(), "quantile", "quantile of the reference scores that is the threshold", TypeConverters.toFloat)
    trees = Param(Params._dummy(), "trees", "isolation trees", TypeConverters.toInt)
    samples = Param(Params._dummy(), "samples", "reference rows per tree", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the forest", TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(kind="statistical", quantile=C.THRESHOLD_QUANTILE, trees=300, samples=256, seed=42)


class AnomalyDetector(Estimator, _DetectorParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits on normal reference rows (unit_id, cycle and the sensors)."""

    @keyword_only
    def __init__(self, *, sensors=None, kind="statistical", quantile=C.THRESHOLD_QUANTILE, trees=300, samples=256, seed=42):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, reference: DataFrame) -> "AnomalyDetectorModel":
        names = self.getOrDefault("sensors")
        fitted = detect.scaler_params(reference, names).first()
        if fitted[0] is None:
            raise ValueError("the reference holds no row")
        model = AnomalyDetectorModel(
            sensors=names, kind=self.getOrDefault("kind"), quantile=self.getOrDefault("quantile"),
            means=[float(fitted[f"{s}_mean"]) for s in names], scales=[float(fitted[f"{s}_scale"]) for s in names])
        scaled = model.scaled(reference)
        if model.getOrDefault("kind") == "forest":
            nodes, psi = forest.fit_isolation_forest(
                scaled, model.z_columns(), self.getOrDefault("trees"), self.getOrDefault("samples"), self.getOrDefault("seed"))
            model.nodes = materialize(nodes, "detector-nodes")
            model._set(psi=psi)
        model.scores = materialize(model.scored(scaled).select("score"), "detector-scores")
        model._set(threshold=float(exact_quantiles(model.scores, "score", [self.getOrDefault("quantile")]).first()["value"]))
        return model


class AnomalyDetectorModel(Model, _DetectorParams, MLWritable, MLReadable):
    """Adds ``score``, ``raw_threshold``, ``exceeded`` and per sensor ``{s}_mean`` and ``z_{s}``."""

    means = Param(Params._dummy(), "means", "reference means", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "reference scales", TypeConverters.toListFloat)
    threshold = Param(Params._dummy(), "threshold", "alert threshold", TypeConverters.toFloat)
    psi = Param(Params._dummy(), "psi", "rows per tree", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, sensors=None, kind="statistical", quantile=C.THRESHOLD_QUANTILE, means=None, scales=None):
        super().__init__()
        self._defaults()
        self._setDefault(psi=0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self.nodes: DataFrame | None = None
        self.scores: DataFrame | None = None

    def z_columns(self) -> list[str]:
        return [f"z_{s}" for s in self.getOrDefault("sensors")]

    def scaled(self, df: DataFrame) -> DataFrame:
        means, scales = self.getOrDefault("means"), self.getOrDefault("scales")
        out = {}
        for s, m, d in zip(self.getOrDefault("sensors"), means, scales, strict=True):
            out |= {f"{s}_mean": F.lit(m), f"z_{s}": (F.col(s) - F.lit(m)) / F.lit(d)}
        return df.withColumns(out)

    def scored(self, scaled: DataFrame) -> DataFrame:
        if self.getOrDefault("kind") == "forest":
            return forest.score_isolation_forest(scaled, self.nodes, self.getOrDefault("psi"), self.z_columns())
        return scaled.withColumn("score", X.rms(self.z_columns()))

    def _transform(self, df: DataFrame) -> DataFrame:
        limit = F.lit(self.getOrDefault("threshold"))
        return self.scored(self.scaled(df)).withColumn("raw_threshold", limit).withColumn("exceeded", X.exceeded("score", "raw_threshold"))

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, instance: AnomalyDetectorModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.scores.orderBy("score").write.parquet(os.path.join(path, "scores"))
        if self.instance.nodes is not None:
            self.instance.nodes.write.parquet(os.path.join(path, "nodes"))


class _ModelReader(MLReader):
    def load(self, path: str) -> AnomalyDetectorModel:
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = AnomalyDetectorModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.scores = spark.read.parquet(os.path.join(path, "scores"))
        if model.getOrDefault("kind") == "forest":
            model.nodes = spark.read.schema(forest.NODE_SCHEMA).parquet(os.path.join(path, "nodes"))
        return model


def score_observations(model: AnomalyDetectorModel, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scored rows, rows refused because a sensor is missing or not finite)."""
    usable = F.lit(True)
    for s in model.getOrDefault("sensors"):
        usable = usable & X.is_finite(s)
    usable = F.coalesce(usable, F.lit(False))
    return model.transform(df.where(usable)), df.where(~usable)


def alert_status(model: AnomalyDetectorModel, rows: DataFrame, arrival: str = "arrival", window: int = C.PERSISTENCE_WINDOW,
                 required: int = C.PERSISTENCE_REQUIRED_COUNT, top_n: int = C.TOP_DEVIATIONS, valid: DataFrame | None = None) -> DataFrame:
    """M29 behind the contract gate: latest status of every unit whose trajectory breaks no rule.

    ``rows``: unit_id, cycle, ``arrival`` and the sensors.  Only the last
    ``window`` cycles of a valid unit are scored: the newest row is reported and
    its window reaches no further, since valid cycles follow one another.
    ``valid``: the units behind the gate, where it was asked already.
    """
    names: Sequence[str] = model.getOrDefault("sensors")
    valid = validate.valid_units(rows, "unit_id", "cycle", arrival, names) if valid is None else valid
    good = rows.join(valid, "unit_id", "left_semi")
    last = good.groupBy("unit_id").agg(F.max("cycle").alias("_last"), F.count(F.lit(1)).alias("history_cycle_count"))
    recent = good.join(last, "unit_id").where(F.col("cycle") > F.col("_last") - window)
    scored = model.transform(recent.select("unit_id", "cycle", "_last", "history_cycle_count", *names))
    win = trailing_columns(scored, {**persistence_columns("exceeded", window, required), **recent_pattern_columns("exceeded", window)}, lookback=window - 1)
    latest = ecdf_percentile(win.where("cycle = _last"), "score", model.scores, "score", name="anomaly_percentile")
    return latest.select(
        "unit_id", "history_cycle_count", F.col("score").alias("current_anomaly_score"), "anomaly_percentile",
        F.lit(model.getOrDefault("quantile") * 100.0).alias("threshold_percentile"), "raw_threshold",
        F.col("exceeded").alias("current_threshold_exceeded"), F.col("recent_size").alias("recent_window_size"),
        pattern_text("recent_pattern").alias("recent_exceedance_pattern"), F.col("recent_count").cast("bigint").alias("recent_exceedance_count"),
        F.when(F.col("recent_size") >= window, C.PERSISTENCE_AVAILABLE).otherwise(C.PERSISTENCE_INSUFFICIENT).alias("persistence_status"),
        F.col("persistent").alias("alert_active"), detect.deviations_text(detect.top_deviations(names, top_n)).alias("top_sensor_deviations"))
