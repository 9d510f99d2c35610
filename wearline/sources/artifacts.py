"""Model artifacts and metadata.

* S9  fitted pipelines are saved with MLlib's own writer; the isolation
      forest and the reference scores are Parquet tables in the same folder.
* S10 metadata is a one-row JSON table written and read with a schema.
* S11 metadata rules are predicates evaluated over that table and the
      reference-score table, returned as a violations DataFrame.
"""

from __future__ import annotations

import json
import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as X

METADATA_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("predictor_columns", T.ArrayType(T.StringType())),
    T.StructField("threshold_quantile", T.DoubleType()),
    T.StructField("threshold_raw_score", T.DoubleType()),
    T.StructField("p97_5", T.DoubleType()),
    T.StructField("calibration_method", T.StringType()),
    T.StructField("thresholds", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("training_row_count", T.LongType()),
])


def save_pipeline(model: PipelineModel, path: str) -> None:
    """S9 sink: MLlib writer (stages incl. our Python stages)."""
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    """S9 source."""
    return PipelineModel.load(path)


def save_forest(nodes: DataFrame, reference_scores: DataFrame, params: dict, path: str) -> None:
    """S9 for the isolation-forest bundle: node table, sorted reference scores
    and the scalar parameters (psi, threshold, version)."""
    nodes.write.mode("overwrite").parquet(os.path.join(path, "nodes"))
    # written in order: Spark deals sorted ranges, one file each, named by their order
    reference_scores.select("score").orderBy("score").write.mode("overwrite").parquet(os.path.join(path, "reference_scores"))
    spark = nodes.sparkSession
    spark.createDataFrame([(json.dumps(params),)], "params string").write.mode("overwrite").json(
        os.path.join(path, "params"))


def load_forest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    nodes = spark.read.parquet(os.path.join(path, "nodes"))
    ref = spark.read.parquet(os.path.join(path, "reference_scores"))
    params = json.loads(spark.read.schema("params string").json(os.path.join(path, "params")).first()["params"])
    return nodes, ref, params


def order_breaks(spark: SparkSession, path: str, column: str = "score", chunk: int = 1 << 16) -> DataFrame:
    """One row, ``breaks`` = places where a stored column falls, in the order of files and rows.

    Rows are compared inside chunks of a file, then the ends of neighbouring
    chunks, so a pair swapped across a border is found and no task sees more
    than a chunk.  Nulls are not compared (a rule of their own finds them).
    """
    rows = spark.read.parquet(path).select(
        F.col(column).alias("v"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")).where("v IS NOT NULL")
    rows = rows.withColumn("part", F.floor(F.col("at") / chunk))
    inside = F.lag("v").over(Window.partitionBy("file", "part").orderBy("at"))
    ends = rows.withColumn("before", inside).groupBy("file", "part").agg(
        F.count_if(F.col("v") < F.col("before")).alias("within"), F.min_by("v", "at").alias("first"), F.max_by("v", "at").alias("last"))
    # one row per chunk from here on; chunks of a file, then first and last of the files
    across = ends.withColumn("before", F.lag("last").over(Window.partitionBy("file").orderBy("part")))
    files = across.groupBy("file").agg(
        F.sum(F.col("within") + F.when(F.col("first") < F.col("before"), 1).otherwise(0)).alias("within"),
        F.min_by("first", "part").alias("first"), F.max_by("last", "part").alias("last"))
    neighbours = files.withColumn("before", F.lag("last").over(Window.orderBy("file")))  # one row per file
    return neighbours.agg(F.coalesce(F.sum(F.col("within") + F.when(F.col("first") < F.col("before"), 1).otherwise(0)), F.lit(0)).alias("breaks"))


def write_metadata(spark: SparkSession, meta: dict, path: str) -> None:
    """S10 sink: one JSON object, path-free."""
    row = {f.name: meta.get(f.name) for f in METADATA_SCHEMA.fields}
    spark.createDataFrame([row], METADATA_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """S10 source with the explicit schema."""
    return spark.read.schema(METADATA_SCHEMA).json(path)


#: Rules that an artifact's metadata must meet beside name, version and predictors.
KIND_RULES = {
    "anomaly": ["threshold_finite", "quantile_in_unit_interval", "p97_5_matches_threshold"],
    "rul": [],
    "failure": ["risk_thresholds_ordered"],
}


def metadata_violations(meta: DataFrame, reference_scores: DataFrame | None = None,
                        contract: list[str] | None = None, kind: str | None = None, scores_path: str | None = None) -> DataFrame:
    """Every rule as a row (rule, violated).  Rules: non-empty name and
    version, predictor list equals the contract, finite numbers, 0 < medium <
    high < critical < 1, p97_5 equal to the threshold within 1e-12, and
    reference scores finite and non-empty, and, of the table at ``scores_path``,
    in ascending order as stored.  ``kind`` keeps the rules of one
    kind of artifact (:data:`KIND_RULES`); without it every rule applies."""
    th = F.col("thresholds")
    rules = {
        "name_present": F.coalesce(F.length(F.trim("model_name")) > 0, F.lit(False)),
        "version_present": F.coalesce(F.length(F.trim("model_version")) > 0, F.lit(False)),
        "threshold_finite": X.is_finite("threshold_raw_score"),
        "quantile_in_unit_interval": (F.col("threshold_quantile") > 0) & (F.col("threshold_quantile") < 1),
        "p97_5_matches_threshold": F.abs(F.col("p97_5") - F.col("threshold_raw_score")) <= 1e-12,
        "risk_thresholds_ordered": F.coalesce(
            (th["medium"] > 0) & (th["medium"] < th["high"]) & (th["high"] < th["critical"]) & (th["critical"] < 1),
            F.lit(False)),
    }
    if kind is not None:
        rules = {k: v for k, v in rules.items() if k in ("name_present", "version_present", *KIND_RULES[kind])}
    if contract is not None:
        rules["predictors_match_contract"] = F.col("predictor_columns") == F.array(*[F.lit(c) for c in contract])
    checked = meta.select(*[F.coalesce(v, F.lit(False)).alias(k) for k, v in rules.items()])
    stack = ", ".join(f"'{k}', NOT `{k}`" for k in rules)
    out = checked.selectExpr(f"stack({len(rules)}, {stack}) AS (rule, violated)")
    if reference_scores is not None:
        ref = reference_scores.agg(
            (F.count(F.lit(1)) == 0).alias("reference_empty"),
            (F.count_if(~X.is_finite("score")) > 0).alias("reference_not_finite"))
        extra = ref.selectExpr("stack(2, 'reference_non_empty', reference_empty, "
                               "'reference_finite', reference_not_finite) AS (rule, violated)")
        out = out.unionByName(extra)
    if scores_path is not None:
        falls = order_breaks(meta.sparkSession, scores_path)
        out = out.unionByName(falls.select(F.lit("reference_ascending").alias("rule"), (F.col("breaks") > 0).alias("violated")))
    return out


def require_metadata(spark: SparkSession, path: str, kind: str, contract: list[str],
                     reference_scores: DataFrame | None = None, scores_path: str | None = None) -> None:
    """Read written metadata back and fail the job if it breaks a rule of its kind."""
    checked = metadata_violations(read_metadata(spark, path), reference_scores, contract, kind, scores_path)
    broken = sorted(r["rule"] for r in checked.where("violated").collect())  # at most one row per rule
    if broken:
        raise ValueError(f"metadata at {path} breaks {broken}")
