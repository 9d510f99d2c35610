"""Projection, derived-column, filter and window queries (P*, F*, G*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import columns as X
from ..operators import detect, validate, windows
from ..sources import tables
from .registry import finish, register

SENSORS4 = ["sensor_1", "sensor_2", "sensor_3", "sensor_4"]


def _feature_sql(sensors):
    parts = []
    for s in sensors:
        parts += [
            f"lag({s}, 1) OVER o AS {s}_lag_1",
            f"lag({s}, 5) OVER o AS {s}_lag_5",
            f"avg({s}) OVER w5 AS {s}_rolling_mean_5",
            f"stddev_pop({s}) OVER w5 AS {s}_rolling_std_5",
            f"{s} - lag({s}, 1) OVER o AS {s}_delta_1",
        ]
    return ",\n  ".join(parts)


WINDOWS_SQL = """WINDOW o AS (PARTITION BY unit_id ORDER BY cycle),
       w5 AS (PARTITION BY unit_id ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""

FEATURE_COLS = [f"{s}_{x}" for s in SENSORS4 for x in C.TEMPORAL_SUFFIXES]


# ---------------------------------------------------------------------------

@register("machine_features", ops=["P1", "P2", "P3", "P8", "S6"], views=["obs"],
          round_cols=["air_temperature", "process_temperature", "rotational_speed", "torque", "tool_wear",
                      "temperature_difference", "power_proxy", "strain_proxy"],
          sql="""
SELECT unit_id, cycle, type, air_temperature, process_temperature, rotational_speed, torque, tool_wear,
       process_temperature - air_temperature AS temperature_difference,
       rotational_speed * torque AS power_proxy,
       torque * tool_wear AS strain_proxy,
       CAST(twf + hdf + pwf + osf + rnf AS INT) AS failure_type_count
FROM obs""")
def machine_features(spark, sf_dir):
    """Allow-listed machine predictors plus the three engineered features."""
    o = tables.obs(spark, sf_dir)
    return finish(o.select(
        "unit_id", "cycle", "type", "air_temperature", "process_temperature", "rotational_speed", "torque",
        "tool_wear",
        X.temperature_difference("process_temperature", "air_temperature").alias("temperature_difference"),
        X.power_proxy("rotational_speed", "torque").alias("power_proxy"),
        X.strain_proxy("torque", "tool_wear").alias("strain_proxy"),
        X.row_sum(C.FAILURE_MODES).cast("int").alias("failure_type_count"),
    ))


@register("rul_targets", ops=["P4", "P5", "G1"], views=["traj"], sql="""
SELECT unit_id, cycle,
       max(cycle) OVER (PARTITION BY unit_id) - cycle AS raw_rul,
       least(max(cycle) OVER (PARTITION BY unit_id) - cycle, 125) AS capped_rul
FROM traj""")
def rul_targets(spark, sf_dir):
    """raw_rul = last cycle - cycle and capped_rul = min(raw_rul, 125)."""
    t = tables.traj(spark, sf_dir).select("unit_id", "cycle")
    return detect.add_rul_targets(t).select("unit_id", "cycle", "raw_rul", "capped_rul")


@register("rul_temporal_features", ops=["G2", "G3", "G4", "G5", "G6", "W3"], views=["traj"],
          round_cols=SENSORS4 + FEATURE_COLS, sql=f"""
SELECT unit_id, cycle, {", ".join(SENSORS4)},
  {_feature_sql(SENSORS4)}
FROM traj
{WINDOWS_SQL}""")
def rul_temporal_features(spark, sf_dir):
    """lag_1, lag_5, rolling mean/std (ddof 0, min_periods 1), delta_1 per sensor."""
    t = tables.traj(spark, sf_dir).select("unit_id", "cycle", *SENSORS4)
    return finish(windows.add_temporal_features(t, SENSORS4))


FAULTY_SQL = """fed AS (
  SELECT unit_id, cycle AS arrival, cycle + CASE WHEN l_quantity = 50 AND l_linenumber = 7 THEN 1 ELSE 0 END AS cycle,
         sensor_1, sensor_4 FROM traj),
good AS (
  SELECT unit_id FROM (SELECT unit_id, cycle, cycle - lag(cycle) OVER (PARTITION BY unit_id ORDER BY arrival) AS step
                       FROM fed)
  GROUP BY unit_id HAVING count(CASE WHEN step <> 1 THEN 1 END) = 0 AND min(cycle) > 0)"""


@register("validated_rul_features", ops=["V6", "V7", "V8", "V9", "V10", "V13", "M27", "M29"], views=["traj"],
          round_cols=["sensor_1", "sensor_4"] + [f"{s}_{x}" for s in ("sensor_1", "sensor_4") for x in C.TEMPORAL_SUFFIXES],
          sql=f"""
WITH {FAULTY_SQL}
SELECT unit_id, cycle, sensor_1, sensor_4,
  {_feature_sql(["sensor_1", "sensor_4"])}
FROM fed WHERE unit_id IN (SELECT unit_id FROM good)
{WINDOWS_SQL}""")
def validated_rul_features(spark, sf_dir):
    """Trajectories, some with a repeated or skipped cycle, behind the contract
    gate: features of the units that break no rule, in cycle order."""
    bump = F.when((F.col("l_quantity") == 50) & (F.col("l_linenumber") == 7), 1).otherwise(0)
    fed = tables.traj(spark, sf_dir).select(
        "unit_id", F.col("cycle").alias("arrival"), (F.col("cycle") + bump).alias("cycle"), "sensor_1", "sensor_4")
    good = validate.valid_trajectories(fed, "unit_id", "cycle", "arrival", ["sensor_1", "sensor_4"]).drop("arrival")
    return finish(windows.add_temporal_features(good, ["sensor_1", "sensor_4"]))


@register("rul_latest_features", ops=["G11", "G19", "P18"], views=["traj"],
          round_cols=SENSORS4 + FEATURE_COLS, sql=f"""
WITH f AS (
  SELECT unit_id, cycle, {", ".join(SENSORS4)},
    {_feature_sql(SENSORS4)},
    count(*) OVER (PARTITION BY unit_id) AS history_cycle_count,
    max(cycle) OVER (PARTITION BY unit_id) AS last_cycle
  FROM traj
  {WINDOWS_SQL})
SELECT unit_id, cycle, {", ".join(SENSORS4)}, {", ".join(FEATURE_COLS)}, history_cycle_count,
       CASE WHEN history_cycle_count >= 6 THEN 'full_context' ELSE 'limited_history' END AS history_quality
FROM f WHERE cycle = last_cycle""")
def rul_latest_features(spark, sf_dir):
    """Features computed on the full history, then the newest row per unit."""
    t = tables.traj(spark, sf_dir).select("unit_id", "cycle", *SENSORS4)
    feats = windows.add_temporal_features(t, SENSORS4)
    last = t.groupBy("unit_id").agg(F.max("cycle").alias("_last"), F.count(F.lit(1)).alias("history_cycle_count"))
    latest = feats.join(last, "unit_id").where(F.col("cycle") == F.col("_last")).drop("_last")
    return finish(latest.withColumn("history_quality", X.history_quality("history_cycle_count")))


@register("history_truncation", ops=["F5", "G13", "M34"], views=["traj"],
          round_cols=["sensor_4_rolling_mean_5", "sensor_4_rolling_std_5", "sensor_4_lag_5"], sql=f"""
WITH f AS (
  SELECT unit_id, cycle, {_feature_sql(["sensor_4"])} FROM traj {WINDOWS_SQL}),
n AS (SELECT * FROM (VALUES (1), (3), (5), (6), (20)) v(history_length))
SELECT f.unit_id, n.history_length, f.sensor_4_lag_5, f.sensor_4_rolling_mean_5, f.sensor_4_rolling_std_5,
       CASE WHEN n.history_length >= 6 THEN 'full_context' ELSE 'limited_history' END AS history_quality
FROM f JOIN n ON f.cycle = n.history_length""")
def history_truncation(spark, sf_dir):
    """Each unit as of its first 1/3/5/6/20 cycles: the row at cycle n equals the
    latest row of the truncated history because every feature looks back only."""
    t = tables.traj(spark, sf_dir).select("unit_id", "cycle", "sensor_4")
    lengths = spark.createDataFrame([(n,) for n in (1, 3, 5, 6, 20)], "history_length int")
    # The first 20 rows of every unit (cycles are consecutive from 1)
    feats = windows.add_temporal_features(t.where(F.col("cycle") <= 20), ["sensor_4"])
    out = feats.join(F.broadcast(lengths), feats["cycle"] == lengths["history_length"])
    return finish(out.select("unit_id", "history_length", "sensor_4_lag_5", "sensor_4_rolling_mean_5",
                             "sensor_4_rolling_std_5", X.history_quality("history_length").alias("history_quality")))


PRED_SQL = "least(max(cycle) OVER (PARTITION BY unit_id) - cycle, 125) + (l_quantity - 25.5e0) * 0.8e0"


def _stand_in_prediction(t):
    """Model output stand-in for SQL-checkable error analysis: capped RUL
    shifted by a data-driven error of either sign."""
    r = detect.add_rul_targets(t)
    return r.withColumn("prediction", F.col("capped_rul") + (F.col("l_quantity") - 25.5) * 0.8)


@register("rul_error_analysis", ops=["P9", "P10", "P15", "P16", "P17"], views=["traj"],
          round_cols=["prediction", "error_raw", "error_capped", "abs_error", "penalty", "bounded_prediction",
                      "rounded_prediction"], sql=f"""
WITH p AS (SELECT unit_id, cycle, max(cycle) OVER (PARTITION BY unit_id) - cycle AS raw_rul,
                  least(max(cycle) OVER (PARTITION BY unit_id) - cycle, 125) AS capped_rul,
                  {PRED_SQL} AS prediction FROM traj),
b AS (SELECT *, least(greatest(prediction, 0e0), 125e0) AS bounded_prediction FROM p)
SELECT unit_id, cycle, raw_rul, capped_rul, prediction,
       prediction - raw_rul AS error_raw, prediction - capped_rul AS error_capped,
       abs(prediction - capped_rul) AS abs_error,
       CASE WHEN prediction - capped_rul < 0 THEN exp(-(prediction - capped_rul) / 13e0) - 1
            ELSE exp((prediction - capped_rul) / 10e0) - 1 END AS penalty,
       CASE WHEN capped_rul <= 30 THEN 'Near failure (0–30)' WHEN capped_rul <= 80 THEN 'Mid-life (31–80)'
            ELSE 'Healthy/early (>80)' END AS rul_band,
       bounded_prediction,
       round_even(bounded_prediction, 1) AS rounded_prediction,
       CASE WHEN bounded_prediction >= 120 THEN '125+ cycle horizon'
            ELSE printf('Estimated Remaining Useful Life: %.1f cycles', round_even(bounded_prediction, 1)) END
         AS rul_display
FROM b""")
def rul_error_analysis(spark, sf_dir):
    """Signed/absolute errors, asymmetric penalty, RUL band, clamp + half-even
    rounding and display text for every row."""
    t = tables.traj(spark, sf_dir).select("unit_id", "cycle", "l_quantity")
    p = _stand_in_prediction(t)
    b = p.withColumn("bounded_prediction", X.bounded_prediction("prediction"))
    return finish(b.select(
        "unit_id", "cycle", "raw_rul", "capped_rul", "prediction",
        (F.col("prediction") - F.col("raw_rul")).alias("error_raw"),
        (F.col("prediction") - F.col("capped_rul")).alias("error_capped"),
        F.abs(F.col("prediction") - F.col("capped_rul")).alias("abs_error"),
        X.asymmetric_penalty("prediction", "capped_rul").alias("penalty"),
        X.rul_band("capped_rul").alias("rul_band"),
        "bounded_prediction",
        F.bround("bounded_prediction", 1).alias("rounded_prediction"),
        X.rul_display("bounded_prediction").alias("rul_display"),
    ))


THRESHOLDS = {"medium": 0.3, "high": 0.6, "critical": 0.9}


def thresholds_table(spark):
    """The frozen risk-threshold artifact as a one-row table (broadcast)."""
    return spark.createDataFrame([tuple(THRESHOLDS.values())], "medium double, high double, critical double")


@register("risk_scoring", ops=["P11", "P12", "P13", "P19", "P26", "J7", "M26"], views=["obs"],
          round_cols=["risk_score"], sql="""
SELECT unit_id, cycle, score_a * 100 AS risk_score,
  CASE WHEN score_a < 0.3 THEN 'Low Risk' WHEN score_a < 0.6 THEN 'Medium Risk'
       WHEN score_a < 0.9 THEN 'High Risk' ELSE 'Critical Risk' END AS risk_category,
  CASE WHEN score_a < 0.3 THEN 'Continue normal monitoring.'
       WHEN score_a < 0.6 THEN 'Increase monitoring frequency and review recent sensor trends.'
       WHEN score_a < 0.9 THEN 'Schedule a preventive maintenance inspection.'
       ELSE 'Prioritize immediate maintenance review and reduce avoidable operating stress.' END
    AS recommended_action,
  score_a >= 0.5 AS predicted_failure,
  CASE failure WHEN 1 THEN 'Failure' ELSE 'No failure' END AS actual_label
FROM obs""")
def risk_scoring(spark, sf_dir):
    """0-100 score, left-inclusive risk category from the threshold artifact,
    recommended action, inclusive 0.5 decision and decoded label."""
    o = tables.obs(spark, sf_dir).crossJoin(F.broadcast(thresholds_table(spark)))
    cat = X.risk_category("score_a", "medium", "high", "critical")
    return finish(o.select(
        "unit_id", "cycle", X.score_0_100("score_a").alias("risk_score"),
        cat.alias("risk_category"), X.recommended_action(cat).alias("recommended_action"),
        X.decision("score_a", 0.5).alias("predicted_failure"),
        X.label_text("failure").alias("actual_label"),
    ))


@register("exceedance_persistence", ops=["P20", "P27", "G7", "G8", "G9", "G10", "G18"], views=["obs"],
          round_cols=["anomaly_score", "score_delta"], sql="""
WITH e AS (SELECT unit_id, cycle, -(-score_b) AS anomaly_score, score_b > 0.5 AS exceeded FROM obs)
SELECT unit_id, cycle, anomaly_score, exceeded,
  coalesce(anomaly_score - lag(anomaly_score) OVER o, 0e0) AS score_delta,
  cycle - lag(cycle) OVER o AS cycle_step,
  exceeded AND coalesce(lag(exceeded) OVER o, false) AS two_consecutive,
  sum(CAST(exceeded AS INT)) OVER w5 >= 3 AS persistent_any_history,
  count(*) OVER w5 >= 5 AND sum(CAST(exceeded AS INT)) OVER w5 >= 3 AS persistent
FROM e
WINDOW o AS (PARTITION BY unit_id ORDER BY cycle),
       w5 AS (PARTITION BY unit_id ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def exceedance_persistence(spark, sf_dir):
    """Strict exceedance, first-filled delta, cycle step, 2-consecutive,
    3-of-5 (research, min_periods 1) and 3-of-5 (production, needs 5 rows)."""
    o = tables.obs(spark, sf_dir).select("unit_id", "cycle", "score_b")
    e = o.select("unit_id", "cycle", X.flip_score(-F.col("score_b")).alias("anomaly_score")).withColumn(
        "exceeded", X.exceeded("anomaly_score", 0.5))
    cols = {
        "score_delta": lambda w: F.coalesce(F.col("anomaly_score") - F.lag("anomaly_score", 1).over(w), F.lit(0.0)),
        "cycle_step": lambda w: F.col("cycle") - F.lag("cycle", 1).over(w),
        **windows.consecutive_columns("exceeded"),
        **windows.persistence_columns("exceeded", 5, 3, min_periods=1, prefix="r_"),
        **windows.persistence_columns("exceeded", 5, 3),
    }
    out = windows.trailing_columns(e, cols, lookback=4)
    return finish(out.select("unit_id", "cycle", "anomaly_score", "exceeded", "score_delta", "cycle_step",
                             "two_consecutive", F.col("r_persistent").alias("persistent_any_history"),
                             "persistent"))


@register("lifecycle_stages", ops=["P14", "P24"], views=["traj"], sql="""
WITH r AS (SELECT unit_id, cycle, max(cycle) OVER (PARTITION BY unit_id) - cycle AS raw_rul FROM traj)
SELECT CASE WHEN raw_rul <= 30 THEN 'Critical late life' WHEN raw_rul <= 60 THEN 'Near failure'
            WHEN raw_rul <= 125 THEN 'Degrading' ELSE 'Healthy / early' END AS lifecycle_stage,
       CASE WHEN raw_rul <= 30 THEN 0 WHEN raw_rul <= 60 THEN 1 WHEN raw_rul <= 125 THEN 2 ELSE 3 END
         AS stage_order,
       count(*) AS n, CAST(min(raw_rul) AS BIGINT) AS min_raw_rul, CAST(max(raw_rul) AS BIGINT) AS max_raw_rul,
       CASE WHEN count(*) < 20 THEN 'small sample: interpret with caution' END AS caution
FROM r GROUP BY 1, 2""")
def lifecycle_stages(spark, sf_dir):
    """Right-inclusive lifecycle bins with their order and sizes."""
    r = detect.add_rul_targets(tables.traj(spark, sf_dir).select("unit_id", "cycle"))
    g = r.groupBy(X.lifecycle_stage("raw_rul").alias("lifecycle_stage"),
                  X.lifecycle_order("raw_rul").alias("stage_order")).agg(
        F.count(F.lit(1)).alias("n"), F.min("raw_rul").alias("min_raw_rul"), F.max("raw_rul").alias("max_raw_rul"))
    return g.withColumn("caution", X.small_sample_flag("n"))


@register("failure_extracts", ops=["F1", "F3", "F4", "T9", "T1"], views=["obs"],
          round_cols=["score_b", "torque", "tool_wear"], sql="""
(SELECT 'false_negative' AS kind, unit_id, cycle, score_b, torque, tool_wear FROM obs
 WHERE failure = 1 AND score_b < 0.65)
UNION ALL
(SELECT 'false_positive' AS kind, unit_id, cycle, score_b, torque, tool_wear FROM obs
 WHERE failure = 0 AND score_b >= 0.65 AND tool_wear <= 180
 ORDER BY score_b DESC, unit_id, cycle LIMIT 20)""")
def failure_extracts(spark, sf_dir):
    """All false negatives and the 20 highest-scoring false positives
    (with an expression filter on tool wear), ordered by score."""
    o = tables.obs(spark, sf_dir).select("unit_id", "cycle", "score_b", "torque", "tool_wear", "failure")
    fn = o.where((F.col("failure") == 1) & ~X.decision("score_b", 0.65)).withColumn("kind", F.lit("false_negative"))
    fp = (o.where((F.col("failure") == 0) & X.decision("score_b", 0.65) & (F.col("tool_wear") <= 180))
          .orderBy(F.desc("score_b"), "unit_id", "cycle").limit(20)
          .withColumn("kind", F.lit("false_positive")))
    cols = ["kind", "unit_id", "cycle", "score_b", "torque", "tool_wear"]
    return finish(fn.select(*cols).unionByName(fp.select(*cols)))
