"""Anomaly-detection queries over the ``traj`` fixture view."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import contracts as C
from ..operators import detect, detector, validate
from ..session import materialize
from ..sources import tables
from .registry import finish, register

# Sensors of the fixture trajectories; sensor_5 is constant (scale -> 1).
FIXTURE_SENSORS = ["sensor_1", "sensor_2", "sensor_3", "sensor_4", "sensor_5"]
FLAGSHIP_TOP_N = 3


def _z_sql(sensors: list[str]) -> str:
    return ",\n    ".join(
        f"({s} - {s}_mean) / CASE WHEN {s}_std = 0 THEN 1e0 ELSE {s}_std END AS z_{s}" for s in sensors
    )


def _params_sql(sensors: list[str]) -> str:
    return ", ".join(f"avg({s}) AS {s}_mean, stddev_pop({s}) AS {s}_std" for s in sensors)


def _rms_sql(sensors: list[str]) -> str:
    return "sqrt((" + " + ".join(f"z_{s}*z_{s}" for s in sensors) + f") / {float(len(sensors))})"


def _unnest_sql(sensors: list[str]) -> str:
    return "[" + ", ".join(f"{{'sensor': '{s}', 'idx': {i}, 'z': z_{s}}}" for i, s in enumerate(sensors)) + "]"


S = FIXTURE_SENSORS

SCORED_SQL = f"""
r AS (SELECT t.*, max(cycle) OVER (PARTITION BY unit_id) - cycle AS raw_rul FROM traj t),
p AS (SELECT {_params_sql(S)} FROM r WHERE raw_rul > 125),
z AS (SELECT r.*, p.*, {_z_sql(S)} FROM r CROSS JOIN p),
s AS (SELECT *, {_rms_sql(S)} AS score FROM z)
"""

FLEET_ALERT_SQL = f"""
WITH {SCORED_SQL},
th AS (SELECT quantile_cont(score, 0.975) AS raw_threshold FROM s WHERE raw_rul > 125),
e AS (SELECT s.*, th.raw_threshold, s.score > th.raw_threshold AS exceeded FROM s CROSS JOIN th),
w AS (
  SELECT e.*,
    sum(CAST(exceeded AS INT)) OVER win AS recent_count,
    count(*) OVER win AS recent_size,
    concat_ws(',',
      CASE WHEN lag(exceeded, 4) OVER o THEN 'T' WHEN lag(exceeded, 4) OVER o IS NOT NULL THEN 'F' END,
      CASE WHEN lag(exceeded, 3) OVER o THEN 'T' WHEN lag(exceeded, 3) OVER o IS NOT NULL THEN 'F' END,
      CASE WHEN lag(exceeded, 2) OVER o THEN 'T' WHEN lag(exceeded, 2) OVER o IS NOT NULL THEN 'F' END,
      CASE WHEN lag(exceeded, 1) OVER o THEN 'T' WHEN lag(exceeded, 1) OVER o IS NOT NULL THEN 'F' END,
      CASE WHEN exceeded THEN 'T' ELSE 'F' END) AS pat
  FROM e
  WINDOW o AS (PARTITION BY unit_id ORDER BY cycle),
         win AS (PARTITION BY unit_id ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
ref AS (SELECT score FROM s WHERE raw_rul > 125),
latest AS (SELECT * FROM w WHERE raw_rul = 0),
dev AS (
  SELECT unit_id,
         string_agg(d.sensor || ':' || CASE WHEN d.z >= 0 THEN 'above_normal' ELSE 'below_normal' END, ','
                    ORDER BY abs(d.z) DESC, d.idx) AS top
  FROM (SELECT unit_id, d, row_number() OVER (PARTITION BY unit_id ORDER BY abs(d.z) DESC, d.idx) AS rk
        FROM (SELECT unit_id, unnest({_unnest_sql(S)}) AS d FROM latest))
  WHERE rk <= {FLAGSHIP_TOP_N}
  GROUP BY unit_id)
SELECT l.unit_id,
       l.cycle AS history_cycle_count,
       l.score AS current_anomaly_score,
       least(greatest(100e0 * (SELECT count(*) FROM ref WHERE ref.score <= l.score)
             / (SELECT count(*) FROM ref), 0e0), 100e0) AS anomaly_percentile,
       97.5e0 AS threshold_percentile,
       l.raw_threshold AS raw_threshold,
       l.exceeded AS current_threshold_exceeded,
       l.recent_size AS recent_window_size,
       l.pat AS recent_exceedance_pattern,
       CAST(l.recent_count AS BIGINT) AS recent_exceedance_count,
       CASE WHEN l.recent_size >= 5 THEN 'available' ELSE 'insufficient_history' END AS persistence_status,
       (l.recent_size >= 5 AND l.recent_count >= 3) AS alert_active,
       dev.top AS top_sensor_deviations
FROM latest l JOIN dev USING (unit_id)
"""


@register("fleet_alert_status",
          ops=["P4", "F2", "M2", "J7", "P28", "M16", "A43", "P20", "G8", "G16", "G11", "G17", "T3", "P21", "X1", "X2"],
          sql=FLEET_ALERT_SQL, views=["traj"],
          round_cols=["current_anomaly_score", "anomaly_percentile", "threshold_percentile", "raw_threshold"])
def fleet_alert_status(spark, sf_dir):
    """Per-unit anomaly status with the statistical detector (flagship)."""
    t = tables.traj(spark, sf_dir)
    return finish(detect.fleet_alert_status(t, FIXTURE_SENSORS, top_n=FLAGSHIP_TOP_N))


VALID_SQL = """gated AS (
  SELECT unit_id, cycle AS arrival, cycle + CASE WHEN l_quantity = 50 AND l_linenumber = 7 THEN 1 ELSE 0 END AS stated FROM traj),
good AS (
  SELECT unit_id FROM (SELECT unit_id, stated, stated - lag(stated) OVER (PARTITION BY unit_id ORDER BY arrival) AS step FROM gated)
  GROUP BY unit_id HAVING count(CASE WHEN step <> 1 THEN 1 END) = 0 AND min(stated) > 0),
valid AS (SELECT * FROM traj WHERE unit_id IN (SELECT unit_id FROM good)),
"""


def faulty_fleet(spark, sf_dir):
    """The fleet as supplied: some units repeat or skip a cycle."""
    bump = F.when((F.col("l_quantity") == 50) & (F.col("l_linenumber") == 7), 1).otherwise(0)
    return tables.traj(spark, sf_dir).select(
        "unit_id", F.col("cycle").alias("arrival"), (F.col("cycle") + bump).alias("cycle"), *FIXTURE_SENSORS)


def valid_units(spark, sf_dir):
    """Units whose trajectory breaks no rule: the gate runs once, its verdict is stored per session."""
    return tables.stored(spark, sf_dir, "valid-units", lambda sp, d: validate.valid_units(
        faulty_fleet(sp, d), "unit_id", "cycle", "arrival", FIXTURE_SENSORS))


def fitted_detector(spark, sf_dir, kind="statistical", **params):
    """A detector fitted on the normal rows of the units that break no rule."""
    good = faulty_fleet(spark, sf_dir).join(valid_units(spark, sf_dir), "unit_id", "left_semi")
    reference = detect.add_rul_targets(good).where(F.col("raw_rul") > C.NORMAL_REFERENCE_RUL)
    reference = materialize(reference.select("unit_id", "cycle", *FIXTURE_SENSORS), "detector-reference")
    return detector.AnomalyDetector(sensors=FIXTURE_SENSORS, kind=kind, **params).fit(reference)


@register("validated_fleet_alert", ops=["M15", "M16", "M28", "M29", "V9", "V10", "V13", "A43", "G8", "G16", "G17"],
          sql=FLEET_ALERT_SQL.replace("WITH \nr AS", f"WITH {VALID_SQL}r AS").replace("FROM traj t", "FROM valid t"), views=["traj"],
          round_cols=["current_anomaly_score", "anomaly_percentile", "threshold_percentile", "raw_threshold"])
def validated_fleet_alert(spark, sf_dir):
    """Per-unit alert status of the units whose trajectory breaks no rule, by a
    saved-bundle detector fitted on such units only."""
    model = fitted_detector(spark, sf_dir)
    return finish(detector.alert_status(model, faulty_fleet(spark, sf_dir), top_n=FLAGSHIP_TOP_N, valid=valid_units(spark, sf_dir)))
