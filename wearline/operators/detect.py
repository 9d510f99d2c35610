"""Normal-reference anomaly scoring.

The statistical detector: standardise every sensor with the healthy
reference's mean and population std (zero std -> 1), score each row by the
RMS of its z values, set the alert threshold at an exact quantile of the
reference scores, and flag rows strictly above it.  The isolation-forest
detector (forest.py) plugs into the same threshold / persistence / ECDF
steps through the ``score`` column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contracts as C
from ..session import materialize
from ..functions import columns as X
from .ordered import ecdf_percentile, exact_quantiles
from .windows import pattern_text, persistence_columns, recent_pattern_columns, trailing_columns


def add_rul_targets(df: DataFrame, unit: str = "unit_id", cycle: str = "cycle",
                    cap: int = C.RUL_CAP) -> DataFrame:
    """raw_rul = last cycle of the unit - cycle; capped_rul = min(raw, cap).

    The per-unit maximum is a partial aggregate joined back on the unit
    (AQE broadcasts it when small and splits a hot unit's side when not),
    rather than an unbounded per-unit window that buffers a whole unit.
    """
    last = df.groupBy(unit).agg(F.max(cycle).alias("_last_cycle"))
    out = df.join(last, unit)
    return out.withColumn("raw_rul", F.col("_last_cycle") - F.col(cycle)).withColumn(
        "capped_rul", X.capped("raw_rul", cap)
    ).drop("_last_cycle")


def scaler_params(reference: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """M2: one row with ``{s}_mean`` and ``{s}_scale`` (population std, 0 -> 1)."""
    aggs = []
    for s in sensors:
        aggs.append(F.avg(s).alias(f"{s}_mean"))
        aggs.append(F.stddev_pop(s).alias(f"{s}_std"))
    p = reference.agg(*aggs)
    return p.select(*[c for s in sensors for c in (
        F.col(f"{s}_mean"),
        F.when(F.col(f"{s}_std") == 0, F.lit(1.0)).otherwise(F.col(f"{s}_std")).alias(f"{s}_scale"),
    )])


def standardize(df: DataFrame, params: DataFrame, sensors: Sequence[str], prefix: str = "z_") -> DataFrame:
    """J7 + M2 transform: every row meets the one-row parameter table."""
    joined = df.crossJoin(F.broadcast(params))
    return joined.withColumns(
        {f"{prefix}{s}": (F.col(s) - F.col(f"{s}_mean")) / F.col(f"{s}_scale") for s in sensors}
    )


def rms_score(sensors: Sequence[str], prefix: str = "z_") -> Column:
    return X.rms([f"{prefix}{s}" for s in sensors])


def quantile_threshold(scores: DataFrame, score_col: str = "score", q: float = C.THRESHOLD_QUANTILE,
                       name: str = "raw_threshold") -> DataFrame:
    """One-row table holding the exact linear quantile of reference scores."""
    return exact_quantiles(scores, score_col, [q]).select(F.col("value").alias(name))


def top_deviations(sensors: Sequence[str], n: int = C.TOP_DEVIATIONS, prefix: str = "z_") -> Column:
    """The n largest |z| as array<struct>, ties by sensor position."""
    if not 1 <= n <= len(sensors):
        raise ValueError("top_n must be between 1 and the predictor count")
    items = F.array(*[
        F.struct(
            F.lit(i).alias("idx"), F.lit(s).alias("sensor"), F.col(s).alias("current_value"),
            F.col(f"{s}_mean").alias("reference_mean"), F.col(f"{prefix}{s}").alias("standardized_deviation"),
            X.direction(F.col(f"{prefix}{s}")).alias("direction"),
        )
        for i, s in enumerate(sensors)
    ])
    ordered = F.array_sort(
        items,
        lambda a, b: F.when(F.abs(a["standardized_deviation"]) > F.abs(b["standardized_deviation"]), -1)
        .when(F.abs(a["standardized_deviation"]) < F.abs(b["standardized_deviation"]), 1)
        .when(a["idx"] < b["idx"], -1).when(a["idx"] > b["idx"], 1).otherwise(0),
    )
    return F.slice(ordered, 1, n)


def deviations_text(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda d: F.concat_ws(":", d["sensor"], d["direction"])), ",")


def statistical_scores(traj_with_rul: DataFrame, sensors: Sequence[str],
                       cutoff: int = C.NORMAL_REFERENCE_RUL, params: DataFrame | None = None) -> DataFrame:
    """M16 scorer: fit on rows with raw_rul > cutoff, score every row.

    z values and score are row-local: a stored fleet needs only its rows and
    ``params`` (fitted on its reference), not the scores beside them."""
    if params is None:
        params = scaler_params(traj_with_rul.where(F.col("raw_rul") > cutoff), sensors)
    z = standardize(traj_with_rul, params, sensors)
    return z.withColumn("score", rms_score(sensors))


def fleet_alert_status(
    traj: DataFrame,
    sensors: Sequence[str],
    cutoff: int = C.NORMAL_REFERENCE_RUL,
    q: float = C.THRESHOLD_QUANTILE,
    window: int = C.PERSISTENCE_WINDOW,
    required: int = C.PERSISTENCE_REQUIRED_COUNT,
    top_n: int = C.TOP_DEVIATIONS,
) -> DataFrame:
    """One row per unit: latest score, ECDF percentile, strict exceedance,
    last-``window`` pattern and persistence alert, top sensor deviations.

    P4 -> F2 -> M2 -> P28 -> A43 -> P20 -> G8/G16 -> G11 -> G17 -> T3.
    """
    rows = materialize(add_rul_targets(traj.select("unit_id", "cycle", *sensors)), "fleet")
    params = materialize(scaler_params(rows.where(F.col("raw_rul") > cutoff), sensors), "scaler")
    scored = statistical_scores(rows, sensors, cutoff, params)
    reference = scored.where(F.col("raw_rul") > cutoff).select("score")
    threshold = quantile_threshold(reference, "score", q)
    flagged = scored.crossJoin(F.broadcast(threshold)).withColumn(
        "exceeded", X.exceeded("score", "raw_threshold")
    )
    # only the newest row is reported and its frame reaches window - 1 rows
    # back, so the window runs on each unit's last `window` cycles only
    recent = flagged.where(F.col("raw_rul") < window)
    win = trailing_columns(
        recent,
        {**persistence_columns("exceeded", window, required), **recent_pattern_columns("exceeded", window)},
        lookback=window - 1,
    )
    latest = win.where(F.col("raw_rul") == 0)
    latest = ecdf_percentile(latest, "score", reference, "score", name="anomaly_percentile")
    return latest.select(
        "unit_id",
        F.col("cycle").alias("history_cycle_count"),
        F.col("score").alias("current_anomaly_score"),
        "anomaly_percentile",
        F.lit(q * 100.0).alias("threshold_percentile"),
        "raw_threshold",
        F.col("exceeded").alias("current_threshold_exceeded"),
        F.col("recent_size").alias("recent_window_size"),
        pattern_text("recent_pattern").alias("recent_exceedance_pattern"),
        F.col("recent_count").cast("bigint").alias("recent_exceedance_count"),
        F.when(F.col("recent_size") >= window, C.PERSISTENCE_AVAILABLE)
        .otherwise(C.PERSISTENCE_INSUFFICIENT).alias("persistence_status"),
        F.col("persistent").alias("alert_active"),
        deviations_text(top_deviations(sensors, top_n)).alias("top_sensor_deviations"),
    )


# ---------------------------------------------------------------------------
# Evaluation of alert policies
# ---------------------------------------------------------------------------

POLICIES = ["one_cycle", "two_consecutive", "three_of_five_any_history", "three_of_five"]


def alert_policies(flagged: DataFrame, flag: str = "exceeded", unit: str = "unit_id",
                   order: str = "cycle") -> DataFrame:
    """A51 inputs: one cycle, two consecutive, 3-of-5 with min_periods 1
    (research) and 3-of-5 needing 5 rows (production), in one windowed pass."""
    from .windows import consecutive_columns
    cols = {
        **consecutive_columns(flag, "two_consecutive"),
        **persistence_columns(flag, C.PERSISTENCE_WINDOW, C.PERSISTENCE_REQUIRED_COUNT, 1, prefix="r_"),
        **persistence_columns(flag, C.PERSISTENCE_WINDOW, C.PERSISTENCE_REQUIRED_COUNT),
    }
    out = trailing_columns(flagged, cols, unit=unit, order=order, lookback=C.PERSISTENCE_WINDOW - 1)
    return out.withColumn("one_cycle", F.col(flag)).withColumnRenamed(
        "r_persistent", "three_of_five_any_history").withColumnRenamed("persistent", "three_of_five").drop(
        "r_recent_count", "r_recent_size")


def unit_alert_summary(df: DataFrame, alert: str, by: Sequence[str] = (), unit: str = "unit_id",
                       healthy_rul: int = C.NORMAL_REFERENCE_RUL, critical_rul: int = C.CRITICAL_RUL) -> DataFrame:
    """A48-A50 per unit: premature (alert while healthy), critical coverage,
    alert density and lead time (raw_rul at the first alert; null if never)."""
    a = F.col(alert)
    per = df.groupBy(*by, unit).agg(
        F.bool_or(a & (F.col("raw_rul") > healthy_rul)).alias("premature"),
        F.bool_or(a & (F.col("raw_rul") <= critical_rul)).alias("critical_alert"),
        F.avg(a.cast("double")).alias("alert_rate"),
    )
    first = df.where(a).groupBy(*by, unit).agg(F.min_by("raw_rul", F.col("cycle")).alias("lead_time"))
    return per.join(first, [*by, unit], "left")


def observation_rates(df: DataFrame, alert: str, by: Sequence[str] = (),
                      healthy_rul: int = C.NORMAL_REFERENCE_RUL, critical_rul: int = C.CRITICAL_RUL) -> DataFrame:
    """Percent of healthy / critical observations with an alert."""
    a = F.col(alert).cast("double")
    return df.groupBy(*by).agg(
        (100.0 * F.avg(F.when(F.col("raw_rul") > healthy_rul, a))).alias("healthy_observation_pct"),
        (100.0 * F.avg(F.when(F.col("raw_rul") <= critical_rul, a))).alias("critical_observation_pct"),
    )


def policy_long(df: DataFrame, policies: Sequence[str] = POLICIES) -> DataFrame:
    """Unpivot policy flag columns to (unit_id, cycle, raw_rul, policy, alert)."""
    return df.select("unit_id", "cycle", "raw_rul", *policies).unpivot(
        ["unit_id", "cycle", "raw_rul"], list(policies), "policy", "alert")
