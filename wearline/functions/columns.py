"""Column expressions for derived values, labels and bins.

Pure expressions: no actions, no shuffles; they stay inside whole-stage
codegen.  Edge rules matter and are spelled out per function.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import contracts as C


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# P1-P3 machine features -----------------------------------------------------

def temperature_difference(process: Column | str, air: Column | str) -> Column:
    return col(process) - col(air)


def power_proxy(speed: Column | str, torque: Column | str) -> Column:
    return col(speed) * col(torque)


def strain_proxy(torque: Column | str, wear: Column | str) -> Column:
    return col(torque) * col(wear)


# P5, P9, P10 RUL arithmetic -------------------------------------------------

def capped(raw: Column | str, cap: int = C.RUL_CAP) -> Column:
    return F.least(col(raw), F.lit(cap))


def asymmetric_penalty(pred: Column | str, actual: Column | str) -> Column:
    """exp(-d/13) - 1 for early (d < 0) and exp(d/10) - 1 for late predictions."""
    d = col(pred) - col(actual)
    return F.when(d < 0, F.expm1(-d / C.PENALTY_EARLY_SCALE)).otherwise(
        F.expm1(d / C.PENALTY_LATE_SCALE)
    )


# P8 -------------------------------------------------------------------------

def row_sum(cols: Sequence[str]) -> Column:
    out = F.lit(0)
    for c in cols:
        out = out + F.col(c)
    return out


# P11-P13 risk ---------------------------------------------------------------

def score_0_100(prob: Column | str) -> Column:
    return col(prob) * 100.0


def risk_category(score: Column | str, medium: Column | str | float, high: Column | str | float,
                  critical: Column | str | float) -> Column:
    """Left-inclusive bins: < medium Low, < high Medium, < critical High, else Critical.

    Scores outside [0, 1] or NaN raise (ANSI ``raise_error``).
    """
    s = col(score)
    lit = lambda v: F.lit(v) if isinstance(v, (int, float)) else col(v)
    return (
        F.when(s.isNull() | F.isnan(s) | (s < 0) | (s > 1),
               F.raise_error(F.lit("risk score outside [0, 1]")))
        .when(s < lit(medium), F.lit(C.RISK_CATEGORIES[0]))
        .when(s < lit(high), F.lit(C.RISK_CATEGORIES[1]))
        .when(s < lit(critical), F.lit(C.RISK_CATEGORIES[2]))
        .otherwise(F.lit(C.RISK_CATEGORIES[3]))
    )


def recommended_action(category: Column | str) -> Column:
    m = F.create_map(*[F.lit(x) for kv in C.RECOMMENDED_ACTIONS.items() for x in kv])
    return m[col(category)]


# P14, P15 right-inclusive bins ---------------------------------------------

def lifecycle_stage(raw_rul: Column | str) -> Column:
    r = col(raw_rul)
    e, s = C.LIFECYCLE_EDGES, C.LIFECYCLE_STAGES
    return (F.when(r <= e[0], s[0]).when(r <= e[1], s[1]).when(r <= e[2], s[2]).otherwise(s[3]))


def lifecycle_order(raw_rul: Column | str) -> Column:
    r = col(raw_rul)
    e = C.LIFECYCLE_EDGES
    return F.when(r <= e[0], 0).when(r <= e[1], 1).when(r <= e[2], 2).otherwise(3)


def rul_band(rul: Column | str) -> Column:
    r = col(rul)
    e, b = C.RUL_BAND_EDGES, C.RUL_BANDS
    return F.when(r <= e[0], b[0]).when(r <= e[1], b[1]).otherwise(b[2])


# P16-P18 RUL output formatting ---------------------------------------------

def bounded_prediction(raw: Column | str, cap: int = C.RUL_CAP) -> Column:
    return F.least(F.greatest(col(raw), F.lit(0.0)), F.lit(float(cap)))


def rul_display(bounded: Column | str) -> Column:
    """'125+ cycle horizon' from 120 on, else the one-decimal estimate.

    ``bround`` first: Python's ``%.1f`` rounds the binary value half-even,
    Spark's ``format_string`` alone would round half-up.
    """
    b = col(bounded)
    return F.when(b >= C.LONG_HORIZON_DISPLAY_START, F.lit(C.HORIZON_TEXT)).otherwise(
        F.format_string(C.RUL_TEXT_FORMAT, F.bround(b, 1))
    )


def history_quality(n: Column | str) -> Column:
    return F.when(col(n) >= C.MINIMUM_FULL_CONTEXT_CYCLES, C.HISTORY_FULL).otherwise(C.HISTORY_LIMITED)


def guard_rul_prediction(raw: Column | str, cap: int = C.RUL_CAP) -> Column:
    """Finite and within [0, cap] up to 1e-9, else the job fails."""
    r = col(raw)
    bad = r.isNull() | F.isnan(r) | (F.abs(r) == float("inf")) | (r < -C.PREDICTION_TOLERANCE) | (
        r > cap + C.PREDICTION_TOLERANCE)
    return F.when(bad, F.raise_error(F.lit("RUL prediction outside the frozen domain."))).otherwise(r)


# P19-P27 --------------------------------------------------------------------

def decision(score: Column | str, threshold: Column | str | float) -> Column:
    """Classification decision: score >= threshold (inclusive)."""
    t = F.lit(threshold) if isinstance(threshold, (int, float)) else col(threshold)
    return col(score) >= t


def exceeded(score: Column | str, threshold: Column | str | float) -> Column:
    """Anomaly exceedance: score > threshold (strict; equality is not exceeded)."""
    t = F.lit(threshold) if isinstance(threshold, (int, float)) else col(threshold)
    return col(score) > t


def direction(z: Column | str) -> Column:
    return F.when(col(z) >= 0, C.DIRECTION_ABOVE).otherwise(C.DIRECTION_BELOW)


def audit_label(unique_count: Column | str) -> Column:
    n = col(unique_count)
    return (F.when(n == 1, C.AUDIT_CONSTANT)
            .when(n <= C.NEAR_CONSTANT_UNIQUE, C.AUDIT_NEAR_CONSTANT)
            .otherwise(C.AUDIT_MEANINGFUL))


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    return F.try_divide(col(num), col(den))


def small_sample_flag(n: Column | str) -> Column:
    return F.when(col(n) < C.SMALL_SAMPLE_N, F.lit("small sample: interpret with caution"))


def feature_family(name: Column | str) -> Column:
    """P25: family of a feature by its name; a rolling mean of a delta is a rolling mean."""
    n = col(name)
    return (F.when(n == "cycle", "cycle")
            .when(n.startswith("operational_"), "operating setting")
            .when(n.contains("_rolling_mean_"), "rolling mean")
            .when(n.contains("_rolling_std_"), "rolling std")
            .when(n.contains("_delta_"), "delta")
            .when(n.contains("_lag_"), "lag")
            .otherwise("raw sensor"))


def label_text(label: Column | str, texts: Mapping[int, str] = C.LABEL_TEXT) -> Column:
    m = F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])
    return m[col(label)]


def flip_score(native: Column | str) -> Column:
    """Higher = more unusual; a non-finite native score fails the job."""
    s = col(native)
    bad = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("detector returned a non-finite score"))).otherwise(-s)


def is_finite(c: Column | str) -> Column:
    """NaN = NaN and NaN > 1e308 are true in Spark, so test explicitly."""
    x = col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def rms(cols: Sequence[Column | str]) -> Column:
    """Root mean square across columns."""
    total = None
    for c in cols:
        sq = col(c) * col(c)
        total = sq if total is None else total + sq
    return F.sqrt(total / float(len(cols)))
