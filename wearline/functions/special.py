"""Special functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos approximation with g = 7 (published coefficients).
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
            12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
_TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 0.5."""
    z = x - 1.0
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + float(i))
    t = z + 7.5
    return F.lit(0.9189385332046727) + (z + 0.5) * F.log(t) - t + F.log(series)


def _continued_fraction(x: Column, a: Column, b: Column) -> Column:
    """Continued fraction of the incomplete beta function by Lentz's method.

    It settles within a multiple of sqrt(max(a, b)) steps; steps beyond that multiply by 1.
    """
    def away(v: Column) -> Column:
        return F.when(F.abs(v) < _TINY, _TINY).otherwise(v)

    def state(c: Column, d: Column, h: Column) -> Column:
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def half(s: Column, k: Column) -> Column:
        d = 1.0 / away(1.0 + k * s["d"])
        c = away(1.0 + k / s["c"])
        return state(c, d, s["h"] * d * c)

    def step(s: Column, m: Column) -> Column:
        m = m.cast("double")
        even = m * (b - m) * x / ((a - 1.0 + 2.0 * m) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 1.0 + 2.0 * m))
        first = F.transform(F.array(half(s, even)), lambda q: half(q, odd))  # binds the inner state once
        return F.element_at(first, 1)

    start = 1.0 / away(1.0 - (a + b) * x / (a + 1.0))
    steps = (F.lit(60.0) + 4.0 * F.sqrt(F.greatest(a, b))).cast("int")
    return F.aggregate(F.sequence(F.lit(1), steps), state(F.lit(1.0), start, start), step, lambda s: s["h"])


def log_beta_half(a: Column) -> Column:
    """ln B(a, 1/2).  For large ``a`` the ratio Gamma(a + 1/2) / Gamma(a) has a series, where the
    difference of two large logarithms would lose its digits."""
    series = 0.5 * F.log(a) - 1.0 / (8.0 * a) + 1.0 / (192.0 * a ** 3) - 1.0 / (640.0 * a ** 5) + 17.0 / (14336.0 * a ** 7)
    ratio = F.when(a > 25, series).otherwise(log_gamma(a + 0.5) - log_gamma(a))
    return F.lit(0.5723649429247001) - ratio


def regularized_beta(x: Column, a: Column, b: Column, rest: Column | None = None, log_beta: Column | None = None) -> Column:
    """I_x(a, b) for a, b >= 0.5; null outside 0 <= x <= 1.  The small side is computed directly, so it keeps its digits.

    ``rest``: 1 - x, and ``log_beta``: ln B(a, b), where they are known better than by difference.
    """
    rest = 1.0 - x if rest is None else rest
    if log_beta is None:
        log_beta = log_gamma(a) + log_gamma(b) - log_gamma(a + b)
    log_x = F.when(rest < 0.5, F.log1p(-rest)).otherwise(F.log(x))
    front = F.exp(a * log_x + b * F.log(rest) - log_beta)
    direct = front * _continued_fraction(x, a, b) / a
    other = 1.0 - front * _continued_fraction(rest, b, a) / b
    inside = F.when(x < (a + 1.0) / (a + b + 2.0), direct).otherwise(other)
    return F.when(x == 0, 0.0).when(rest == 0, 1.0).when((x > 0) & (rest > 0), inside)


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic with ``df`` degrees of freedom; null without any."""
    t, df = t.cast("double"), df.cast("double")
    infinite = F.abs(t) == float("inf")
    x, rest, half = F.when(df >= 1, df / (df + t * t)), t * t / (df + t * t), df / 2.0
    return F.when(infinite & (df >= 1), 0.0).otherwise(regularized_beta(x, half, F.lit(0.5), rest, log_beta_half(half)))


def correlation_t(r: Column, n: Column) -> Column:
    """t statistic of a correlation of ``n`` pairs (n - 2 degrees of freedom); infinite for a perfect one."""
    return F.when(F.abs(r) >= 1, F.signum(r) * float("inf")).otherwise(r * F.sqrt((n - 2) / (1 - r * r)))
