"""Per-unit backward-looking windows.

All trajectory windows are ``partitionBy(unit).orderBy(cycle)`` with a
bounded trailing frame.  A plain per-unit window sorts and buffers a whole
unit inside one task, so a unit holding a third of the fleet's rows would
serialise the job.  :func:`trailing_columns` therefore cuts every unit into
chunks of ``chunk`` consecutive cycles and copies the last ``lookback``
rows of each chunk into the next one ("halo").  Windows run per
(unit, chunk); halo copies are dropped afterwards, so every original row
sees exactly the rows a per-unit window would show it.  Units shorter than
``chunk`` cycles get no copies at all.

Requires consecutive integer cycles per unit (rule V10), which the
trajectory contract enforces; pass ``chunk=None`` for unvalidated input to
fall back to one window per unit.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DEFAULT_CHUNK = 1 << 14

WindowExpr = Callable[[WindowSpec], Column]


def trailing_columns(
    df: DataFrame,
    columns: Mapping[str, WindowExpr],
    unit: str = "unit_id",
    order: str = "cycle",
    lookback: int = 5,
    chunk: int | None = DEFAULT_CHUNK,
    partition_extra: Sequence[str] = (),
) -> DataFrame:
    """Add window columns that look at most ``lookback`` rows back.

    ``columns`` maps output names to ``fn(window_spec) -> Column``; the spec
    is already partitioned and ordered, frames are the caller's choice.
    """
    extra = list(partition_extra)
    if chunk is None:
        w = Window.partitionBy(unit, *extra).orderBy(order)
        return df.withColumns({name: fn(w) for name, fn in columns.items()})
    if lookback >= chunk:
        raise ValueError("lookback must be smaller than the chunk length")
    pos = F.col(order) - 1
    halo = F.when(
        F.pmod(pos, F.lit(chunk)) >= chunk - lookback, F.array(F.lit(0), F.lit(1))
    ).otherwise(F.array(F.lit(0)))
    spread = (
        df.withColumn("_halo", F.explode(halo))
        .withColumn("_chunk", F.floor(pos / chunk) + F.col("_halo"))
    )
    w = Window.partitionBy(unit, *extra, "_chunk").orderBy(order)
    out = spread.withColumns({name: fn(w) for name, fn in columns.items()})
    return out.where(F.col("_halo") == 0).drop("_halo", "_chunk")


def rows_back(n: int) -> Callable[[WindowSpec], WindowSpec]:
    """Frame covering the current row and the ``n - 1`` rows before it."""
    return lambda w: w.rowsBetween(-(n - 1), Window.currentRow)


def temporal_feature_columns(sensors: Sequence[str], span: int = 5) -> dict[str, WindowExpr]:
    """lag_1, lag_5, rolling_mean_5, rolling_std_5 (ddof 0), delta_1.

    Rolling statistics use min_periods 1 (a single row has std 0); lags and
    delta stay null on the first rows.
    """
    frame = rows_back(span)
    cols: dict[str, WindowExpr] = {}
    for s in sensors:
        cols[f"{s}_lag_1"] = lambda w, s=s: F.lag(s, 1).over(w)
        cols[f"{s}_lag_5"] = lambda w, s=s: F.lag(s, span).over(w)
        cols[f"{s}_rolling_mean_5"] = lambda w, s=s: F.avg(s).over(frame(w))
        cols[f"{s}_rolling_std_5"] = lambda w, s=s: F.stddev_pop(s).over(frame(w))
        cols[f"{s}_delta_1"] = lambda w, s=s: F.col(s) - F.lag(s, 1).over(w)
    return cols


def add_temporal_features(df: DataFrame, sensors: Sequence[str], unit: str = "unit_id",
                          order: str = "cycle", chunk: int | None = DEFAULT_CHUNK) -> DataFrame:
    """G2-G6 for every sensor in one pass (one exchange, one sort)."""
    return trailing_columns(df, temporal_feature_columns(sensors), unit, order, 5, chunk)


def persistence_columns(flag: str, window: int = 5, required: int = 3,
                        min_periods: int | None = None, prefix: str = "") -> dict[str, WindowExpr]:
    """Trailing ``required``-of-``window`` persistence of a boolean flag.

    ``min_periods=window`` is the production rule G8 (short history never
    alerts); ``min_periods=1`` is the research variant G9.
    """
    min_periods = window if min_periods is None else min_periods
    frame = rows_back(window)
    hits = lambda w: F.sum(F.col(flag).cast("int")).over(frame(w))
    rows = lambda w: F.count(F.lit(1)).over(frame(w))
    return {
        f"{prefix}recent_count": hits,
        f"{prefix}recent_size": rows,
        f"{prefix}persistent": lambda w: (rows(w) >= min_periods) & (hits(w) >= required),
    }


def recent_pattern_columns(flag: str, window: int = 5) -> dict[str, WindowExpr]:
    """The last min(window, n) flags in cycle order, as array and text."""
    frame = rows_back(window)
    return {"recent_pattern": lambda w: F.collect_list(F.col(flag)).over(frame(w))}


def consecutive_columns(flag: str, name: str = "two_consecutive") -> dict[str, WindowExpr]:
    """Flag and the previous flag (missing previous counts as false)."""
    return {name: lambda w: F.col(flag) & F.lag(F.col(flag), 1, False).over(w)}


def pattern_text(col: str) -> Column:
    """Render an array<boolean> as 'T,F,T' for display / oracle comparison."""
    return F.array_join(F.transform(F.col(col), lambda x: F.when(x, "T").otherwise("F")), ",")
