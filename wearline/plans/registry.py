"""Named queries: a Spark builder plus (optionally) equivalent DuckDB SQL.

Every builder takes ``(spark, sf_dir)``, reads the driver tables under
``sf_dir`` and returns a lazy DataFrame.  The SQL, when present, is the
exact oracle the correctness check runs on the same parquet files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import with_views

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: Builder
    sql: str | None
    ops: tuple[str, ...] = field(default_factory=tuple)
    doc: str = ""
    trains: bool = False


REGISTRY: dict[str, Query] = {}


SIGNIFICANT = 8


def _sig_sql(c: str) -> str:
    d = f"least(12, greatest(0, {SIGNIFICANT - 1} - floor(log10(abs({c})))))"
    return (f"CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) OR {c} = 0 THEN {c} "
            f"ELSE round({c} * pow(10, {d}), 0) / pow(10, {d}) END")


def rounded(sql: str, cols: Sequence[str], digits: int = 6, coarse: dict | None = None) -> str:
    """Wrap oracle SQL so the listed double columns are rounded like ``finish``."""
    rep = ", ".join(f"{_sig_sql(c)} AS {c}" for c in cols)
    return f"WITH _res AS (\n{sql.strip()}\n)\nSELECT * REPLACE ({rep}) FROM _res"


def bigint_counts(sql: str) -> str:
    """Wrap every ``count_if(...)`` in ``CAST(... AS BIGINT)``: DuckDB returns
    HUGEINT for it, Spark returns bigint."""
    out, i, token = [], 0, "count_if("
    while True:
        j = sql.find(token, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if sql[max(0, j - 5):j] == "CAST(":
            out.append(sql[i:j + len(token)])
            i = j + len(token)
            continue
        depth, k = 1, j + len(token)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + "CAST(" + sql[j:k] + " AS BIGINT)")
        i = k


def register(name: str, ops: Sequence[str] = (), sql: str | None = None, views: Sequence[str] = (),
             round_cols: Sequence[str] = (), trains: bool = False, coarse: dict | None = None):
    """Decorator: record a builder under ``name`` with its oracle SQL.

    ``views`` lists fixture views (traj, obs, vecs) the SQL reads; their
    definitions are prepended as CTEs.  ``round_cols`` are double columns the
    oracle rounds to 6 digits (the Spark side rounds all doubles in ``finish``).
    """
    if name in REGISTRY:
        raise ValueError(f"duplicate query name {name}")

    def deco(fn: Builder) -> Builder:
        text = bigint_counts(sql) if sql else sql
        text = rounded(text, round_cols, coarse=coarse) if (text and round_cols) else text
        text = with_views(text, *views) if (text and views) else text
        REGISTRY[name] = Query(name, fn, text, tuple(ops), (fn.__doc__ or "").strip(), trains)
        return fn

    return deco


def round_significant(c, significant: int = SIGNIFICANT):
    """Round to ``significant`` digits with the same double arithmetic as the
    oracle: d = clamp(s - 1 - floor(log10|x|), 0, 12); round(x * 10^d) / 10^d.

    Aggregates of 2-decimal data often sit exactly on a decimal half at the
    6th decimal, where two engines' last-ulp differences flip a fixed-decimal
    round; eight significant digits lie past those terminating expansions and
    scale with the magnitude (a 1e9 variance keeps no decimals), while still
    leaving room for cancellation noise in differences of aggregates.
    """
    scale = _scale(c, significant)
    return F.when(_special(c), c).otherwise(F.round(c * scale, 0) / scale)


def _special(c):
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | (c == 0)


def _scale(c, significant: int):
    return F.pow(F.lit(10.0), F.least(F.lit(12), F.greatest(F.lit(0), F.lit(significant - 1) - F.floor(F.log10(F.abs(c))))))


def _half_up(x):
    """``round(x, 0)`` of a finite double, halves away from zero, in double
    arithmetic (Spark's ``round`` goes through the decimal text of every value).

    The fraction is exact; from 2^52 on a double has none."""
    a = F.abs(x)
    up = F.floor(a) + F.when(a - F.floor(a) >= 0.5, 1).otherwise(0)
    return F.when(a >= float(1 << 52), x).otherwise(F.when(x < 0, -up).otherwise(up).cast("double"))


#: Double columns up to which every column has a rounding of its own.
NARROW = 8


def finish(df: DataFrame) -> DataFrame:
    """Round every double column to eight significant digits (the oracle wraps
    its SQL the same way) so both engines emit identical values.

    As :func:`round_significant`.  For a wide result it is written once over an
    array of the columns: written per column, the code of the projection grows
    past what the JVM compiles.  Scales are a column of their own, so that each
    is computed once.  A narrow result stays one projection, which a limit on
    sorted rows below it takes in."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if len(doubles) <= NARROW:
        return df.select(*[round_significant(F.col(c).cast("double")).alias(c) if c in doubles else F.col(c) for c in df.columns])
    at = {c: i for i, c in enumerate(doubles)}
    wide = df.select(*[c for c in df.columns if c not in at], F.array(*[F.col(c).cast("double") for c in doubles]).alias("_values"))
    wide = wide.withColumn("_scales", F.transform("_values", lambda v: F.when(~_special(v), _scale(v, SIGNIFICANT))))
    wide = wide.withColumn("_rounded", F.zip_with(
        "_values", "_scales", lambda v, s: F.when(s.isNull(), v).otherwise(_half_up(v * s) / s)))
    return wide.select(*[F.col("_rounded")[at[c]].alias(c) if c in at else F.col(c) for c in df.columns])
