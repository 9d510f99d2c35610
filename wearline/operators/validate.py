"""Contract validation for whole fleets.

The single-trajectory checks raise on the first violation; here one job
evaluates every rule for every trajectory and returns
``(trajectory, n_rows, <rule flags>, first_error)`` so good trajectories
flow on and bad ones go to a quarantine table.  Rule precedence (V13) is a
``coalesce`` of ``when`` clauses in the contract's order.

Order rules (V9 strictly increasing, V10 consecutive) compare each row with
the previous row *in arrival order*, so the input must carry an arrival
column (Spark tables are unordered).  Arrival positions are numbered
without a per-unit sort (``number_by_bucket``) where a trajectory is huge, and
its one-row look-back runs on cycle-chunked windows, so it is split across
tasks; the rows of any other trajectory move once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType

from .. import contracts as C
from ..functions import columns as X
from .ordered import by_size, number_by_bucket
from .windows import trailing_columns


def column_contract(columns: Sequence[str], required: Sequence[str], forbid_extra: bool = False,
                    forbidden: set[str] | None = None) -> list[str]:
    """Metadata-only checks on a schema; returns the violations (empty = ok).

    Duplicate names, missing required names, forbidden (target / failure
    label) names matched on ``strip().lower()``, optional extras.
    """
    forbidden = C.TARGET_COLUMNS | C.FAILURE_LABEL_COLUMNS if forbidden is None else forbidden
    out = []
    seen, dups = set(), []
    for c in columns:
        if c in seen and c not in dups:
            dups.append(c)
        seen.add(c)
    if dups:
        out.append(f"duplicate columns: {dups}")
    missing = [c for c in required if c not in columns]
    if missing:
        out.append(f"missing required columns: {missing}")
    bad = sorted({str(c).strip().lower() for c in columns} & forbidden)
    if bad:
        out.append(f"target or failure-label columns are not accepted: {bad}")
    if forbid_extra:
        extra = [c for c in columns if c not in required]
        if extra:
            out.append(f"unexpected columns: {extra}")
    return out


def allow_list(df: DataFrame, contract: Sequence[str]) -> DataFrame:
    """Only contract columns survive, in contract order (leakage guard)."""
    problems = column_contract(df.columns, contract, forbidden=set())
    if problems:
        raise ValueError("; ".join(problems))
    return df.select(*contract)


def dataset_gate(df: DataFrame, unit: str, expected_rows: int | None = None,
                 expected_units: int | None = None, columns: Sequence[str] | None = None) -> dict:
    """One aggregate (rows, units, null cells) checked against parameters.

    Returns the measured values; raises ``ValueError`` on a mismatch.
    """
    cols = list(columns or df.columns)
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(unit).alias("units"),
        sum((F.sum(F.col(c).isNull().cast("long")) for c in cols), F.lit(0)).alias("nulls"),
    ).first()
    got = row.asDict()
    if expected_rows is not None and got["rows"] != expected_rows:
        raise ValueError(f"expected {expected_rows} rows, found {got['rows']}")
    if expected_units is not None and got["units"] != expected_units:
        raise ValueError(f"expected {expected_units} units, found {got['units']}")
    if got["nulls"]:
        raise ValueError(f"{got['nulls']} missing cells")
    return got


def _not_finite(c: Column) -> Column:
    return ~X.is_finite(c)


def _number(df: DataFrame, c: str) -> Column:
    """The column as a double, null where its text is no number; doubles and integers need no text."""
    typed = isinstance(df.schema[c].dataType, (IntegralType, DoubleType))
    return F.col(c).cast("double") if typed else F.col(c).cast("string").try_cast("double")


def trajectory_violations(
    df: DataFrame,
    key: str,
    unit: str,
    cycle: str,
    arrival: str,
    numeric: Sequence[str],
    expected: DataFrame | None = None,
    integer_typed_cycle: bool = False,
) -> DataFrame:
    """V1-V10 + V13 per trajectory ``key``.

    ``numeric`` columns may be strings (``try_cast`` decides numeric-ness).
    ``expected`` is an optional one-column dimension of trajectory keys;
    keys without rows get ``empty``.  With ``integer_typed_cycle`` (anomaly
    contract) a fractional cycle fails even when it is whole.
    """
    int_typed = isinstance(df.schema[cycle].dataType, IntegralType)
    non_num = sum((_not_finite(_number(df, c)).cast("int") for c in [*numeric, cycle]), F.lit(0))
    prepared = df.select(key, unit, arrival, _number(df, cycle).alias("_cycle"), non_num.alias("_non_num"))
    alone, large = by_size(prepared, [key])
    # rows of a trajectory move once: both orders and the totals are per key
    alone = alone.withColumn("_prev", F.lag("_cycle", 1).over(Window.partitionBy(key).orderBy(arrival))).withColumn(
        "_same", F.col("_cycle") == F.lag("_cycle", 1).over(Window.partitionBy(key).orderBy("_cycle")))
    pos = number_by_bucket(large, [key], [arrival], F.to_date(F.col(arrival).cast("timestamp")), "_pos")
    large = trailing_columns(
        pos, {"_prev": lambda w: F.lag("_cycle", 1).over(w)}, unit=key, order="_pos", lookback=1)

    def totals(stepped: DataFrame, distinct: Column) -> DataFrame:
        return stepped.groupBy(key).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.col(unit).isNull().cast("int")).alias("_unit_nulls"),
            F.min(unit).alias("_first_unit"), F.max(unit).alias("_last_unit"),
            F.sum("_non_num").alias("_non_numeric"),
            F.count_if((F.col("_cycle") != F.floor("_cycle")) | F.lit(integer_typed_cycle and not int_typed))
            .alias("_fractional"),
            F.count_if(F.col("_cycle") <= 0).alias("_non_positive"),
            F.count(F.lit(1)).alias("_n"),
            distinct.alias("_distinct_cycles"),
            F.count_if(F.col("_cycle") <= F.col("_prev")).alias("_not_increasing"),
            F.count_if((F.col("_cycle") - F.col("_prev")) != 1).alias("_gaps"),
        )

    per = totals(alone, F.count("_cycle") - F.count_if("_same")).unionByName(totals(large, F.count_distinct("_cycle")))
    flags = per.select(
        key, "n_rows",
        (F.col("_unit_nulls") > 0).alias("unit_missing"),
        (F.when(F.col("_first_unit").isNull(), False).otherwise((F.col("_unit_nulls") > 0) | (F.col("_first_unit") != F.col("_last_unit"))))
        .alias("unit_not_unique"),
        (F.col("_non_numeric") > 0).alias("non_numeric"),
        (F.col("_fractional") > 0).alias("non_integer_cycle"),
        (F.col("_non_positive") > 0).alias("non_positive_cycle"),
        (F.col("_n") != F.col("_distinct_cycles")).alias("duplicate_cycle"),
        (F.col("_not_increasing") > 0).alias("not_increasing"),
        (F.col("_gaps") > 0).alias("not_consecutive"),
    )
    if expected is not None:
        dim = expected.select(F.col(expected.columns[0]).alias(key)).distinct()
        flags = dim.join(flags, key, "left")
    rules = C.TRAJECTORY_RULES
    empty = F.coalesce(F.col("n_rows"), F.lit(0)) == 0
    out = flags.withColumn("n_rows", F.coalesce(F.col("n_rows"), F.lit(0).cast("long"))).withColumn("empty", empty)
    for r in rules[1:]:
        out = out.withColumn(r, F.when(F.col("empty"), F.lit(False)).otherwise(F.coalesce(F.col(r), F.lit(False))))
    first = F.coalesce(*[F.when(F.col(r), F.lit(r)) for r in rules])
    return out.select(key, "n_rows", *rules, first.alias("first_error"))


def valid_trajectories(df: DataFrame, unit: str, cycle: str, arrival: str, numeric: Sequence[str]) -> DataFrame:
    """Rows of the trajectories that break no rule (the gate in front of features and scoring).

    The windows behind the gate may rely on consecutive cycles (V10).  Rows
    without a unit belong to no valid trajectory."""
    return df.join(valid_units(df, unit, cycle, arrival, numeric), unit, "left_semi")


def valid_units(df: DataFrame, unit: str, cycle: str, arrival: str, numeric: Sequence[str]) -> DataFrame:
    """The units behind the gate, one row each."""
    keyed = df.withColumn("_trajectory", F.col(unit))
    checked = trajectory_violations(keyed, "_trajectory", unit, cycle, arrival, numeric)
    return checked.where(F.col("first_error").isNull()).select(F.col("_trajectory").alias(unit))


def machine_rule_flags(df: DataFrame) -> DataFrame:
    """V11/V12/V2 per observation: value ranges, category domain, finiteness."""
    pos = ["air_temperature", "process_temperature", "rotational_speed"]
    nonneg = ["torque", "tool_wear"]
    return df.withColumns({
        "bad_type": ~F.col("type").isin(*C.MACHINE_TYPES) | F.col("type").isNull(),
        "bad_range": (sum(((F.col(c) <= 0).cast("int") for c in pos), F.lit(0))
                      + sum(((F.col(c) < 0).cast("int") for c in nonneg), F.lit(0))) > 0,
        "not_finite": sum((_not_finite(F.col(c)).cast("int") for c in pos + nonneg), F.lit(0)) > 0,
    })


def label_sanity(with_rul: DataFrame, unit: str = "unit_id", cycle: str = "cycle") -> DataFrame:
    """V14/G12 per unit: raw_rul >= 0, last row has 0, RUL falls by exactly
    one per cycle (cycle strictly increasing).  A gap that falls between two
    chunks of the window shows in the unit's range against its row count."""
    stepped = trailing_columns(
        with_rul, {"_prev_rul": lambda w: F.lag("raw_rul", 1).over(w),
                   "_prev_cycle": lambda w: F.lag(cycle, 1).over(w)}, unit=unit, order=cycle, lookback=1)
    agg = stepped.groupBy(unit).agg(
        F.count_if(F.col("raw_rul") < 0).alias("negative_rul_rows"),
        F.max_by("raw_rul", cycle).alias("last_rul"),
        F.count_if(F.col("_prev_rul") - F.col("raw_rul") != 1).alias("_bad_steps"),
        F.count_if(F.col(cycle) <= F.col("_prev_cycle")).alias("_bad_cycles"),
        (F.max("raw_rul") - F.min("raw_rul") + 1 != F.count("raw_rul")).alias("_gap"),
    )
    return agg.select(unit, "negative_rul_rows", (F.col("last_rul") == 0).alias("last_row_zero"),
                      ((F.col("_bad_steps") == 0) & ~F.col("_gap")).alias("rul_monotone"),
                      (F.col("_bad_cycles") == 0).alias("cycle_increasing"))
