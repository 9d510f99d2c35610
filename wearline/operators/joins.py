"""Relational joins the workflows rely on.

Join strategy is left to AQE: a dimension that turns out small at runtime
is broadcast, a large one is sort-merge joined, and a skewed key on the
fact side is split by the skew-join rule.  Only tables with a proven size
bound (one-row parameter tables, a handful of thresholds) are broadcast
explicitly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import prefix_sums


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rename every column except ``keep`` with a prefix."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def unique_on(dim: DataFrame, key: str) -> DataFrame:
    """The dimension, failing the job if any key appears more than once.

    The check is lazy and distributed (a per-key count), not a driver action.
    It sits in the key itself, so no join on the key can be planned without it.
    """
    others = [c for c in dim.columns if c != key]
    g = dim.groupBy(key).agg(F.count(F.lit(1)).alias("_dup"), *[F.first(c).alias(c) for c in others])
    twice = F.raise_error(F.concat(F.lit(f"dimension is not unique on {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return g.select(F.when(F.col("_dup") > 1, twice).otherwise(F.col(key)).alias(key), *others)


def many_to_one(fact: DataFrame, dim: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Validated many-to-one equi-join."""
    return fact.join(unique_on(dim, key), key, how)


def reindex(units: DataFrame, per_unit: DataFrame, key: str, fill: Mapping[str, object]) -> DataFrame:
    """Every unit of the dimension, missing aggregates filled."""
    j = units.select(key).distinct().join(per_unit, key, "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def positional(df: DataFrame, order_col: str, value_col: str) -> DataFrame:
    """S3: (position, value) where position is the 1-based rank of
    ``order_col`` (the line number of a positional label file)."""
    ranked = prefix_sums(df.select(order_col, value_col).withColumn("_one", F.lit(1)), order_col, ["_one"])
    return ranked.select(F.col("cum__one").alias("position"), value_col)


def align_by_position(rows: DataFrame, unit: str, cycle: str, labels: DataFrame) -> DataFrame:
    """Attach the i-th label to the i-th smallest unit.

    Unit and label counts must agree (checked lazily); adds
    ``last_observed_cycle`` and the label columns to every row.
    """
    units = rows.groupBy(unit).agg(F.max(cycle).alias("last_observed_cycle"))
    ranked = prefix_sums(units.withColumn("_one", F.lit(1)), unit, ["_one"]).withColumnRenamed("cum__one", "position")
    counts = units.agg(F.count(F.lit(1)).alias("_nu")).crossJoin(labels.agg(F.count(F.lit(1)).alias("_nl")))
    checked = ranked.crossJoin(F.broadcast(counts)).withColumn(
        "position", F.when(F.col("_nu") != F.col("_nl"), F.raise_error(F.lit("label count differs from unit count")))
        .otherwise(F.col("position"))).drop("_nu", "_nl", "_one")
    aligned = checked.join(labels, "position")
    return rows.join(aligned.drop("position"), unit)
