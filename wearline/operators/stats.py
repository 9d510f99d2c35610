"""Descriptive statistics and audits.

Wide-to-long first: sensor-wise statistics run on ``unpivot`` output grouped
by sensor name, so the job shape does not depend on the number of sensors
and every statistic is a partial (map-side combined) aggregate.  Exact
quantiles go through :func:`ordered.exact_quantiles`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as X
from ..session import ship_package
from .ordered import exact_quantiles, null_safe_join, prefix_sums, reused


def long_form(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "sensor",
              value: str = "value") -> DataFrame:
    """Wide numeric columns -> (ids..., name, value double)."""
    cast = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return cast.unpivot(list(ids), list(cols), name, value)


def frequency(df: DataFrame, by: Sequence[str] | str, total_over: Sequence[str] = ()) -> DataFrame:
    """Counts and percent of the total (or of each ``total_over`` group)."""
    by = [by] if isinstance(by, str) else list(by)
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    if not total_over:
        total = counts.agg(F.sum("n").alias("_total"))
        return counts.crossJoin(F.broadcast(total)).withColumn("percent", 100.0 * F.col("n") / F.col("_total")).drop("_total")
    w = Window.partitionBy(*total_over)
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(w))


def describe(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75),
             by: Sequence[str] = (), name: str = "column") -> DataFrame:
    """Count, mean, sample std, min, exact quantiles, max per column.

    Long output: one row per (by..., column) with ``p{100q}`` columns.
    """
    by = list(by)
    lf = long_form(df, by, cols, name, "value").where(F.col("value").isNotNull())
    base = lf.groupBy(*by, name).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    qs = exact_quantiles(lf, "value", probs, [*by, name])
    wide = qs.groupBy(*by, name).pivot("q", [float(p) for p in probs]).agg(F.first("value"))
    wide = wide.select(*by, name, *[F.col(f"`{float(p)}`").alias(pname(p)) for p in probs])
    return base.join(wide, [*by, name])


def pname(p: float) -> str:
    s = f"{p * 100:g}".replace(".", "_")
    return f"p{s}"


def duplicate_rows(df: DataFrame) -> Column:
    """A10 as an aggregate over ``df.groupBy(all).count()``: rows after the first."""
    return F.sum(F.col("count") - 1)


def dataset_audit(df: DataFrame, unit: str = "unit_id", cycle: str = "cycle") -> DataFrame:
    """Rows, columns, units, cycle range, null cells, duplicate rows."""
    nulls = sum((F.sum(F.col(c).isNull().cast("long")) for c in df.columns), F.lit(0))
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(unit).alias("units"),
        F.min(cycle).alias("min_cycle"), F.max(cycle).alias("max_cycle"),
        nulls.alias("null_cells"),
    )
    dups = df.groupBy(*df.columns).count().agg(
        F.coalesce(duplicate_rows(df), F.lit(0)).cast("bigint").alias("duplicate_rows"))
    kinds = {}
    for f in df.schema.fields:
        kinds[f.dataType.simpleString()] = kinds.get(f.dataType.simpleString(), 0) + 1
    dtypes = ",".join(f"{k}:{v}" for k, v in sorted(kinds.items()))
    return one.crossJoin(dups).withColumn("columns", F.lit(len(df.columns)).cast("bigint")).withColumn(
        "dtype_counts", F.lit(dtypes))


def column_audit(df: DataFrame, cols: Sequence[str], name: str = "sensor") -> DataFrame:
    """Per column mean, std, min, max, var, nunique, range,
    relative range (0 mean -> null), audit label, dominant-value share."""
    lf = long_form(df, [], cols, name, "value")
    base = lf.groupBy(name).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("minimum"), F.max("value").alias("maximum"),
        F.var_samp("value").alias("variance"), F.count_distinct("value").alias("unique_values"),
        F.count("value").alias("n"),
    )
    top = lf.groupBy(name, "value").count().groupBy(name).agg(F.max("count").alias("_top"))
    out = base.join(top, name)
    return out.select(
        name, "mean", "std", "minimum", "maximum", "variance", "unique_values",
        (F.col("maximum") - F.col("minimum")).alias("range"),
        X.safe_ratio(F.col("maximum") - F.col("minimum"), F.abs("mean")).alias("relative_range"),
        X.audit_label("unique_values").alias("audit_label"),
        (F.col("_top") / F.col("n")).alias("dominant_share"),
    )


def _safe_corr(a: str, b: str) -> Column:
    """Pearson r, null when either side is constant (``corr`` raises under ANSI)."""
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((sa == 0) | (sb == 0), F.lit(None).cast("double")).otherwise(F.corr(a, b))


def correlation_pairs(df: DataFrame, cols: Sequence[str], upper_only: bool = True) -> DataFrame:
    """Long-form Pearson matrix (a, b, r), pairwise-complete rows.

    One ``agg`` computes every pair; output has len(cols)^2 rows at most.
    """
    pairs = [(a, b) for i, a in enumerate(cols) for j, b in enumerate(cols)
             if (i < j if upper_only else True)]
    wide = df.agg(*[_safe_corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    stack = ", ".join(f"'{a}', '{b}', `{a}|{b}`" for a, b in pairs)
    return wide.selectExpr(f"stack({len(pairs)}, {stack}) AS (a, b, r)")


def target_correlation(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """R with the target per column, ranked by |r| (1 = strongest)."""
    wide = df.agg(*[_safe_corr(c, target).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = wide.selectExpr(f"stack({len(cols)}, {stack}) AS (feature, r)")
    w = Window.orderBy(F.desc(F.abs("r")), "feature")  # len(cols) rows only
    return long.withColumn("abs_r", F.abs("r")).withColumn("rank", F.row_number().over(w))


#: Ranks of ``y`` up to so many distinct values meet the rows by broadcast.
FEW_RANKS = 500_000


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of average ranks (per group when ``by``).

    The rows move once: ``y`` gets its ranks from the table of its distinct
    values, then the rows go into ranges of ``x``.  There a running count gives
    the rank, and each batch leaves only the sums that the coefficient is made
    of, shifted at the end by the rows before the batch.
    """
    ship_package(df.sparkSession)
    by = list(by)
    rows = df.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col(x).alias("_x"), F.col(y).alias("_y"))
    parts = [f"_g{i}" for i in range(len(by))]
    counts = reused(rows.groupBy(*parts, "_y").agg(F.count(F.lit(1)).alias("_n")))
    few = counts.count() <= FEW_RANKS
    ranks = prefix_sums(counts, "_y", ["_n"], parts).select(*parts, "_y", (F.col("cum__n") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias("_ry"))
    placed = null_safe_join(rows, F.broadcast(ranks) if few else ranks, [*parts, "_y"]).select(*parts, "_x", "_ry")
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a range holds all rows of its values, so the grouping needs no further exchange
    values = placed.repartitionByRange(ranges, *parts, "_x").groupBy(*parts, "_x").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_ry").alias("_r"), F.sum(F.col("_ry") * F.col("_ry")).alias("_rr"),
        F.min("_ry").alias("_low"), F.max("_ry").alias("_high"))
    in_order = values.sortWithinPartitions(*parts, "_x").select(
        *parts, "_n", "_r", "_rr", "_low", "_high", F.xxhash64(F.lit(0), *[v for c in parts for v in (F.col(c).isNull(), F.col(c))]).alias("_key"), F.spark_partition_id().alias("_range"))
    names = ["_n", "_values", "_l", "_ll", "_lr", "_r", "_rr", "_low", "_high"]
    kinds = ["long", "long", *["double"] * 7]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in in_order.schema.fields if f.name in parts], "_range int, _batch long",
                        *[f"{c} {k}" for c, k in zip(names, kinds, strict=True)]])
    sums = in_order.mapInArrow(_rank_sums(parts, names), schema)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*parts).orderBy("_range", "_batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = sums.withColumn("_o", before)  # a row per batch of values and group
    o, n, r, mean = F.col("_o"), F.sum("_n"), F.sum("_r"), (F.sum("_n") + 1) / 2.0
    var_x = F.sum(F.col("_ll") + 2.0 * o * F.col("_l") + 1.0 * F.col("_n") * o * o) - n * mean * mean
    var_y, cov = F.sum("_rr") - n * mean * mean, F.sum(F.col("_lr") + o * F.col("_r")) - r * mean
    one_value = (F.sum("_values") == 1) | (F.min("_low") == F.max("_high"))
    out = at.groupBy(*parts).agg(
        F.when(one_value, F.lit(None).cast("double")).otherwise(cov / F.sqrt(var_x * var_y)).alias("spearman"), F.coalesce(n, F.lit(0)).alias("n"))
    return out.withColumnsRenamed(dict(zip(parts, by, strict=True)))


def _rank_sums(parts: Sequence[str], names: Sequence[str]):
    """Sums over the runs of one group in each batch: rows, values, local ranks ``l`` and the other side's ranks ``r``."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for k, b in enumerate(batches):
            if not b.num_rows:
                continue
            n, r, rr, low, high, key = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_n", "_r", "_rr", "_low", "_high", "_key"))
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[starts[1:], len(n)]
            total = np.cumsum(n)
            local = total - n + (n + 1) / 2.0 - np.repeat((total - n)[starts], ends - starts)
            add = lambda v: np.add.reduceat(v, starts)
            columns = [add(n), ends - starts, add(n * local), add(n * local * local), add(local * r), add(r), add(rr),
                       np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)]
            place = [pa.array(b.column("_range").to_numpy()[starts], pa.int32()), pa.array(np.int64(k) * 1_000_000_000 + starts, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c).take(pa.array(starts)) for c in parts], *place, *[pa.array(c) for c in columns]],
                names=[*parts, "_range", "_batch", *names])
    return run


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over [min, max] of the whole column; the max lands
    in the last bin; density normalised per ``by`` group."""
    by = list(by)
    rng = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor((F.col(col) - F.col("_lo")) / F.when(width == 0, 1.0).otherwise(width)) + 1, F.lit(bins))
    binned = df.crossJoin(F.broadcast(rng)).withColumn("bin", b.cast("int"))
    counts = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.first("_lo").alias("_lo"),
                                            F.first("_hi").alias("_hi"))
    w = Window.partitionBy(*by)
    wd = (F.col("_hi") - F.col("_lo")) / bins
    return counts.select(
        *by, "bin",
        (F.col("_lo") + (F.col("bin") - 1) * wd).alias("bin_start"),
        (F.col("_lo") + F.col("bin") * wd).alias("bin_end"),
        "n",
        F.try_divide(F.col("n"), F.sum("n").over(w) * wd).alias("density"),
    )


def missingness(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing count and percent per column."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = wide.selectExpr("_n", f"stack({len(cols)}, {stack}) AS (feature, missing)")
    return long.select("feature", "missing", (100.0 * F.col("missing") / F.col("_n")).alias("missing_pct"))
