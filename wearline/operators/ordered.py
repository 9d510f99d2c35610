"""Ordered computations without a single-partition window.

Ranks, prefix sums, exact quantiles and ECDF lookups all need a total order.
A plain ``Window.orderBy(key)`` (no partition) or a per-unit window funnels
every row of the order (or of a hot unit) through one task.  The helpers here
split the order into key ranges ("buckets") that are a pure function of the
key, so ties land together and a retried task recomputes the same bucket:

1. values are aggregated per distinct key first (map-side combine; a key
   that holds a third of all rows collapses into one row),
2. Spark's range partitioning cuts the order at sampled keys, in their own type,
3. per-bucket totals form a table of at most ``buckets`` rows per partition
   key, whose running offsets are cheap,
4. each bucket is ordered by its own task and adds its offset.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reused(df: DataFrame) -> DataFrame:
    """Persist an intermediate that the plan reads several times.

    MEMORY_AND_DISK: spills instead of failing; a lost executor's blocks are
    recomputed from lineage.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``on`` where a null key equals a null key; keeps the left side's key columns."""
    renamed = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    match = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return left.join(renamed, match, how).drop(*[f"_on_{c}" for c in on])


def prefix_sums(
    df: DataFrame,
    key: str,
    sum_cols: Sequence[str],
    partition_cols: Sequence[str] = (),
    descending: bool = False,
    buckets: int | None = None,
    prefix: str = "cum_",
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in ``key`` order.

    ``df`` must hold one row per (partition_cols, key[, tiebreak]); group
    first.  Adds ``{prefix}{c}`` for every column.  For ``descending`` the
    running sum covers keys >= the current one.  ``tiebreak`` columns order
    rows sharing a key (they stay in one bucket, so the order is total).

    The rows are dealt into key ranges by Spark's range partitioning, in the
    key's own type (64-bit ids and strings keep their order, nulls have a
    place), into as many ranges as the session has shuffle partitions unless
    ``buckets`` says otherwise.  Each range is ordered by its own task and
    shifted by the totals of the ranges before it; there is no other path.
    """
    parts = list(partition_cols)
    ordering = F.col(key).desc() if descending else F.col(key).asc()
    ranges = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = reused(df.repartitionByRange(ranges, *parts, ordering).withColumn("_ob", F.spark_partition_id()))
    totals = keyed.groupBy(*parts, "_ob").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    # one row per range (and partition key), never rows of the input
    before = Window.partitionBy(*parts).orderBy("_ob").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *parts, "_ob",
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sum_cols],
    )
    if not parts:
        offsets = F.broadcast(offsets)  # at most `ranges` rows
    joined = null_safe_join(keyed, offsets, [*parts, "_ob"])
    running = Window.partitionBy(*parts, "_ob").orderBy(ordering, *tiebreak).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return joined.select(
        *df.columns,
        *[(F.sum(c).over(running) + F.col(f"_o_{c}")).alias(f"{prefix}{c}") for c in sum_cols],
    )


#: Rows of a partition that one task may number alone.
WHOLE = 1 << 18


def sequence_number(
    df: DataFrame,
    partition_cols: Sequence[str],
    order_cols: Sequence[Column | str],
    bucket: Column,
    name: str = "seq",
    whole: int = WHOLE,
) -> DataFrame:
    """``row_number()`` per partition without sorting a hot partition in one task.

    ``bucket`` must be non-decreasing along ``order_cols`` (for example the
    day of the leading timestamp key).  Partitions of at most ``whole`` rows
    are numbered by one window, so their rows move once.  Rows of larger ones
    (at most rows / ``whole`` partitions) are numbered inside (partition,
    bucket) and shifted by the row count of earlier buckets, which is exact.
    """
    parts = list(partition_cols)
    alone, large = by_size(df, parts, whole)
    alone = alone.withColumn(name, F.row_number().over(Window.partitionBy(*parts).orderBy(*order_cols)).cast("bigint"))
    return alone.unionByName(number_by_bucket(large, parts, order_cols, bucket, name))


def by_size(df: DataFrame, parts: Sequence[str], whole: int = WHOLE) -> tuple[DataFrame, DataFrame]:
    """(rows of partitions of at most ``whole`` rows, rows of larger ones); there are at most rows / ``whole`` larger partitions."""
    large = F.broadcast(df.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > whole).select(*parts))
    return null_safe_join(df, large, parts, "left_anti"), null_safe_join(df, large, parts, "left_semi")


def number_by_bucket(df: DataFrame, parts: Sequence[str], order_cols: Sequence[Column | str], bucket: Column, name: str) -> DataFrame:
    """``row_number()`` inside (partition, bucket), shifted by the rows of earlier buckets."""
    with_b = df.withColumn("_sb", bucket)
    counts = with_b.groupBy(*parts, "_sb").agg(F.count(F.lit(1)).alias("_sn"))
    before = Window.partitionBy(*parts).orderBy("_sb").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(*parts, "_sb", F.coalesce(F.sum("_sn").over(before), F.lit(0)).alias("_so"))
    inside = Window.partitionBy(*parts, "_sb").orderBy(*order_cols)
    return (
        null_safe_join(with_b, offsets, [*parts, "_sb"])
        .withColumn(name, F.row_number().over(inside) + F.col("_so"))
        .drop("_sb", "_so")
    )


def average_rank(
    df: DataFrame,
    value_col: str,
    partition_cols: Sequence[str] = (),
    name: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Average (tie-sharing) rank of ``value_col``, 1-based, per partition.

    Distinct values are ranked through :func:`prefix_sums` and joined back
    on the value, so ties always share ``before + (count + 1) / 2``.
    """
    name = name or f"{value_col}_rank"
    parts = list(partition_cols)
    counts = df.groupBy(*parts, value_col).agg(F.count(F.lit(1)).alias("_rc"))
    ranked = prefix_sums(counts, value_col, ["_rc"], parts, buckets=buckets).select(
        *parts, value_col,
        (F.col("cum__rc") - F.col("_rc") + (F.col("_rc") + 1) / 2.0).alias(name),
    )
    return null_safe_join(df, ranked, [*parts, value_col])


def small_average_rank(df: DataFrame, value_col: str, name: str) -> DataFrame:
    """Average rank for a table with a proven small size (e.g. one row per
    candidate model): a plain window, no size check or key ranges."""
    w = Window.orderBy(value_col)
    ties = Window.partitionBy(value_col)
    return df.withColumn(name, F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def exact_quantiles(
    df: DataFrame,
    value_col: str,
    probs: Sequence[float],
    group_cols: Sequence[str] = (),
    buckets: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles (numpy default / ``quantile_cont``).

    ``weight`` names a column of positive counts where a row stands for
    several equal ones.

    Returns one row per (group, q) with columns ``q`` and ``value``.  Unlike
    ``percentile`` no task ever holds all distinct values of a group: values
    are counted per distinct value, prefix-summed in value order, and only
    the (at most two) values around each target position are kept.  Without
    groups the answer is a handful of doubles and comes back as a literal
    one-row-per-q table, so later plans do not recompute it.
    """
    spark = df.sparkSession
    parts = list(group_cols)
    vals = df.where(F.col(value_col).isNotNull())
    counts = reused(vals.groupBy(*parts, value_col).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_qc")))
    cum = prefix_sums(counts, value_col, ["_qc"], parts, buckets=buckets).withColumn(
        "_qb", F.col("cum__qc") - F.col("_qc")
    )

    def holds(pos: Column) -> Column:
        return (F.col("_qb") <= pos) & (pos < F.col("cum__qc"))

    if not parts:
        n = counts.agg(F.sum("_qc")).first()[0] or 0
        if n == 0:
            return spark.createDataFrame([(float(p), None) for p in probs], "q double, value double")
        wanted = []
        for p in probs:
            h = (n - 1) * float(p)
            wanted.append((float(p), h, int(math.floor(h)), int(math.ceil(h))))
        positions = sorted({x for _, _, lo, hi in wanted for x in (lo, hi)})
        cond = None
        for pos in positions:
            c = holds(F.lit(pos))
            cond = c if cond is None else cond | c
        rows = cum.where(cond).select(value_col, "_qb", "cum__qc").collect()  # <= 2 rows per q

        def at(pos: int) -> float:
            for r in rows:
                if r["_qb"] <= pos < r["cum__qc"]:
                    return float(r[value_col])
            raise RuntimeError("quantile position not found")

        out = [(q, at(lo) + (at(hi) - at(lo)) * (h - lo)) for q, h, lo, hi in wanted]
        return spark.createDataFrame(out, "q double, value double")

    qs = spark.createDataFrame([(float(p),) for p in probs], "q double")
    totals = counts.groupBy(*parts).agg(F.sum("_qc").alias("_qn"))
    targets = (
        totals.crossJoin(F.broadcast(qs))
        .withColumn("_h", (F.col("_qn") - 1) * F.col("q"))
        .withColumn("_lo", F.floor("_h"))
        .withColumn("_hi", F.ceil("_h"))
    )
    hit = cum.alias("c").join(targets.alias("t"), [F.col(f"c.{c}") == F.col(f"t.{c}") for c in parts]).select(
        *[F.col(f"c.{c}").alias(c) for c in parts], "c." + value_col, "c._qb", "c.cum__qc",
        "t.q", "t._h", "t._lo", "t._hi")
    hit = hit.where(holds(F.col("_lo")) | holds(F.col("_hi")))
    agg = hit.groupBy(*parts, "q").agg(
        F.max(F.when(holds(F.col("_lo")), F.col(value_col))).alias("_vlo"),
        F.max(F.when(holds(F.col("_hi")), F.col(value_col))).alias("_vhi"),
        F.first("_h").alias("_h"),
        F.first("_lo").alias("_lo"),
    )
    return agg.select(
        *parts, "q",
        (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * (F.col("_h") - F.col("_lo"))).alias("value"),
    )


def ecdf_percentile(
    queries: DataFrame,
    score_col: str,
    reference: DataFrame,
    ref_col: str,
    name: str = "percentile",
    buckets: int | None = None,
) -> DataFrame:
    """``100 * count(reference <= score) / n_reference`` for every query row.

    A null score keeps its row, with a null percentile.
    Right-inclusive ties, clipped to [0, 100].  Reference and query values
    are merged per distinct value and prefix-summed in value order; the running
    reference count of the query values alone is joined back on the value (X2).
    """
    ref = reference.where(F.col(ref_col).isNotNull()).select(F.col(ref_col).alias("_ev"), F.lit(1).cast("long").alias("_er"), F.lit(False).alias("_eq"))
    asked = queries.select(F.col(score_col).alias("_ev")).where("_ev IS NOT NULL").select("_ev", F.lit(0).cast("long").alias("_er"), F.lit(True).alias("_eq"))
    merged = ref.unionByName(asked).groupBy("_ev").agg(F.sum("_er").alias("_er"), F.max("_eq").alias("_eq"))
    n_ref = ref.agg(F.sum("_er").alias("_en"))
    cum = prefix_sums(merged, "_ev", ["_er"], buckets=buckets).where("_eq")
    table = cum.crossJoin(F.broadcast(n_ref)).select(
        "_ev",
        F.least(F.greatest(100.0 * F.col("cum__er") / F.col("_en"), F.lit(0.0)), F.lit(100.0)).alias(name),
    )
    return queries.join(table, queries[score_col] == table["_ev"], "left").drop("_ev")
