"""Split, membership and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import detect, joins, ordered, splits
from ..sources import tables
from .registry import finish, register

H52 = "('0x' || substr(md5({expr}), 1, 13))::BIGINT"
H32 = "('0x' || substr(md5({expr}), 1, 8))::BIGINT"
ROWKEY = "CAST(unit_id AS VARCHAR) || ':' || CAST(cycle AS VARCHAR) || ':42'"
UNITKEY = "CAST(unit_id AS VARCHAR) || ':42'"


@register("stratified_holdout_summary", ops=["R1", "A25", "X3"], views=["obs"], round_cols=["failure_rate"], sql=f"""
WITH h AS (SELECT unit_id, cycle, failure, {H52.format(expr=ROWKEY)} AS h FROM obs),
r AS (SELECT *, row_number() OVER (PARTITION BY failure ORDER BY h, unit_id, cycle) AS rn,
             count(*) OVER (PARTITION BY failure) AS n FROM h),
s AS (SELECT *, CASE WHEN rn <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r)
SELECT split, count(*) AS rows, CAST(sum(failure) AS BIGINT) AS failures, avg(failure) AS failure_rate
FROM s GROUP BY split""")
def stratified_holdout_summary(spark, sf_dir):
    """80/20 stratified holdout (exact class ratio) and its rows / failures /
    rate per split."""
    o = tables.obs(spark, sf_dir).select("unit_id", "cycle", "failure")
    s = splits.stratified_holdout(o, ["unit_id", "cycle"], "failure", 0.2, 42)
    return finish(s.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("failure").cast("bigint").alias("failures"),
                                         F.avg("failure").alias("failure_rate")))


@register("stratified_kfold_summary", ops=["R2"], views=["obs"], sql=f"""
WITH h AS (SELECT unit_id, cycle, failure, {H52.format(expr=ROWKEY)} AS h FROM obs),
r AS (SELECT *, CAST((row_number() OVER (PARTITION BY failure ORDER BY h, unit_id, cycle) - 1) % 5 AS INT) AS fold
      FROM h)
SELECT fold, failure, count(*) AS rows FROM r GROUP BY fold, failure""")
def stratified_kfold_summary(spark, sf_dir):
    """Rows per (fold, class) of the 5-fold stratified assignment."""
    o = tables.obs(spark, sf_dir).select("unit_id", "cycle", "failure")
    f = splits.stratified_kfold(o, ["unit_id", "cycle"], "failure", 5, 42)
    return f.groupBy("fold", "failure").agg(F.count(F.lit(1)).alias("rows"))


@register("group_kfold_audit", ops=["R3", "V17", "U2"], views=["traj"], sql=f"""
WITH f AS (SELECT unit_id, CAST({H32.format(expr=UNITKEY)} % 5 AS INT) AS fold FROM traj),
o AS (SELECT count_if(s > 1) AS overlapping_groups FROM (SELECT unit_id, count(DISTINCT fold) AS s FROM f
                                                         GROUP BY unit_id))
SELECT fold, count(*) AS rows, count(DISTINCT unit_id) AS groups, overlapping_groups FROM f, o
GROUP BY fold, overlapping_groups""")
def group_kfold_audit(spark, sf_dir):
    """Whole-unit 5-fold assignment: rows and units per fold, and the count of
    units seen in more than one fold (must be 0)."""
    f = splits.group_kfold(tables.traj(spark, sf_dir).select("unit_id", "cycle"), "unit_id", 5, 42)
    return splits.disjointness(f, "unit_id", "fold")


@register("group_kfold_balanced", ops=["R3"], views=["traj"], sql="""
WITH RECURSIVE u AS (SELECT unit_id, count(*) AS rows FROM traj GROUP BY unit_id),
o AS (SELECT *, row_number() OVER (ORDER BY rows DESC, unit_id) AS i FROM u),
deal AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS load, CAST(0 AS BIGINT) AS rows, 0 AS fold
  UNION ALL
  SELECT o.i, list_transform(d.load, lambda x, j: x + CASE WHEN j = list_position(d.load, list_min(d.load)) THEN o.rows ELSE 0 END),
         o.rows, CAST(list_position(d.load, list_min(d.load)) - 1 AS INT)
  FROM deal d JOIN o ON o.i = d.i + 1),
slots AS (SELECT rows, fold, row_number() OVER (PARTITION BY rows ORDER BY fold) AS r FROM deal WHERE i > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rows ORDER BY unit_id) AS r FROM u)
SELECT unit_id, ranked.rows, fold FROM ranked JOIN slots ON slots.rows = ranked.rows AND slots.r = ranked.r""")
def group_kfold_balanced(spark, sf_dir):
    """Whole units dealt to five folds of even row counts, the longest first."""
    return splits.balanced_group_kfold(tables.traj(spark, sf_dir).select("unit_id"), "unit_id", 5)


@register("group_shuffle_membership", ops=["R4", "J4", "U3"], views=["traj"], sql=f"""
WITH u AS (SELECT DISTINCT unit_id FROM traj),
r AS (SELECT unit_id, row_number() OVER (ORDER BY {H52.format(expr=UNITKEY)}, unit_id) AS rn,
             count(*) OVER () AS n FROM u),
held AS (SELECT unit_id FROM r WHERE rn <= ceil(n * 0.2))
SELECT 'test' AS split, count(*) AS rows, count(DISTINCT unit_id) AS units FROM traj
WHERE unit_id IN (SELECT unit_id FROM held)
UNION ALL
SELECT 'train', count(*), count(DISTINCT unit_id) FROM traj WHERE unit_id NOT IN (SELECT unit_id FROM held)""")
def group_shuffle_membership(spark, sf_dir):
    """20 % of units held out by hash order; rows selected with a semi join
    (held out) and an anti join (training), as row counts of their units."""
    units = tables.traj(spark, sf_dir).groupBy("unit_id").agg(F.count(F.lit(1)).alias("rows"))
    held = splits.group_shuffle_split(units.select("unit_id"), "unit_id", 0.2, 42).where("split = 'test'")
    test = units.join(held.select("unit_id"), "unit_id", "left_semi").withColumn("split", F.lit("test"))
    train = units.join(held.select("unit_id"), "unit_id", "left_anti").withColumn("split", F.lit("train"))
    # one row per unit: count() leaves out the null unit, as a distinct count does
    return test.unionByName(train).groupBy("split").agg(F.sum("rows").alias("rows"), F.count("unit_id").alias("units"))


@register("unit_dimension_join", ops=["J1", "U6"], views=["traj"], round_cols=["dim_s_acctbal"], sql="""
WITH u AS (SELECT unit_id, max(cycle) AS lifetime FROM traj GROUP BY unit_id)
SELECT u.unit_id, u.lifetime, s_name AS dim_s_name, s_nationkey AS dim_s_nationkey, s_acctbal AS dim_s_acctbal
FROM u JOIN supplier ON u.unit_id = supplier.s_suppkey""")
def unit_dimension_join(spark, sf_dir):
    """Per-unit lifetime joined many-to-one to the supplier dimension, after
    checking the dimension is unique on its key; dimension columns prefixed."""
    u = tables.traj(spark, sf_dir).groupBy("unit_id").agg(F.max("cycle").alias("lifetime"))
    dim = tables.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    dim = joins.prefixed(dim.withColumnRenamed("s_suppkey", "unit_id"), "dim_", keep=["unit_id"])
    return finish(joins.many_to_one(u, dim, "unit_id"))


@register("unit_reindex", ops=["J2", "A48"], views=["obs"], sql="""
WITH r AS (SELECT unit_id, score_b, max(cycle) OVER (PARTITION BY unit_id) - cycle AS raw_rul FROM obs),
a AS (SELECT unit_id, bool_or(score_b > 0.9) AS alert FROM r WHERE raw_rul <= 30 GROUP BY unit_id)
SELECT s_suppkey AS unit_id, coalesce(alert, false) AS critical_alert FROM supplier LEFT JOIN a
  ON supplier.s_suppkey = a.unit_id""")
def unit_reindex(spark, sf_dir):
    """Per-unit 'any alert in the critical stage' reindexed to the full unit
    dimension (units without rows -> false)."""
    o = detect.add_rul_targets(tables.obs(spark, sf_dir).select("unit_id", "cycle", "score_b"))
    a = o.where(F.col("raw_rul") <= 30).groupBy("unit_id").agg(F.bool_or(F.col("score_b") > 0.9).alias("alert"))
    units = tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit_id"))
    return joins.reindex(units, a, "unit_id", {"alert": False}).withColumnRenamed("alert", "critical_alert")


@register("endpoint_alignment", ops=["S3", "J3", "P6", "P7", "J1"], views=["traj"], sql="""
WITH test AS (SELECT t.unit_id, t.cycle FROM traj t JOIN supplier s ON t.unit_id = s.s_suppkey
              WHERE t.cycle <= 500 - s.s_nationkey),
labels AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS position, s_nationkey + 5 AS provided_rul
           FROM supplier WHERE s_suppkey IN (SELECT unit_id FROM test)),
units AS (SELECT unit_id, row_number() OVER (ORDER BY unit_id) AS position, max_cycle
          FROM (SELECT unit_id, max(cycle) AS max_cycle FROM test GROUP BY unit_id)),
j AS (SELECT units.unit_id, units.max_cycle AS last_observed_cycle, labels.provided_rul FROM units
      JOIN labels USING (position))
SELECT j.unit_id, last_observed_cycle, CAST(provided_rul AS BIGINT) AS provided_rul,
       last_observed_cycle + provided_rul AS implied_failure_cycle,
       CAST(count(*) AS BIGINT) AS test_rows,
       bool_and((last_observed_cycle + provided_rul - t.cycle) >= provided_rul) AS rul_at_least_label,
       min(last_observed_cycle + provided_rul - t.cycle) = provided_rul AS last_row_matches
FROM j JOIN test t USING (unit_id)
GROUP BY j.unit_id, last_observed_cycle, provided_rul""")
def endpoint_alignment(spark, sf_dir):
    """Test trajectories (each unit cut before its end) aligned by position with
    an endpoint-label list (line i = i-th smallest unit), test RUL rebuilt as
    last observed + provided - cycle, implied failure cycle."""
    t = tables.traj(spark, sf_dir).select("unit_id", "cycle")
    sup = tables.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    test = t.join(sup, t["unit_id"] == sup["s_suppkey"]).where(F.col("cycle") <= 500 - F.col("s_nationkey")).select(
        "unit_id", "cycle")
    present = test.select("unit_id").distinct()
    label_list = sup.join(present, sup["s_suppkey"] == present["unit_id"], "left_semi").select(
        "s_suppkey", (F.col("s_nationkey") + 5).cast("bigint").alias("provided_rul"))
    labels = joins.positional(label_list, "s_suppkey", "provided_rul")
    aligned = joins.align_by_position(test, "unit_id", "cycle", labels)
    rebuilt = aligned.withColumn("test_rul", F.col("last_observed_cycle") + F.col("provided_rul") - F.col("cycle"))
    return rebuilt.groupBy("unit_id", "last_observed_cycle", "provided_rul").agg(
        (F.first("last_observed_cycle") + F.first("provided_rul")).alias("implied_failure_cycle"),
        F.count(F.lit(1)).alias("test_rows"),
        F.bool_and(F.col("test_rul") >= F.col("provided_rul")).alias("rul_at_least_label"),
        (F.min("test_rul") == F.first("provided_rul")).alias("last_row_matches"),
    )


del X, ordered
