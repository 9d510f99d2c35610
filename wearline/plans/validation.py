"""Validation queries (V1-V17) over the driver tables.

Trajectory rules run on ``events``: one user = one trajectory, arrival
order = ``ts``, unit = the user but missing or foreign on rows of small
``value`` (seeded faults, so that the unit rules fire), cycle = the JSON field ``props.k`` (which has duplicates,
gaps, zeros and out-of-order values), sensor = ``value``.  The expected
trajectory dimension is ``customer`` (keys without events are ``empty``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import contracts as C
from ..operators import detect, validate
from ..sources import tables
from .registry import register

RULES = C.TRAJECTORY_RULES

_FIRST = "\n".join(f"    WHEN {r} THEN '{r}'" for r in RULES[1:])


@register("trajectory_rule_violations",
          ops=["V1", "V2", "V4", "V5", "V6", "V7", "V8", "V9", "V10", "V13", "G18", "S8"], sql=f"""
WITH e AS (
  SELECT user_id, CASE WHEN value < 0.5 THEN NULL WHEN value < 1 THEN user_id + 1 ELSE user_id END AS unit_id, ts,
         TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS c,
         TRY_CAST(value AS DOUBLE) AS v
  FROM events),
s AS (SELECT *, lag(c) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM e),
per AS (
  SELECT user_id, count(*) AS n_rows,
    sum(CASE WHEN unit_id IS NULL THEN 1 ELSE 0 END) AS un,
    count(DISTINCT unit_id) AS units,
    sum((CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 1 ELSE 0 END)
        + (CASE WHEN c IS NULL OR isnan(c) OR isinf(c) THEN 1 ELSE 0 END)) AS nn,
    count_if(c <> floor(c)) AS frac, count_if(c <= 0) AS nonpos, count(DISTINCT c) AS dc,
    count_if(c <= prev) AS ninc, count_if(c - prev <> 1) AS gaps
  FROM s GROUP BY user_id),
flags AS (
  SELECT user_id, n_rows, un > 0 AS unit_missing,
         (units + CASE WHEN un > 0 THEN 1 ELSE 0 END) <> 1 AS unit_not_unique,
         nn > 0 AS non_numeric, frac > 0 AS non_integer_cycle, nonpos > 0 AS non_positive_cycle,
         n_rows <> dc AS duplicate_cycle, ninc > 0 AS not_increasing, gaps > 0 AS not_consecutive
  FROM per),
dim AS (SELECT DISTINCT c_custkey AS user_id FROM customer),
j AS (
  SELECT dim.user_id, coalesce(n_rows, 0) AS n_rows, coalesce(n_rows, 0) = 0 AS empty,
         {", ".join(f"coalesce(n_rows, 0) > 0 AND coalesce({r}, false) AS {r}" for r in RULES[1:])}
  FROM dim LEFT JOIN flags USING (user_id))
SELECT *, CASE WHEN empty THEN 'empty'
{_FIRST}
  END AS first_error
FROM j""")
def trajectory_rule_violations(spark, sf_dir):
    """Every trajectory rule for every user, plus the first failing rule."""
    ev = tables.table(spark, sf_dir, "events")
    traj = ev.select(
        "user_id", F.when(F.col("value") < 0.5, None).when(F.col("value") < 1, F.col("user_id") + 1)
        .otherwise(F.col("user_id")).alias("unit_id"), "ts",
        F.get_json_object("props", "$.k").alias("cycle"), "value")
    dim = tables.table(spark, sf_dir, "customer").select("c_custkey")
    return validate.trajectory_violations(traj, "user_id", "unit_id", "cycle", "ts", ["value"], expected=dim)


@register("machine_rule_summary", ops=["V2", "V3", "V11", "V12"], views=["obs"], sql="""
SELECT count(*) AS n,
  count_if(type IS NULL OR type NOT IN ('L', 'M', 'H')) AS bad_type,
  count_if(air_temperature <= 0 OR process_temperature <= 0 OR rotational_speed <= 0
           OR torque < 0 OR tool_wear < 0) AS bad_range,
  count_if(NOT (isfinite(air_temperature) AND isfinite(process_temperature) AND isfinite(rotational_speed)
           AND isfinite(torque) AND isfinite(tool_wear))) AS not_finite
FROM obs""")
def machine_rule_summary(spark, sf_dir):
    """Counts of machine observations breaking the category domain, the value
    ranges or finiteness."""
    flagged = validate.machine_rule_flags(tables.obs(spark, sf_dir))
    return flagged.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad_type").alias("bad_type"),
                       F.count_if("bad_range").alias("bad_range"), F.count_if("not_finite").alias("not_finite"))


@register("rul_label_sanity", ops=["V14", "G12"], views=["traj"], sql="""
WITH r AS (SELECT unit_id, cycle, max(cycle) OVER (PARTITION BY unit_id) - cycle AS raw_rul FROM traj),
s AS (SELECT *, lag(raw_rul) OVER (PARTITION BY unit_id ORDER BY cycle) AS pr,
             lag(cycle) OVER (PARTITION BY unit_id ORDER BY cycle) AS pc FROM r)
SELECT unit_id, count_if(raw_rul < 0) AS negative_rul_rows,
       arg_max(raw_rul, cycle) = 0 AS last_row_zero,
       count_if(pr - raw_rul <> 1) = 0 AS rul_monotone,
       count_if(cycle <= pc) = 0 AS cycle_increasing
FROM s GROUP BY unit_id""")
def rul_label_sanity(spark, sf_dir):
    """Derived-label checks per unit: no negative RUL, zero on the last cycle,
    RUL decreasing by one per cycle."""
    r = detect.add_rul_targets(tables.traj(spark, sf_dir).select("unit_id", "cycle"))
    return validate.label_sanity(r)


@register("event_props_ingest", ops=["S8", "V3"], sql="""
WITH p AS (SELECT event_type, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k,
                  (NOT json_valid(props)) OR json_extract(props, '$.k') IS NULL
                    OR TRY_CAST(json_extract(props, '$.k') AS BIGINT) IS NULL AS quarantine
           FROM events)
SELECT event_type, count(*) AS rows, count_if(NOT quarantine) AS parsed, count_if(quarantine) AS quarantined,
       CAST(sum(k) FILTER (WHERE NOT quarantine) AS BIGINT) AS sum_k, max(k) FILTER (WHERE NOT quarantine) AS max_k
FROM p GROUP BY event_type""")
def event_props_ingest(spark, sf_dir):
    """Event ``props`` JSON parsed with a fixed schema; unparsable rows or rows
    without an integer ``k`` are counted as quarantined per event type."""
    from ..sources import readers
    ev = readers.parse_props(tables.table(spark, sf_dir, "events").select("event_type", "props"))
    ok = ~F.col("quarantine")
    return ev.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("parsed"), F.count_if("quarantine").alias("quarantined"),
        F.sum(F.when(ok, F.col("k"))).alias("sum_k"), F.max(F.when(ok, F.col("k"))).alias("max_k"))


@register("dataset_contract_gate", ops=["S4", "S5", "S6", "V1"], views=["traj"], sql="""
WITH a AS (SELECT count(*) AS rows, count(DISTINCT unit_id) AS units,
                  CAST(count_if(unit_id IS NULL) + count_if(cycle IS NULL) + count_if(sensor_1 IS NULL)
                       + count_if(sensor_2 IS NULL) + count_if(sensor_3 IS NULL) + count_if(sensor_4 IS NULL)
                       + count_if(sensor_5 IS NULL) AS BIGINT) AS null_cells FROM traj),
e AS (SELECT count(*) AS expected_units FROM supplier)
SELECT rows, units, null_cells, expected_units, units = expected_units AND null_cells = 0 AS contract_ok,
       'duplicate columns: [''sensor_1'']; missing required columns: [''sensor_6'']; '
       || 'target or failure-label columns are not accepted: [''rul'']; '
       || 'unexpected columns: [''l_quantity'', ''l_linenumber'', ''l_returnflag'', '' RUL '']' AS column_problems
FROM a, e""")
def dataset_contract_gate(spark, sf_dir):
    """Dataset gate: one aggregate (rows, units, missing cells) checked against
    the expected unit count from the unit dimension, plus the metadata-only
    column contract of the table as it comes with a repeated, a target and an
    absent column (duplicates, missing, forbidden and extra names)."""
    cols = ["unit_id", "cycle", "sensor_1", "sensor_2", "sensor_3", "sensor_4", "sensor_5"]
    whole = tables.traj(spark, sf_dir)
    t = validate.allow_list(whole, cols)
    faulty = whole.select("*", "sensor_1", F.col("cycle").alias(" RUL "))
    problems = "; ".join(validate.column_contract(faulty.columns, [*cols, "sensor_6"], forbid_extra=True))
    a = t.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("unit_id").alias("units"),
              sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0)).cast("bigint").alias("null_cells"))
    e = tables.table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("expected_units"))
    return a.crossJoin(e).select(
        "rows", "units", "null_cells", "expected_units",
        ((F.col("units") == F.col("expected_units")) & (F.col("null_cells") == 0)).alias("contract_ok"),
        F.lit(problems).alias("column_problems"))
