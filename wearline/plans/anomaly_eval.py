"""Detector evaluation queries.

All use the statistical detector (M16) over the ``traj`` view so that an
exact SQL oracle exists; the isolation forest plugs into the same
operators through its ``score`` column (see models plans).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import columns as X
from ..operators import detect, joins, ordered, splits, stats, studies
from ..session import materialize
from ..sources import tables
from .anomaly import FIXTURE_SENSORS, SCORED_SQL
from .metrics import P_CTE
from .registry import finish, register

S = FIXTURE_SENSORS
STAGE_KEYS = ["critical_late_life", "near_failure", "degrading", "healthy_early"]
STAGE_KEY_SQL = ("CASE WHEN raw_rul <= 30 THEN 'critical_late_life' WHEN raw_rul <= 60 THEN 'near_failure' "
                 "WHEN raw_rul <= 125 THEN 'degrading' ELSE 'healthy_early' END")
TH_SQL = "th AS (SELECT quantile_cont(score, 0.975) AS raw_threshold FROM s WHERE raw_rul > 125)"
E_SQL = "e AS (SELECT s.*, th.raw_threshold, s.score > th.raw_threshold AS exceeded FROM s CROSS JOIN th)"
POL_SQL = """pol AS (
  SELECT e.*, exceeded AS one_cycle,
         exceeded AND coalesce(lag(exceeded) OVER o, false) AS two_consecutive,
         sum(CAST(exceeded AS INT)) OVER w5 >= 3 AS three_of_five_any_history,
         count(*) OVER w5 >= 5 AND sum(CAST(exceeded AS INT)) OVER w5 >= 3 AS three_of_five,
         sum(CAST(exceeded AS INT)) OVER w5 AS recent_count, count(*) OVER w5 AS recent_size
  FROM e
  WINDOW o AS (PARTITION BY unit_id ORDER BY cycle),
         w5 AS (PARTITION BY unit_id ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


def stage_key(raw_rul: str = "raw_rul"):
    r = F.col(raw_rul)
    return F.when(r <= 30, STAGE_KEYS[0]).when(r <= 60, STAGE_KEYS[1]).when(r <= 125, STAGE_KEYS[2]).otherwise(
        STAGE_KEYS[3])


def scored_fleet(spark, sf_dir):
    """Statistical scores of every trajectory row.  The rows with their RUL and the
    fitted scaler are stored once per session; z values and score are row-local."""
    rows = tables.stored(spark, sf_dir, "fleet", lambda sp, d: detect.add_rul_targets(
        tables.traj(sp, d).select("unit_id", "cycle", *S)))
    params = tables.stored(spark, sf_dir, "scaler", lambda *_: detect.scaler_params(
        rows.where(F.col("raw_rul") > C.NORMAL_REFERENCE_RUL), S))
    return detect.statistical_scores(rows, S, params=params)


def threshold(scored, q=C.THRESHOLD_QUANTILE):
    ref = scored.where(F.col("raw_rul") > C.NORMAL_REFERENCE_RUL).select("score")
    return detect.quantile_threshold(ref, "score", q)


def flagged_fleet(spark, sf_dir):
    sc = scored_fleet(spark, sf_dir)
    return sc.crossJoin(F.broadcast(threshold(sc))).withColumn("exceeded", X.exceeded("score", "raw_threshold"))


def policies_of(spark, sf_dir, units):
    """The four persistence policies of the rows of a few ``units``: the windows are per unit."""
    return detect.alert_policies(flagged_fleet(spark, sf_dir).join(F.broadcast(units), "unit_id").select(
        "unit_id", "cycle", "raw_rul", "score", "raw_threshold", "exceeded"))


def policy_fleet(spark, sf_dir):
    """Flagged rows with all four persistence policies, stored per session."""
    return tables.stored(spark, sf_dir, "policies", lambda sp, d: detect.alert_policies(
        flagged_fleet(sp, d).select("unit_id", "cycle", "raw_rul", "score", "raw_threshold", "exceeded",
                                    *[f"z_{s}" for s in S])))


# ---------------------------------------------------------------------------

@register("alert_rates_by_stage", ops=["A44", "A43", "U4"], views=["traj"],
          round_cols=["threshold"] + STAGE_KEYS, sql=f"""
WITH {SCORED_SQL},
th AS (SELECT 0.95 AS quantile, quantile_cont(score, 0.95) AS threshold FROM s WHERE raw_rul > 125
       UNION ALL SELECT 0.975, quantile_cont(score, 0.975) FROM s WHERE raw_rul > 125
       UNION ALL SELECT 0.99, quantile_cont(score, 0.99) FROM s WHERE raw_rul > 125),
x AS (SELECT th.quantile, th.threshold, {STAGE_KEY_SQL} AS stage_key, CAST(score > threshold AS INT) AS alert
      FROM s CROSS JOIN th)
SELECT CAST(quantile AS DOUBLE) AS quantile, threshold,
       {", ".join(f"100e0 * avg(CASE WHEN stage_key = '{k}' THEN alert END) AS {k}" for k in STAGE_KEYS)}
FROM x GROUP BY quantile, threshold""")
def alert_rates_by_stage(spark, sf_dir):
    """Percent of rows over the .95/.975/.99 reference thresholds, pivoted by
    lifecycle stage."""
    sc = scored_fleet(spark, sf_dir)
    ref = sc.where(F.col("raw_rul") > C.NORMAL_REFERENCE_RUL)
    th = ordered.exact_quantiles(ref, "score", [0.95, 0.975, 0.99]).select(
        F.col("q").alias("quantile"), F.col("value").alias("threshold"))
    x = sc.select("score", stage_key().alias("stage_key")).crossJoin(F.broadcast(th)).withColumn(
        "alert", (F.col("score") > F.col("threshold")).cast("double"))
    pv = x.groupBy("quantile", "threshold").pivot("stage_key", STAGE_KEYS).agg(F.avg("alert") * 100.0)
    return finish(pv)


SUMMARY_PROBS = [0.5, 0.9, 0.95, 0.975, 0.99]
SUMMARY_NAMES = ["median", "p90", "p95", "p97_5", "p99"]


@register("reference_score_summary", ops=["A45", "F2"], views=["traj"],
          round_cols=["min", "mean", "std", "max"] + SUMMARY_NAMES, sql=f"""
WITH {SCORED_SQL}
SELECT count(*) AS n, min(score) AS min, avg(score) AS mean, stddev_samp(score) AS std, max(score) AS max,
       {", ".join(f"quantile_cont(score, {p}) AS {n}" for p, n in zip(SUMMARY_PROBS, SUMMARY_NAMES))}
FROM s WHERE raw_rul > 125""")
def reference_score_summary(spark, sf_dir):
    """Distribution of the healthy-reference scores (min, median, mean,
    sample std, p90 .. p99, max)."""
    ref = scored_fleet(spark, sf_dir).where(F.col("raw_rul") > C.NORMAL_REFERENCE_RUL)
    base = ref.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("min"), F.avg("score").alias("mean"),
                   F.stddev_samp("score").alias("std"), F.max("score").alias("max"))
    q = ordered.exact_quantiles(ref, "score", SUMMARY_PROBS)
    wide = q.groupBy().pivot("q", SUMMARY_PROBS).agg(F.first("value"))
    wide = wide.select(*[F.col(f"`{p}`").alias(n) for p, n in zip(SUMMARY_PROBS, SUMMARY_NAMES)])
    return finish(base.crossJoin(wide))


@register("development_diagnostics", ops=["M30", "A47", "A48", "A50", "G14", "J2"], views=["traj"],
          round_cols=["healthy_observation_exceedance_pct", "critical_observation_exceedance_pct",
                      "premature_unit_pct", "critical_unit_coverage_pct", "lead_time_median", "lead_time_q25",
                      "lead_time_q75"], sql=f"""
WITH {SCORED_SQL}, {TH_SQL}, {E_SQL}, {POL_SQL},
u AS (SELECT unit_id, bool_or(three_of_five AND raw_rul > 125) AS premature,
             bool_or(three_of_five AND raw_rul <= 30) AS critical_alert FROM pol GROUP BY unit_id),
l AS (SELECT unit_id, arg_min(raw_rul, cycle) AS lead_time FROM pol WHERE three_of_five GROUP BY unit_id),
ul AS (SELECT u.*, l.lead_time FROM u LEFT JOIN l USING (unit_id))
SELECT (SELECT 100e0 * avg(CAST(exceeded AS INT)) FROM e WHERE raw_rul > 125) AS healthy_observation_exceedance_pct,
       (SELECT 100e0 * avg(CAST(exceeded AS INT)) FROM e WHERE raw_rul <= 30) AS critical_observation_exceedance_pct,
       100e0 * avg(CAST(premature AS INT)) AS premature_unit_pct,
       100e0 * avg(CAST(critical_alert AS INT)) AS critical_unit_coverage_pct,
       count_if(lead_time IS NULL) AS units_never_alerted,
       quantile_cont(lead_time, 0.5) AS lead_time_median, quantile_cont(lead_time, 0.25) AS lead_time_q25,
       quantile_cont(lead_time, 0.75) AS lead_time_q75, min(lead_time) AS lead_time_min,
       max(lead_time) AS lead_time_max, count_if(lead_time > 125) AS lead_time_over_125
FROM ul""")
def development_diagnostics(spark, sf_dir):
    """Production-policy diagnostics: healthy / critical exceedance, premature
    and critical unit coverage, never-alerted units and lead-time summary."""
    pol = policy_fleet(spark, sf_dir)
    obs = detect.observation_rates(pol, "exceeded").select(
        F.col("healthy_observation_pct").alias("healthy_observation_exceedance_pct"),
        F.col("critical_observation_pct").alias("critical_observation_exceedance_pct"))
    units = pol.select("unit_id").distinct()
    per = joins.reindex(units, detect.unit_alert_summary(pol, "three_of_five"), "unit_id",
                        {"premature": False, "critical_alert": False})
    agg = per.agg(
        (100.0 * F.avg(F.col("premature").cast("double"))).alias("premature_unit_pct"),
        (100.0 * F.avg(F.col("critical_alert").cast("double"))).alias("critical_unit_coverage_pct"),
        F.count_if(F.col("lead_time").isNull()).alias("units_never_alerted"),
        F.min("lead_time").alias("lead_time_min"), F.max("lead_time").alias("lead_time_max"),
        F.count_if(F.col("lead_time") > C.RUL_CAP).alias("lead_time_over_125"))
    q = ordered.exact_quantiles(per, "lead_time", [0.5, 0.25, 0.75]).groupBy().pivot("q", [0.5, 0.25, 0.75]).agg(
        F.first("value"))
    q = q.select(F.col("`0.5`").alias("lead_time_median"), F.col("`0.25`").alias("lead_time_q25"),
                 F.col("`0.75`").alias("lead_time_q75"))
    return finish(obs.crossJoin(agg).crossJoin(q))


@register("persistence_policy_comparison", ops=["A51", "A49", "G9", "G10"], views=["traj"],
          round_cols=["healthy_observation_pct", "critical_observation_pct", "critical_unit_coverage_pct",
                      "premature_unit_pct", "alert_density_pct", "median_lead_time"], sql=f"""
WITH {SCORED_SQL}, {TH_SQL}, {E_SQL}, {POL_SQL},
lp AS ({"\nUNION ALL\n".join(f"SELECT '{p}' AS policy, unit_id, cycle, raw_rul, {p} AS alert FROM pol"
                              for p in detect.POLICIES)}),
u AS (SELECT policy, unit_id, bool_or(alert AND raw_rul > 125) AS premature,
             bool_or(alert AND raw_rul <= 30) AS critical_alert, avg(CAST(alert AS INT)) AS alert_rate
      FROM lp GROUP BY policy, unit_id),
l AS (SELECT policy, unit_id, arg_min(raw_rul, cycle) AS lead_time FROM lp WHERE alert GROUP BY policy, unit_id),
o AS (SELECT policy, 100e0 * avg(CASE WHEN raw_rul > 125 THEN CAST(alert AS INT) END) AS healthy_observation_pct,
             100e0 * avg(CASE WHEN raw_rul <= 30 THEN CAST(alert AS INT) END) AS critical_observation_pct
      FROM lp GROUP BY policy),
a AS (SELECT policy, 100e0 * avg(CAST(critical_alert AS INT)) AS critical_unit_coverage_pct,
             100e0 * avg(CAST(premature AS INT)) AS premature_unit_pct, 100e0 * avg(alert_rate) AS alert_density_pct
      FROM u GROUP BY policy),
m AS (SELECT policy, quantile_cont(lead_time, 0.5) AS median_lead_time FROM l GROUP BY policy)
SELECT * FROM o JOIN a USING (policy) LEFT JOIN m USING (policy)""")
def persistence_policy_comparison(spark, sf_dir):
    """One cycle / two consecutive / 3-of-5 (any history) / 3-of-5 (5 rows):
    healthy and critical alert rates, unit coverage, premature units, alert
    density and median lead time."""
    lp = detect.policy_long(policy_fleet(spark, sf_dir))
    obs = detect.observation_rates(lp, "alert", by=["policy"])
    per = detect.unit_alert_summary(lp, "alert", by=["policy"])
    a = per.groupBy("policy").agg(
        (100.0 * F.avg(F.col("critical_alert").cast("double"))).alias("critical_unit_coverage_pct"),
        (100.0 * F.avg(F.col("premature").cast("double"))).alias("premature_unit_pct"),
        (100.0 * F.avg("alert_rate")).alias("alert_density_pct"))
    med = ordered.exact_quantiles(per, "lead_time", [0.5], ["policy"]).select(
        "policy", F.col("value").alias("median_lead_time"))
    return finish(obs.join(a, "policy").join(med, "policy", "left"))


ZABS = [f"abs(z_{s})" for s in S]


@register("top_anomalous_rows", ops=["T4", "T5", "T1"], views=["traj"],
          round_cols=["score", "max_abs_z"], sql=f"""
WITH {SCORED_SQL},
t AS (SELECT * FROM s ORDER BY score DESC, unit_id, cycle LIMIT 50)
SELECT unit_id, cycle, score, greatest({", ".join(ZABS)}) AS max_abs_z,
       CASE {" ".join(f"WHEN abs(z_{s}) = greatest({', '.join(ZABS)}) THEN '{s}'" for s in S)} END AS extreme_sensor
FROM t""")
def top_anomalous_rows(spark, sf_dir):
    """The 50 most anomalous rows with their most extreme sensor and |z|."""
    sc = scored_fleet(spark, sf_dir)
    # row-local columns first (argmax with first-index ties), then the top-k:
    # the rounding projection above the limit only sees attributes, so the
    # plan stays TakeOrderedAndProject (per-partition top 50, no global sort)
    zmax = F.greatest(*[F.abs(f"z_{s}") for s in S])
    arg = None
    for s in S:
        arg = F.when(F.abs(f"z_{s}") == zmax, s) if arg is None else arg.when(F.abs(f"z_{s}") == zmax, s)
    rows = sc.select("unit_id", "cycle", "score", zmax.alias("max_abs_z"), arg.alias("extreme_sensor"))
    return finish(rows.orderBy(F.desc("score"), "unit_id", "cycle").limit(50))


@register("top_rows_sensor_profile", ops=["A54", "T4"], views=["traj"], round_cols=["mean_abs_z"], sql=f"""
WITH {SCORED_SQL},
t AS (SELECT * FROM s ORDER BY score DESC, unit_id, cycle LIMIT 50)
{" UNION ALL ".join(f"SELECT '{s}' AS sensor, avg(abs(z_{s})) AS mean_abs_z FROM t" for s in S)}""")
def top_rows_sensor_profile(spark, sf_dir):
    """Mean |z| per sensor over the 50 most anomalous rows."""
    sc = scored_fleet(spark, sf_dir)
    top = sc.orderBy(F.desc("score"), "unit_id", "cycle").limit(50)
    lf = stats.long_form(top.select(*[F.abs(f"z_{s}").alias(s) for s in S]), [], S, "sensor", "z")
    return finish(lf.groupBy("sensor").agg(F.avg("z").alias("mean_abs_z")))


SEEDS = [42, 52, 62, 72, 82]
CUTOFFS = [100, 125, 150]
H52_UNIT_SEED = "('0x' || substr(md5(CAST(unit_id AS VARCHAR) || ':' || CAST(seed AS VARCHAR)), 1, 13))::BIGINT"
STUDY_SQL = f"""
r AS (SELECT t.*, max(cycle) OVER (PARTITION BY unit_id) - cycle AS raw_rul FROM traj t),
params AS (SELECT seed, cutoff FROM (VALUES {", ".join(f"({x})" for x in SEEDS)}) a(seed),
                                    (VALUES {", ".join(f"({c})" for c in CUTOFFS)}) b(cutoff)),
u AS (SELECT DISTINCT unit_id FROM r),
hu AS (SELECT seed, unit_id, row_number() OVER (PARTITION BY seed ORDER BY {H52_UNIT_SEED}, unit_id) AS rn,
              count(*) OVER (PARTITION BY seed) AS n
       FROM u, (VALUES {", ".join(f"({x})" for x in SEEDS)}) a(seed)),
held AS (SELECT seed, unit_id, rn <= ceil(n * 0.2) AS held FROM hu),
x AS (SELECT params.seed, params.cutoff, r.*, held.held FROM r JOIN held USING (unit_id)
      JOIN params ON params.seed = held.seed),
p AS (SELECT seed, cutoff, {", ".join(f"avg({s}) AS {s}_mean, stddev_pop({s}) AS {s}_std" for s in S)}
      FROM x WHERE NOT held AND raw_rul > cutoff GROUP BY seed, cutoff),
zz AS (SELECT x.seed, x.cutoff, x.unit_id, x.raw_rul, x.held,
              {", ".join(f"({s} - {s}_mean) / CASE WHEN {s}_std = 0 THEN 1e0 ELSE {s}_std END AS z_{s}" for s in S)}
       FROM x JOIN p USING (seed, cutoff)),
sc AS (SELECT seed, cutoff, unit_id, raw_rul, held,
              sqrt(({" + ".join(f"z_{s} * z_{s}" for s in S)}) / {float(len(S))}) AS score
       FROM zz),
th AS (SELECT seed, cutoff, quantile_cont(score, 0.975) AS threshold FROM sc WHERE NOT held AND raw_rul > cutoff
       GROUP BY seed, cutoff),
ev AS (SELECT sc.*, th.threshold,
              rank() OVER (PARTITION BY sc.seed, sc.cutoff ORDER BY score)
                + (count(*) OVER (PARTITION BY sc.seed, sc.cutoff, score) - 1) / 2e0 AS rs,
              rank() OVER (PARTITION BY sc.seed, sc.cutoff ORDER BY raw_rul)
                + (count(*) OVER (PARTITION BY sc.seed, sc.cutoff, raw_rul) - 1) / 2e0 AS rr
       FROM sc JOIN th USING (seed, cutoff) WHERE held),
study AS (SELECT seed, cutoff, any_value(threshold) AS threshold, corr(rs, rr) AS spearman,
                 100e0 * avg(CASE WHEN raw_rul > 125 THEN CAST(score > threshold AS INT) END) AS healthy_alert_pct,
                 100e0 * avg(CASE WHEN raw_rul <= 30 THEN CAST(score > threshold AS INT) END) AS critical_alert_pct,
                 count(DISTINCT unit_id) AS held_out_units
          FROM ev GROUP BY seed, cutoff)"""


def _study(spark, sf_dir):
    """The study table, stored once per session (see :func:`_build_study`)."""
    return tables.stored(spark, sf_dir, "sensitivity-study", _build_study)


def _study_rows(spark, sf_dir, *columns):
    """Trajectory rows with ``raw_rul`` and the seeds' bits, kept while a study reads them."""
    r = detect.add_rul_targets(tables.traj(spark, sf_dir).select("unit_id", "cycle", *columns))
    bits = studies.held_bits(r.select("unit_id").distinct(), SEEDS)
    return ordered.reused(r.join(bits, "unit_id").select("unit_id", "cycle", "raw_rul", "held_bits", *columns))


def _evaluated(rows, scores, pairs, name, keep):
    """Study table of an array of scores by pair; releases what it kept.

    ``keep`` is for scores that cost more than reading an array of them."""
    scored = rows.select("unit_id", "raw_rul", "held_bits", scores.alias("scores"))
    scored = ordered.reused(scored) if keep else scored
    out = materialize(studies.evaluate(scored, pairs), name)
    scored.unpersist()
    rows.unpersist()
    return out


def _build_study(spark, sf_dir):
    """5 unit splits x 3 reference cutoffs; every fit and evaluation is a
    condition on the row's bits, so the fleet is not copied."""
    rows = _study_rows(spark, sf_dir, *S)
    pairs = studies.pairs_of(SEEDS, CUTOFFS)
    return _evaluated(rows, F.array(*studies.statistical_scores(rows, S, pairs)), pairs, "study", keep=False)


STUDY_TREES, STUDY_SAMPLES = 100, 256


def _build_forest_study(spark, sf_dir):
    """M23, forest branch: one isolation forest per pair, all grown in one job."""
    rows = _study_rows(spark, sf_dir, *S)
    pairs = studies.pairs_of(SEEDS, CUTOFFS)
    nodes, psi = studies.grow_forests(rows, S, pairs, STUDY_TREES, STUDY_SAMPLES)
    return _evaluated(rows, studies.forest_scores(rows, nodes, psi, S, pairs), pairs, "forest-study", keep=True)


@register("sensitivity_study", ops=["M23", "R4", "F2"], views=["traj"],
          round_cols=["threshold", "spearman", "healthy_alert_pct", "critical_alert_pct"],
          sql=f"WITH {STUDY_SQL}\nSELECT * FROM study")
def sensitivity_study(spark, sf_dir):
    """Repeated unit splits (5 seeds) x reference cutoffs (100/125/150): held-out
    Spearman of score vs RUL, threshold and healthy / critical alert rates."""
    return finish(_study(spark, sf_dir))


@register("sensitivity_forest_study", ops=["M23", "M13", "M14", "R4"], trains=True)
def sensitivity_forest_study(spark, sf_dir):
    """The same splits and cutoffs with the isolation forest fitted on every
    split's reference rows: threshold, held-out Spearman and alert rates."""
    return finish(tables.stored(spark, sf_dir, "forest-study", _build_forest_study))


@register("sensitivity_stability", ops=["A46", "M23"], views=["traj"],
          round_cols=[f"{m}_{a}" for m in ("spearman", "healthy_alert_pct") for a in
                      ("mean", "std", "min", "max", "median", "range")], sql=f"""
WITH {STUDY_SQL}
SELECT cutoff, count(*) AS splits,
       {", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std, min({m}) AS {m}_min, max({m}) AS {m}_max, "
                  f"quantile_cont({m}, 0.5) AS {m}_median, max({m}) - min({m}) AS {m}_range"
                  for m in ("spearman", "healthy_alert_pct"))}
FROM study GROUP BY cutoff""")
def sensitivity_stability(spark, sf_dir):
    """Across-seed stability per cutoff: mean, sample std, min, max, median and
    range of the held-out Spearman and healthy alert rate."""
    st = _study(spark, sf_dir)
    out = st.groupBy("cutoff").agg(F.count(F.lit(1)).alias("splits"), *[a for m in ("spearman", "healthy_alert_pct") for a in (
        F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"),
        F.max(m).alias(f"{m}_max"), F.median(m).alias(f"{m}_median"),
        (F.max(m) - F.min(m)).alias(f"{m}_range"))])
    return finish(out)


REP_SQL = """lu AS (SELECT unit_id, max(cycle) AS lifetime FROM traj GROUP BY unit_id),
rep AS (
  SELECT unit_id, role FROM (
    SELECT 'shortest' AS role, arg_min(unit_id, lifetime * 1e6 + unit_id) AS unit_id FROM lu
    UNION ALL SELECT 'median', arg_min(unit_id, abs(lifetime - med) * 1e6 + unit_id)
              FROM lu, (SELECT quantile_cont(lifetime, 0.5) AS med FROM lu)
    UNION ALL SELECT 'longest', arg_min(unit_id, -lifetime * 1e6 + unit_id) FROM lu))"""


def representative(spark, sf_dir):
    from .stats import representative_units
    return representative_units(spark, sf_dir)


@register("alert_timeline", ops=["M32", "A52", "G17", "G8"], views=["traj"],
          round_cols=["score", "percentile", "raw_threshold"], sql=f"""
WITH {SCORED_SQL}, {TH_SQL}, {E_SQL}, {POL_SQL}, {REP_SQL},
ref AS (SELECT score FROM s WHERE raw_rul > 125),
fa AS (SELECT unit_id, min(cycle) AS first_alert_cycle FROM pol WHERE three_of_five GROUP BY unit_id)
SELECT rep.role, pol.unit_id, pol.cycle, pol.raw_rul, pol.score,
       100e0 * (SELECT count(*) FROM ref WHERE ref.score <= pol.score) / (SELECT count(*) FROM ref) AS percentile,
       pol.raw_threshold, pol.exceeded, pol.three_of_five AS alert_active, fa.first_alert_cycle
FROM pol JOIN rep USING (unit_id) LEFT JOIN fa USING (unit_id)""")
def alert_timeline(spark, sf_dir):
    """Cycle-by-cycle percentile, threshold, exceedance and persistent alert
    for the shortest, median and longest unit, with each one's first alert."""
    rep = representative(spark, sf_dir)  # three units
    pol = policies_of(spark, sf_dir, rep.select("unit_id").distinct())
    rows = pol.join(F.broadcast(rep), "unit_id")
    ref = scored_fleet(spark, sf_dir).where(F.col("raw_rul") > C.NORMAL_REFERENCE_RUL).select("score")
    rows = ordered.ecdf_percentile(rows, "score", ref, "score", name="percentile")
    fa = pol.where("three_of_five").groupBy("unit_id").agg(F.min("cycle").alias("first_alert_cycle"))
    out = rows.join(fa, "unit_id", "left")
    return finish(out.select("role", "unit_id", "cycle", "raw_rul", "score", "percentile", "raw_threshold",
                             "exceeded", F.col("three_of_five").alias("alert_active"), "first_alert_cycle"))


TARGETS = [150, 90, 45, 15]


@register("lifecycle_inference", ops=["M33", "T6", "F5", "M29"], views=["traj"],
          round_cols=["score", "percentile"], sql=f"""
WITH {SCORED_SQL}, {TH_SQL}, {E_SQL}, {POL_SQL}, {REP_SQL},
ref AS (SELECT score FROM s WHERE raw_rul > 125),
m AS (SELECT pol.* FROM pol JOIN rep USING (unit_id) WHERE rep.role = 'median'),
tg AS (SELECT * FROM (VALUES {", ".join(f"({t})" for t in TARGETS)}) v(target_rul)),
pick AS (SELECT tg.target_rul, arg_min(m.cycle, abs(m.raw_rul - tg.target_rul) * 1e6 + m.cycle) AS cycle
         FROM tg, m GROUP BY tg.target_rul)
SELECT pick.target_rul, m.unit_id, m.cycle, m.raw_rul, m.cycle AS history_cycle_count, m.score,
       100e0 * (SELECT count(*) FROM ref WHERE ref.score <= m.score) / (SELECT count(*) FROM ref) AS percentile,
       m.exceeded, CAST(m.recent_count AS BIGINT) AS recent_count, m.three_of_five AS alert_active
FROM pick JOIN m USING (cycle)""")
def lifecycle_inference(spark, sf_dir):
    """The median-lifetime unit scored as of the cycles nearest to RUL 150 / 90
    / 45 / 15 (ties -> earliest): every feature looks back only, so the row at
    that cycle is the status of the truncated history."""
    rep = representative(spark, sf_dir).where(F.col("role") == "median")
    m = policies_of(spark, sf_dir, rep.select("unit_id"))
    tg = spark.createDataFrame([(t,) for t in TARGETS], "target_rul int")
    pick = m.crossJoin(F.broadcast(tg)).groupBy("target_rul").agg(
        F.min_by("cycle", F.struct(F.abs(F.col("raw_rul") - F.col("target_rul")), F.col("cycle"))).alias("cycle"))
    rows = m.join(pick, "cycle")
    ref = scored_fleet(spark, sf_dir).where(F.col("raw_rul") > C.NORMAL_REFERENCE_RUL).select("score")
    rows = ordered.ecdf_percentile(rows, "score", ref, "score", name="percentile")
    return finish(rows.select("target_rul", "unit_id", "cycle", "raw_rul", F.col("cycle").alias("history_cycle_count"),
                              "score", "percentile", "exceeded", F.col("recent_count").cast("bigint").alias("recent_count"),
                              F.col("three_of_five").alias("alert_active")))


CANDIDATES = ["sensor_1", "sensor_2", "sensor_3", "sensor_4"]


@register("detector_selection", ops=["M24", "A56", "G15", "A20", "A44"], views=["traj"],
          round_cols=["spearman", "healthy_median", "critical_median", "stage_gap", "healthy_alert_pct",
                      "critical_alert_pct", "mean_rank"], sql=f"""
WITH {SCORED_SQL},
l AS ({" UNION ALL ".join(f"SELECT '{c}' AS detector, unit_id, cycle, raw_rul, "
                          f"round(abs(z_{c}) * 1e9, 0) / 1e9 AS d FROM s" for c in CANDIDATES)}),
th AS (SELECT detector, quantile_cont(d, 0.975) AS t FROM l WHERE raw_rul > 125 GROUP BY detector),
k AS (SELECT l.*, th.t,
             rank() OVER (PARTITION BY detector ORDER BY d) + (count(*) OVER (PARTITION BY detector, d) - 1) / 2e0 AS rd,
             rank() OVER (PARTITION BY detector ORDER BY raw_rul)
               + (count(*) OVER (PARTITION BY detector, raw_rul) - 1) / 2e0 AS rr
      FROM l JOIN th USING (detector)),
m AS (SELECT detector, corr(rd, rr) AS spearman,
             quantile_cont(d, 0.5) FILTER (WHERE raw_rul > 125) AS healthy_median,
             quantile_cont(d, 0.5) FILTER (WHERE raw_rul <= 30) AS critical_median,
             100e0 * avg(CASE WHEN raw_rul > 125 THEN CAST(d > t AS INT) END) AS healthy_alert_pct,
             100e0 * avg(CASE WHEN raw_rul <= 30 THEN CAST(d > t AS INT) END) AS critical_alert_pct
      FROM k GROUP BY detector),
g AS (SELECT *, critical_median - healthy_median AS stage_gap FROM m),
rk AS (SELECT *,
         rank() OVER (ORDER BY spearman) + (count(*) OVER (PARTITION BY spearman) - 1) / 2e0 AS rank_spearman,
         rank() OVER (ORDER BY healthy_alert_pct) + (count(*) OVER (PARTITION BY healthy_alert_pct) - 1) / 2e0
           AS rank_healthy,
         rank() OVER (ORDER BY critical_alert_pct DESC)
           + (count(*) OVER (PARTITION BY critical_alert_pct) - 1) / 2e0 AS rank_critical
       FROM g),
mr AS (SELECT *, (rank_spearman + rank_healthy + rank_critical) / 3e0 AS mean_rank FROM rk)
SELECT *, detector = (SELECT arg_min(detector, mean_rank * 1e3 + CAST(substr(detector, 8) AS INT)) FROM mr)
          AS selected
FROM mr""")
def detector_selection(spark, sf_dir):
    """Single-sensor |z| detectors compared on held-in data (Spearman with RUL,
    healthy / critical stage medians and alert rates) and picked by the mean
    of per-metric average ranks."""
    sc = scored_fleet(spark, sf_dir)
    # scores quantised to 1e-9 so that ties (|z| of mirrored deviations) do not
    # depend on the last ulp of the fitted mean, which differs between engines
    q = lambda c: F.round(F.abs(F.col(f"z_{c}")) * 1e9, 0) / 1e9
    lf = stats.long_form(sc.select("unit_id", "cycle", "raw_rul", *[q(c).alias(c) for c in CANDIDATES]),
                         ["unit_id", "cycle", "raw_rul"], CANDIDATES, "detector", "d")
    lf = materialize(lf, "detector-long")
    healthy = F.col("raw_rul") > C.NORMAL_REFERENCE_RUL
    critical = F.col("raw_rul") <= C.CRITICAL_RUL
    th = ordered.exact_quantiles(lf.where(healthy), "d", [C.THRESHOLD_QUANTILE], ["detector"]).select(
        "detector", F.col("value").alias("t"))
    k = lf.join(F.broadcast(th), "detector")
    rho = stats.spearman(k, "d", "raw_rul", by=["detector"]).select("detector", "spearman")
    meds = ordered.exact_quantiles(lf.withColumn("stage", F.when(healthy, "h").when(critical, "c")).where(
        F.col("stage").isNotNull()), "d", [0.5], ["detector", "stage"])
    meds = meds.groupBy("detector").pivot("stage", ["h", "c"]).agg(F.first("value")).select(
        "detector", F.col("h").alias("healthy_median"), F.col("c").alias("critical_median"))
    alert = (F.col("d") > F.col("t")).cast("double")
    rates = k.groupBy("detector").agg(
        (100.0 * F.avg(F.when(healthy, alert))).alias("healthy_alert_pct"),
        (100.0 * F.avg(F.when(critical, alert))).alias("critical_alert_pct"))
    m = rho.join(meds, "detector").join(rates, "detector").withColumn(
        "stage_gap", F.col("critical_median") - F.col("healthy_median"))
    # one row per candidate detector: a proven-small table
    m = ordered.small_average_rank(m, "spearman", "rank_spearman")
    m = ordered.small_average_rank(m, "healthy_alert_pct", "rank_healthy")
    m = ordered.small_average_rank(m.withColumn("_neg_crit", -F.col("critical_alert_pct")), "_neg_crit",
                                   "rank_critical").drop("_neg_crit")
    m = m.withColumn("mean_rank", (F.col("rank_spearman") + F.col("rank_healthy") + F.col("rank_critical")) / 3.0)
    best = m.agg(F.min_by("detector", F.struct("mean_rank", "detector")).alias("_best"))
    return finish(m.crossJoin(best).withColumn("selected", F.col("detector") == F.col("_best")).drop("_best"))


ENDPOINT_SQL = """ep AS (
  SELECT p.unit_id, p.capped_rul, p.prediction - p.capped_rul AS error, abs(p.prediction - p.capped_rul) AS abs_error
  FROM p JOIN supplier s ON p.unit_id = s.s_suppkey WHERE p.raw_rul = 2 * s.s_nationkey)"""


def _endpoints(spark, sf_dir):
    from .features import _stand_in_prediction
    p = _stand_in_prediction(tables.traj(spark, sf_dir).select("unit_id", "cycle", "l_quantity"))
    sup = tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit_id"), "s_nationkey")
    e = p.join(sup, "unit_id").where(F.col("raw_rul") == 2 * F.col("s_nationkey"))
    return e.select("unit_id", "capped_rul", (F.col("prediction") - F.col("capped_rul")).alias("error"),
                    F.abs(F.col("prediction") - F.col("capped_rul")).alias("abs_error"))


@register("rul_extremes", ops=["T2", "T1", "U1"], views=["traj"], round_cols=["error", "abs_error"], sql=f"""
WITH {P_CTE}, {ENDPOINT_SQL},
k AS (
  SELECT 'best' AS kind, row_number() OVER (ORDER BY abs_error, unit_id) AS rk, * FROM ep
  UNION ALL SELECT 'worst', row_number() OVER (ORDER BY abs_error DESC, unit_id), * FROM ep
  UNION ALL SELECT 'over', row_number() OVER (ORDER BY error DESC, unit_id), * FROM ep
  UNION ALL SELECT 'under', row_number() OVER (ORDER BY error, unit_id), * FROM ep)
SELECT kind, CAST(rk AS INT) AS rk, unit_id, CAST(capped_rul AS BIGINT) AS capped_rul, error, abs_error
FROM k WHERE rk <= 8""")
def rul_extremes(spark, sf_dir):
    """8 best / worst / most over- / most under-estimated units at the endpoint
    (ties keep the smaller unit id)."""
    e = _endpoints(spark, sf_dir)
    picks = [("best", [F.col("abs_error"), F.col("unit_id")]), ("worst", [F.desc("abs_error"), F.col("unit_id")]),
             ("over", [F.desc("error"), F.col("unit_id")]), ("under", [F.col("error"), F.col("unit_id")])]
    out = None
    for kind, order in picks:
        top = e.orderBy(*order).limit(8)
        top = top.withColumn("rk", F.row_number().over(Window.orderBy(*order)).cast("int"))  # 8 rows
        top = top.withColumn("kind", F.lit(kind))
        out = top if out is None else out.unionByName(top)
    return finish(out.select("kind", "rk", "unit_id", "capped_rul", "error", "abs_error"))


@register("rul_examples", ops=["T7", "U3"], views=["traj"], round_cols=["error"], sql=f"""
WITH {P_CTE}, {ENDPOINT_SQL},
med AS (SELECT quantile_cont(capped_rul, 0.5) AS m FROM ep),
c AS (SELECT 1 AS priority, 'min_label' AS example, arg_min(unit_id, capped_rul * 1e6 + unit_id) AS unit_id FROM ep
      UNION ALL SELECT 2, 'median_label', arg_min(unit_id, abs(capped_rul - m) * 1e6 + unit_id) FROM ep, med
      UNION ALL SELECT 3, 'max_label', arg_min(unit_id, -capped_rul * 1e6 + unit_id) FROM ep
      UNION ALL SELECT 4, 'best', arg_min(unit_id, abs_error * 1e6 + unit_id) FROM ep
      UNION ALL SELECT 5, 'worst', arg_min(unit_id, -abs_error * 1e6 + unit_id) FROM ep),
d AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY priority) AS keep FROM c)
SELECT CAST(d.priority AS INT) AS priority, d.example, d.unit_id, CAST(ep.capped_rul AS BIGINT) AS capped_rul, ep.error
FROM d JOIN ep USING (unit_id) WHERE keep = 1""")
def rul_examples(spark, sf_dir):
    """Rule-based example units (min / median / max label, best, worst error),
    de-duplicated so each unit appears once at its first rule."""
    e = _endpoints(spark, sf_dir)
    med = ordered.exact_quantiles(e, "capped_rul", [0.5]).select(F.col("value").alias("_m"))
    j = e.crossJoin(F.broadcast(med))
    rules = [(1, "min_label", F.col("capped_rul")), (2, "median_label", F.abs(F.col("capped_rul") - F.col("_m"))),
             (3, "max_label", -F.col("capped_rul")), (4, "best", F.col("abs_error")), (5, "worst", -F.col("abs_error"))]
    picks = None
    for pr, name, key in rules:
        one = j.agg(F.min_by("unit_id", F.struct(key, F.col("unit_id"))).alias("unit_id")).select(
            F.lit(pr).alias("priority"), F.lit(name).alias("example"), "unit_id")
        picks = one if picks is None else picks.unionByName(one)
    keep = picks.withColumn("_k", F.row_number().over(Window.partitionBy("unit_id").orderBy("priority")))  # 5 rows
    out = keep.where("_k = 1").drop("_k").join(e, "unit_id")
    return finish(out.select("priority", "example", "unit_id", "capped_rul", "error"))


@register("hash_sample", ops=["T8", "X3"], views=["obs"], round_cols=["score_b"], sql="""
SELECT unit_id, cycle, score_b FROM obs
ORDER BY ('0x' || substr(md5(CAST(unit_id AS VARCHAR) || ':' || CAST(cycle AS VARCHAR) || ':42'), 1, 13))::BIGINT,
         unit_id, cycle
LIMIT 3000""")
def hash_sample(spark, sf_dir):
    """Deterministic sample of up to 3000 observations: smallest seeded hash."""
    o = tables.obs(spark, sf_dir).select("unit_id", "cycle", "score_b")
    h = o.withColumn("_h", splits.hash_key(["unit_id", "cycle"], 42))
    return finish(h.orderBy("_h", "unit_id", "cycle").limit(3000).drop("_h"))
