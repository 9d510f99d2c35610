"""Descriptive statistics and audit queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import columns as X
from ..functions import special
from ..operators import detect, ordered, stats, windows
from ..sources import tables
from .registry import finish, register

NUMERICS = ["air_temperature", "process_temperature", "rotational_speed", "torque", "tool_wear"]
SENSORS5 = ["sensor_1", "sensor_2", "sensor_3", "sensor_4", "sensor_5"]
CORR_COLS = ["sensor_1", "sensor_2", "sensor_3", "sensor_4", "l_quantity", "l_linenumber"]


def _long_sql(cols, src, ids=(), name="column"):
    id_sel = "".join(f"{i}, " for i in ids)
    return "\nUNION ALL\n".join(
        f"SELECT {id_sel}'{c}' AS {name}, CAST({c} AS DOUBLE) AS value FROM {src}" for c in cols)


@register("type_frequency", ops=["A1"], views=["obs"], round_cols=["percent"], sql="""
SELECT type, count(*) AS n, 100e0 * count(*) / sum(count(*)) OVER () AS percent FROM obs GROUP BY type""")
def type_frequency(spark, sf_dir):
    """Value counts of the machine type with percent of all rows."""
    return finish(stats.frequency(tables.obs(spark, sf_dir), "type"))


@register("type_failure_crosstab", ops=["A5", "A6"], views=["obs"], round_cols=["percent"], sql="""
SELECT type, failure, count(*) AS n,
       100e0 * count(*) / sum(count(*)) OVER (PARTITION BY type) AS percent
FROM obs GROUP BY type, failure""")
def type_failure_crosstab(spark, sf_dir):
    """Type x failure counts (long crosstab), normalised within each type."""
    return finish(stats.frequency(tables.obs(spark, sf_dir), ["type", "failure"], total_over=["type"]))


@register("failure_mode_means", ops=["A3", "A4", "U5", "X4"], views=["obs"],
          round_cols=[f"mean_{c}" for c in NUMERICS], sql=f"""
WITH m AS ({"\nUNION ALL\n".join(
    f"SELECT '{m}' AS mode, {m} AS flag, {', '.join(NUMERICS)} FROM obs" for m in C.FAILURE_MODES)})
SELECT mode, flag, count(*) AS n, {", ".join(f"avg({c}) AS mean_{c}" for c in NUMERICS)}
FROM m GROUP BY mode, flag""")
def failure_mode_means(spark, sf_dir):
    """Per failure mode and flag value: rows (flag sums) and numeric means."""
    o = tables.obs(spark, sf_dir).select(*C.FAILURE_MODES, *NUMERICS)
    long = o.unpivot(NUMERICS, C.FAILURE_MODES, "mode", "flag")
    return finish(long.groupBy("mode", "flag").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in NUMERICS]))


@register("target_group_means", ops=["A4"], views=["obs"], round_cols=[f"mean_{c}" for c in NUMERICS], sql=f"""
SELECT failure, count(*) AS n, {", ".join(f"avg({c}) AS mean_{c}" for c in NUMERICS)} FROM obs GROUP BY failure""")
def target_group_means(spark, sf_dir):
    """Numeric means by the failure target."""
    o = tables.obs(spark, sf_dir)
    return finish(o.groupBy("failure").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in NUMERICS]))


DESCRIBE_ROUND = ["mean", "std", "min", "max", "p25", "p50", "p75"]


@register("describe_machine", ops=["A7", "X4"], views=["obs"], round_cols=DESCRIBE_ROUND, sql=f"""
WITH l AS ({_long_sql(NUMERICS, "obs")})
SELECT "column", count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
       quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75,
       max(value) AS max
FROM l GROUP BY "column\"""")
def describe_machine(spark, sf_dir):
    """count, mean, sample std, min, exact 25/50/75 % and max per numeric column."""
    return finish(stats.describe(tables.obs(spark, sf_dir), NUMERICS))


PROBS8 = [0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]
P8_NAMES = [stats.pname(p) for p in PROBS8]


@register("score_describe_by_outcome", ops=["A8"], views=["obs"],
          round_cols=["mean", "std", "min", "max"] + P8_NAMES, sql=f"""
WITH l AS ({_long_sql(["score_b"], "obs", ids=["failure"])})
SELECT failure, "column", count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std,
       min(value) AS min, max(value) AS max,
       {", ".join(f"quantile_cont(value, {p}) AS {n}" for p, n in zip(PROBS8, P8_NAMES))}
FROM l GROUP BY failure, "column\"""")
def score_describe_by_outcome(spark, sf_dir):
    """Score distribution by outcome with custom exact percentiles."""
    return finish(stats.describe(tables.obs(spark, sf_dir), ["score_b"], PROBS8, by=["failure"]))


@register("dataset_audit", ops=["A9", "A10", "A57"], views=["traj"], sql="""
SELECT count(*) AS rows, count(DISTINCT unit_id) AS units, min(cycle) AS min_cycle, max(cycle) AS max_cycle,
       CAST(count_if(unit_id IS NULL) + count_if(cycle IS NULL) + count_if(sensor_1 IS NULL)
            + count_if(sensor_2 IS NULL) + count_if(sensor_3 IS NULL) + count_if(sensor_4 IS NULL)
            + count_if(sensor_5 IS NULL) + count_if(l_quantity IS NULL) + count_if(l_linenumber IS NULL)
            + count_if(l_returnflag IS NULL) AS BIGINT) AS null_cells,
       (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM
          (SELECT count(*) AS c FROM traj GROUP BY ALL_COLUMNS_PLACEHOLDER)) AS duplicate_rows,
       CAST(10 AS BIGINT) AS columns
FROM traj""".replace("GROUP BY ALL_COLUMNS_PLACEHOLDER",
                     "GROUP BY unit_id, cycle, sensor_1, sensor_2, sensor_3, sensor_4, sensor_5, l_quantity, "
                     "l_linenumber, l_returnflag"))
def dataset_audit(spark, sf_dir):
    """Rows, units, cycle range, null cells, duplicate rows, column count."""
    t = tables.traj(spark, sf_dir)
    return stats.dataset_audit(t).drop("dtype_counts").withColumn("null_cells", F.col("null_cells").cast("bigint"))


@register("unit_lifetime_summary", ops=["A11", "A12"], views=["traj"], round_cols=DESCRIBE_ROUND, sql=f"""
WITH u AS (SELECT unit_id, count(*) AS observations, max(cycle) AS lifetime FROM traj GROUP BY unit_id),
l AS ({_long_sql(["observations", "lifetime"], "u")})
SELECT "column", count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
       quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75,
       max(value) AS max
FROM l GROUP BY "column\"""")
def unit_lifetime_summary(spark, sf_dir):
    """Observations per unit and unit lifetime, each described across units."""
    t = tables.traj(spark, sf_dir)
    u = t.groupBy("unit_id").agg(F.count(F.lit(1)).alias("observations"), F.max("cycle").alias("lifetime"))
    return finish(stats.describe(u, ["observations", "lifetime"]))


AUDIT_ROUND = ["mean", "std", "minimum", "maximum", "variance", "range", "relative_range", "dominant_share"]


@register("sensor_audit", ops=["A13", "A14", "A2", "P22", "P23", "X4"], views=["traj"], round_cols=AUDIT_ROUND, sql=f"""
WITH l AS ({_long_sql(SENSORS5 + ["l_linenumber"], "traj", name="sensor")}),
top AS (SELECT sensor, max(c) AS top FROM (SELECT sensor, value, count(*) AS c FROM l GROUP BY sensor, value)
        GROUP BY sensor),
a AS (SELECT sensor, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS minimum, max(value) AS maximum,
             var_samp(value) AS variance, count(DISTINCT value) AS unique_values, count(value) AS n
      FROM l GROUP BY sensor)
SELECT a.sensor, mean, std, minimum, maximum, variance, unique_values, maximum - minimum AS range,
       (maximum - minimum) / nullif(abs(mean), 0) AS relative_range,
       CASE WHEN unique_values = 1 THEN 'constant candidate'
            WHEN unique_values <= 20 THEN 'near-constant / discrete candidate'
            ELSE 'meaningful observed variation' END AS audit_label,
       top / n AS dominant_share
FROM a JOIN top USING (sensor)""")
def sensor_audit(spark, sf_dir):
    """Per-sensor spread, uniqueness, relative range and constant / near-constant
    labels (the constant and near-constant lists are filters on this table)."""
    return finish(stats.column_audit(tables.traj(spark, sf_dir), SENSORS5 + ["l_linenumber"]))


@register("settings_audit", ops=["A15"], views=["traj"], round_cols=DESCRIBE_ROUND + ["range"], sql=f"""
WITH l AS ({_long_sql(["l_quantity", "l_linenumber"], "traj")})
SELECT "column", count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
       quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75,
       max(value) AS max, count(DISTINCT value) AS unique_values, max(value) - min(value) AS range
FROM l GROUP BY "column\"""")
def settings_audit(spark, sf_dir):
    """Describe + nunique + range of the operating-setting columns."""
    t = tables.traj(spark, sf_dir)
    d = stats.describe(t, ["l_quantity", "l_linenumber"])
    extra = stats.long_form(t, [], ["l_quantity", "l_linenumber"], "column").groupBy("column").agg(
        F.count_distinct("value").alias("unique_values"), (F.max("value") - F.min("value")).alias("range"))
    return finish(d.join(extra, "column"))


def _corr_sql(a, b):
    return (f"CASE WHEN stddev_pop({a}) = 0 OR stddev_pop({b}) = 0 THEN NULL ELSE corr({a}, {b}) END")


@register("sensor_correlations", ops=["A16", "A19", "U5"], views=["traj"], round_cols=["r"], sql="\nUNION ALL\n".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {_corr_sql(a, b)} AS r, abs({_corr_sql(a, b)}) >= 0.75 AS high FROM traj"
    for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]))
def sensor_correlations(spark, sf_dir):
    """Upper-triangle Pearson pairs in long form with the |r| >= .75 flag."""
    pairs = stats.correlation_pairs(tables.traj(spark, sf_dir), CORR_COLS)
    return finish(pairs.withColumn("high", F.abs("r") >= C.HIGH_CORRELATION))


@register("target_correlation_gain", ops=["A17", "A18"], views=["traj"], round_cols=["r_raw", "r_rolling", "gain"],
          sql=f"""
WITH r AS (SELECT t.*, max(cycle) OVER (PARTITION BY unit_id) - cycle AS raw_rul,
                  {", ".join(f"avg({s}) OVER (PARTITION BY unit_id ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS {s}_rm" for s in SENSORS5[:4])}
           FROM traj t),
c AS ({"\nUNION ALL\n".join(
    f"SELECT '{s}' AS feature, {_corr_sql(s, 'raw_rul')} AS r_raw, {_corr_sql(s + '_rm', 'raw_rul')} AS r_rolling FROM r"
    for s in SENSORS5[:4])})
SELECT feature, r_raw, r_rolling, abs(r_rolling) - abs(r_raw) AS gain,
       row_number() OVER (ORDER BY abs(r_raw) DESC, feature) AS rank
FROM c""")
def target_correlation_gain(spark, sf_dir):
    """Correlation of each sensor and of its rolling mean with raw RUL,
    ranked by |r| of the raw sensor, with the rolling gain."""
    t = tables.traj(spark, sf_dir)
    r = detect.add_rul_targets(t)
    r = windows.trailing_columns(r, {f"{s}_rm": (lambda w, s=s: F.avg(s).over(windows.rows_back(5)(w)))
                                     for s in SENSORS5[:4]})
    raw = stats.target_correlation(r, SENSORS5[:4], "raw_rul").select("feature", F.col("r").alias("r_raw"), "rank")
    roll = stats.target_correlation(r, [f"{s}_rm" for s in SENSORS5[:4]], "raw_rul").select(
        F.regexp_replace("feature", "_rm$", "").alias("feature"), F.col("r").alias("r_rolling"))
    out = raw.join(roll, "feature").withColumn("gain", F.abs("r_rolling") - F.abs("r_raw"))
    return finish(out.select("feature", "r_raw", "r_rolling", "gain", F.col("rank").cast("bigint").alias("rank")))


RANK_SQL = "rank() OVER (PARTITION BY {p} ORDER BY {x}) + (count(*) OVER (PARTITION BY {p}, {x}) - 1) / 2e0"


@register("score_rul_spearman", ops=["A20", "G15", "A22"], views=["obs"], round_cols=["spearman", "pearson", "t_stat"],
          sql=f"""
WITH r AS (SELECT score_b, max(cycle) OVER (PARTITION BY unit_id) - cycle AS raw_rul FROM obs),
k AS (SELECT *, {RANK_SQL.format(p="1", x="score_b")} AS rx, {RANK_SQL.format(p="1", x="raw_rul")} AS ry FROM r),
s AS (SELECT corr(rx, ry) AS spearman, corr(score_b, raw_rul) AS pearson, count(*) AS n FROM k)
SELECT spearman, pearson, n, spearman * sqrt((n - 2) / (1 - spearman * spearman)) AS t_stat FROM s""")
def score_rul_spearman(spark, sf_dir):
    """Global Spearman (Pearson of average ranks) and Pearson between score and
    raw RUL, with the t statistic of the rank correlation (n - 2 df)."""
    o = detect.add_rul_targets(tables.obs(spark, sf_dir).select("unit_id", "cycle", "score_b"))
    sp = stats.spearman(o, "score_b", "raw_rul")
    pe = o.agg(F.corr("score_b", "raw_rul").alias("pearson"))
    out = sp.crossJoin(pe).select("spearman", "pearson", "n")
    t = F.col("spearman") * F.sqrt((F.col("n") - 2) / (1 - F.col("spearman") * F.col("spearman")))
    return finish(out.withColumn("t_stat", t))


_SERIES_TERMS = """(SELECT coalesce(sum(exp(lgamma(k + {half}) - lgamma({half}) + lgamma({one}) - lgamma(k + {one})) * pow(c2, k)), 0)
       FROM (SELECT unnest(range(CAST({terms} AS BIGINT))) AS k))"""


@register("unit_correlation_p_values", ops=["A22"], views=["traj"], round_cols=["pearson", "t_stat", "p_value"], sql=f"""
WITH u AS (SELECT unit_id, corr(sensor_3, sensor_4) AS pearson, count(*) AS n FROM traj GROUP BY unit_id),
t AS (SELECT *, pearson * sqrt((n - 2) / (1 - pearson * pearson)) AS t_stat FROM u),
a AS (SELECT *, atan(abs(t_stat) / sqrt(n - 2)) AS theta FROM t),
c AS (SELECT *, sin(theta) AS s, cos(theta) AS co, cos(theta) * cos(theta) AS c2 FROM a)
SELECT unit_id, n, pearson, t_stat,
       1 - CASE WHEN n % 2 = 0 THEN s * {_SERIES_TERMS.format(half="0.5", one="1.0", terms="(n - 2) / 2")}
            ELSE 2 / pi() * (theta + s * co * {_SERIES_TERMS.format(half="1.0", one="1.5", terms="(n - 3) / 2")}) END AS p_value
FROM c""")
def unit_correlation_p_values(spark, sf_dir):
    """Pearson correlation of two sensors per unit with its t statistic and
    two-sided p-value (the oracle sums the finite series of integer degrees)."""
    t = tables.traj(spark, sf_dir).select("unit_id", "sensor_3", "sensor_4")
    u = t.groupBy("unit_id").agg(F.corr("sensor_3", "sensor_4").alias("pearson"), F.count(F.lit(1)).alias("n"))
    u = u.withColumn("t_stat", special.correlation_t(F.col("pearson"), F.col("n")))
    return finish(u.select("unit_id", "n", "pearson", "t_stat", special.t_p_value(F.col("t_stat"), F.col("n") - 2).alias("p_value")))


@register("unit_spearman_summary", ops=["A21"], views=["obs"], round_cols=["median", "q25", "q75"], sql=f"""
WITH r AS (SELECT unit_id, score_b, max(cycle) OVER (PARTITION BY unit_id) - cycle AS raw_rul FROM obs),
k AS (SELECT *, {RANK_SQL.format(p="unit_id", x="score_b")} AS rx,
             {RANK_SQL.format(p="unit_id", x="raw_rul")} AS ry FROM r),
u AS (SELECT unit_id, corr(rx, ry) AS rho FROM k GROUP BY unit_id)
SELECT count(rho) AS units, quantile_cont(rho, 0.5) AS median, quantile_cont(rho, 0.25) AS q25,
       quantile_cont(rho, 0.75) AS q75 FROM u""")
def unit_spearman_summary(spark, sf_dir):
    """Per-unit Spearman of score vs raw RUL, summarised by median and IQR."""
    o = detect.add_rul_targets(tables.obs(spark, sf_dir).select("unit_id", "cycle", "score_b"))
    per = stats.spearman(o, "score_b", "raw_rul", by=["unit_id"])
    q = ordered.exact_quantiles(per, "spearman", [0.5, 0.25, 0.75])
    wide = q.groupBy().pivot("q", [0.5, 0.25, 0.75]).agg(F.first("value"))
    wide = wide.select(F.col("`0.5`").alias("median"), F.col("`0.25`").alias("q25"), F.col("`0.75`").alias("q75"))
    return finish(per.agg(F.count("spearman").alias("units")).crossJoin(wide))


@register("feature_missingness", ops=["A23", "F6"], views=["traj"], round_cols=["missing_pct"], sql="\nUNION ALL\n".join(
    f"SELECT '{f}' AS feature, count_if({f} IS NULL) AS missing, 100e0 * count_if({f} IS NULL) / count(*) "
    f"AS missing_pct FROM (SELECT lag(sensor_4, 1) OVER o AS sensor_4_lag_1, lag(sensor_4, 5) OVER o AS "
    f"sensor_4_lag_5, sensor_4 - lag(sensor_4, 1) OVER o AS sensor_4_delta_1, avg(sensor_4) OVER (PARTITION BY "
    f"unit_id ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS sensor_4_rolling_mean_5 FROM traj "
    f"WINDOW o AS (PARTITION BY unit_id ORDER BY cycle))"
    for f in ["sensor_4_lag_1", "sensor_4_lag_5", "sensor_4_delta_1", "sensor_4_rolling_mean_5"]))
def feature_missingness(spark, sf_dir):
    """Missing count and percent per engineered column (the family is picked by
    a name filter over the feature table's columns)."""
    t = tables.traj(spark, sf_dir).select("unit_id", "cycle", "sensor_4")
    f = windows.add_temporal_features(t, ["sensor_4"])
    fam = [c for c in f.columns if c.startswith("sensor_4_") and not c.endswith("rolling_std_5")]
    return finish(stats.missingness(f, fam))


@register("capping_summary", ops=["A24"], views=["traj"], round_cols=["percent_above_cap"], sql="""
WITH r AS (SELECT max(cycle) OVER (PARTITION BY unit_id) - cycle AS raw_rul FROM traj)
SELECT count(*) AS rows, count_if(raw_rul > 125) AS rows_above_cap,
       100e0 * count_if(raw_rul > 125) / count(*) AS percent_above_cap FROM r""")
def capping_summary(spark, sf_dir):
    """Rows (and percent) whose raw RUL exceeds the cap."""
    r = detect.add_rul_targets(tables.traj(spark, sf_dir).select("unit_id", "cycle"))
    return finish(r.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("raw_rul") > C.RUL_CAP).alias("rows_above_cap"),
                        (100.0 * F.count_if(F.col("raw_rul") > C.RUL_CAP) / F.count(F.lit(1))).alias("percent_above_cap")))


@register("representative_units", ops=["A52", "T6"], views=["traj"], sql="""
WITH u AS (SELECT unit_id, max(cycle) AS lifetime FROM traj GROUP BY unit_id),
m AS (SELECT quantile_cont(lifetime, 0.5) AS med FROM u)
SELECT 'shortest' AS role, arg_min(unit_id, lifetime * 1e6 + unit_id) AS unit_id FROM u
UNION ALL SELECT 'median', arg_min(unit_id, abs(lifetime - med) * 1e6 + unit_id) FROM u, m
UNION ALL SELECT 'longest', arg_min(unit_id, -lifetime * 1e6 + unit_id) FROM u""")
def representative_units(spark, sf_dir):
    """Shortest, closest-to-median and longest unit (ties -> smallest id)."""
    t = tables.traj(spark, sf_dir)
    u = t.groupBy("unit_id").agg(F.max("cycle").alias("lifetime"))
    med = ordered.exact_quantiles(u, "lifetime", [0.5]).select(F.col("value").alias("med"))
    j = u.crossJoin(F.broadcast(med))
    pick = lambda role, key: j.agg(F.min_by("unit_id", F.struct(key, F.col("unit_id"))).alias("unit_id")).select(
        F.lit(role).alias("role"), "unit_id")
    return (pick("shortest", F.col("lifetime")).unionByName(pick("median", F.abs(F.col("lifetime") - F.col("med"))))
            .unionByName(pick("longest", -F.col("lifetime"))))


@register("score_histogram", ops=["A53"], views=["obs"], round_cols=["bin_start", "bin_end", "density"], sql="""
WITH r AS (SELECT min(score_b) AS lo, max(score_b) AS hi FROM obs),
b AS (SELECT failure, CAST(least(floor((score_b - lo) / CASE WHEN hi = lo THEN 1 ELSE (hi - lo) / 25 END) + 1, 25)
              AS INT) AS bin, lo, hi FROM obs, r),
c AS (SELECT failure, bin, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM b GROUP BY failure, bin)
SELECT failure, bin, lo + (bin - 1) * (hi - lo) / 25 AS bin_start, lo + bin * (hi - lo) / 25 AS bin_end, n,
       n / (sum(n) OVER (PARTITION BY failure) * ((hi - lo) / 25)) AS density
FROM c""")
def score_histogram(spark, sf_dir):
    """25 equal-width bins of the score, density normalised per class."""
    return finish(stats.histogram(tables.obs(spark, sf_dir), "score_b", 25, by=["failure"]))


@register("score_by_stage", ops=["A42", "P14", "U4"], views=["obs"], round_cols=["median", "mean"], sql=f"""
WITH r AS (SELECT *, max(cycle) OVER (PARTITION BY unit_id) - cycle AS raw_rul FROM obs),
s AS (SELECT CASE WHEN raw_rul <= 30 THEN 'Critical late life' WHEN raw_rul <= 60 THEN 'Near failure'
                  WHEN raw_rul <= 125 THEN 'Degrading' ELSE 'Healthy / early' END AS lifecycle_stage,
             score_a, score_b FROM r),
l AS (SELECT lifecycle_stage, 'score_a' AS score, score_a AS value FROM s
      UNION ALL SELECT lifecycle_stage, 'score_b', score_b FROM s)
SELECT lifecycle_stage, score, count(*) AS count, quantile_cont(value, 0.5) AS median, avg(value) AS mean
FROM l GROUP BY lifecycle_stage, score""")
def score_by_stage(spark, sf_dir):
    """count / median / mean of each score column per lifecycle stage."""
    o = detect.add_rul_targets(tables.obs(spark, sf_dir).select("unit_id", "cycle", "score_a", "score_b"))
    s = o.withColumn("lifecycle_stage", X.lifecycle_stage("raw_rul"))
    lf = stats.long_form(s, ["lifecycle_stage"], ["score_a", "score_b"], "score", "value")
    base = lf.groupBy("lifecycle_stage", "score").agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"))
    med = ordered.exact_quantiles(lf, "value", [0.5], ["lifecycle_stage", "score"]).select(
        "lifecycle_stage", "score", F.col("value").alias("median"))
    return finish(base.join(med, ["lifecycle_stage", "score"]))


@register("importance_by_family", ops=["P25", "A55"], views=["traj"], round_cols=["importance"], sql=f"""
WITH r AS (SELECT t.*, least(max(cycle) OVER (PARTITION BY unit_id) - cycle, 125) AS capped_rul,
                  lag(sensor_4, 1) OVER o AS sensor_4_lag_1,
                  avg(sensor_4) OVER w5 AS sensor_4_rolling_mean_5,
                  stddev_pop(sensor_4) OVER w5 AS sensor_4_rolling_std_5,
                  sensor_4 - lag(sensor_4, 1) OVER o AS sensor_4_delta_1
           FROM traj t
           WINDOW o AS (PARTITION BY unit_id ORDER BY cycle),
                  w5 AS (PARTITION BY unit_id ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
c AS ({"\nUNION ALL\n".join(f"SELECT '{f}' AS feature, abs({_corr_sql(f, 'capped_rul')}) AS importance FROM r" for f in
    ["cycle", "sensor_4", "sensor_4_lag_1", "sensor_4_rolling_mean_5", "sensor_4_rolling_std_5", "sensor_4_delta_1"])})
SELECT CASE WHEN feature = 'cycle' THEN 'cycle' WHEN starts_with(feature, 'operational_') THEN 'operating setting'
            WHEN contains(feature, '_rolling_mean_') THEN 'rolling mean' WHEN contains(feature, '_rolling_std_')
            THEN 'rolling std' WHEN contains(feature, '_delta_') THEN 'delta' WHEN contains(feature, '_lag_')
            THEN 'lag' ELSE 'raw sensor' END AS family, sum(importance) AS importance, count(*) AS features
FROM c GROUP BY 1""")
def importance_by_family(spark, sf_dir):
    """|r| with capped RUL per feature as a model-free importance, summed by
    feature family."""
    t = tables.traj(spark, sf_dir).select("unit_id", "cycle", "sensor_4")
    r = detect.add_rul_targets(t)
    f = windows.trailing_columns(r, {k: v for k, v in windows.temporal_feature_columns(["sensor_4"]).items()
                                     if not k.endswith("lag_5")})
    feats = ["cycle", "sensor_4"] + [c for c in f.columns if c.startswith("sensor_4_")]
    imp = stats.target_correlation(f, feats, "capped_rul").select("feature", F.abs("r").alias("importance"))
    return finish(imp.groupBy(X.feature_family("feature").alias("family")).agg(
        F.sum("importance").alias("importance"), F.count(F.lit(1)).alias("features")))
