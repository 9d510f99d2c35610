"""Classification, calibration and regression evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import detect, joins, metrics, splits, stats
from ..sources import tables
from .features import PRED_SQL, THRESHOLDS, _stand_in_prediction
from .registry import finish, register

PR_SQL = """
g AS (SELECT {score} AS threshold, count(*) AS n, sum(failure) AS pos FROM obs GROUP BY {score}),
c AS (SELECT *, sum(n) OVER (ORDER BY threshold DESC) AS cum_n, sum(pos) OVER (ORDER BY threshold DESC) AS cum_pos,
             sum(pos) OVER () AS total_pos FROM g),
pr AS (SELECT threshold, n, CAST(pos AS BIGINT) AS pos, CAST(cum_n AS BIGINT) AS predicted_positive,
              CAST(cum_pos AS BIGINT) AS tp, cum_pos / cum_n AS precision, cum_pos / nullif(total_pos, 0) AS recall,
              pos / nullif(total_pos, 0) AS recall_step FROM c),
prf AS (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM pr)"""


@register("pr_curve", ops=["A34", "X1"], views=["obs"],
          round_cols=["threshold", "precision", "recall", "f1", "recall_step"],
          sql=f"WITH {PR_SQL.format(score='score_b')}\nSELECT * FROM prf")
def pr_curve(spark, sf_dir):
    """Precision, recall and F1 of score >= t for every distinct score t."""
    return finish(metrics.pr_curve(tables.obs(spark, sf_dir), "score_b", "failure"))


@register("operating_points", ops=["A35"], views=["obs"], round_cols=["threshold", "precision", "recall", "f1"],
          sql=f"""
WITH {PR_SQL.format(score='score_b')},
ch AS (
  SELECT 'medium' AS policy, (SELECT threshold FROM prf WHERE recall >= 0.9
                              ORDER BY precision DESC, threshold DESC LIMIT 1) AS threshold
  UNION ALL SELECT 'high', (SELECT threshold FROM prf WHERE precision >= 0.9 ORDER BY recall DESC, threshold LIMIT 1)
  UNION ALL SELECT 'critical', (SELECT threshold FROM prf WHERE precision >= 0.95
                                ORDER BY recall DESC, threshold LIMIT 1)
  UNION ALL SELECT 'best_f1', (SELECT threshold FROM prf WHERE f1 IS NOT NULL ORDER BY f1 DESC, threshold LIMIT 1))
SELECT ch.policy, ch.threshold, prf.precision, prf.recall, prf.f1,
       (SELECT coalesce(0 < m AND m < h AND h < c AND c < 1, false) FROM (
          SELECT max(CASE WHEN policy = 'medium' THEN threshold END) AS m, max(CASE WHEN policy = 'high' THEN threshold END) AS h,
                 max(CASE WHEN policy = 'critical' THEN threshold END) AS c FROM ch)) AS thresholds_ordered
FROM ch LEFT JOIN prf USING (threshold)""")
def operating_points(spark, sf_dir):
    """Medium / High / Critical / best-F1 thresholds picked on the PR curve, and
    whether they rise from medium to critical inside (0, 1)."""
    curve = metrics.pr_curve(tables.obs(spark, sf_dir), "score_b", "failure")
    return finish(metrics.thresholds_ordered(metrics.operating_points(curve)))


@register("ranking_metrics", ops=["A30", "A31", "A32", "A33", "M25", "U5"], views=["obs"],
          round_cols=["brier", "log_loss", "roc_auc", "average_precision"], sql=f"""
WITH l AS (SELECT 'score_a' AS score, score_a AS p, failure FROM obs UNION ALL
           SELECT 'score_b', least(score_b, 1e0), failure FROM obs),
k AS (SELECT *, rank() OVER (PARTITION BY score ORDER BY p) + (count(*) OVER (PARTITION BY score, p) - 1) / 2e0 AS rk
      FROM l),
auc AS (SELECT score, (sum(CASE WHEN failure = 1 THEN rk ELSE 0 END) - sum(failure) * (sum(failure) + 1) / 2e0)
                      / (sum(failure) * (count(*) - sum(failure))) AS roc_auc FROM k GROUP BY score),
g AS (SELECT score, p, count(*) AS n, sum(failure) AS pos FROM l GROUP BY score, p),
c AS (SELECT *, sum(n) OVER (PARTITION BY score ORDER BY p DESC) AS cn,
             sum(pos) OVER (PARTITION BY score ORDER BY p DESC) AS cp,
             sum(pos) OVER (PARTITION BY score) AS tp FROM g),
ap AS (SELECT score, sum(pos / tp * (cp / cn)) AS average_precision FROM c GROUP BY score),
bl AS (SELECT score, avg((p - failure) * (p - failure)) AS brier,
              avg(-(failure * ln(greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16))
                  + (1 - failure) * ln(1 - greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16))))
                AS log_loss FROM l GROUP BY score)
SELECT score, brier, log_loss, roc_auc, average_precision FROM bl JOIN auc USING (score) JOIN ap USING (score)""")
def ranking_metrics(spark, sf_dir):
    """Brier, log loss, tie-aware ROC AUC and step average precision for each
    score column (scores unpivoted, metrics grouped by score name)."""
    o = tables.obs(spark, sf_dir).select("failure", "score_a", F.least("score_b", F.lit(1.0)).alias("score_b"))
    lf = stats.long_form(o, ["failure"], ["score_a", "score_b"], "score", "p")
    bl = metrics.probability_scores(lf, "p", "failure", by=["score"])
    auc = metrics.roc_auc(lf, "p", "failure", by=["score"])
    ap = metrics.average_precision(metrics.pr_curve(lf, "p", "failure", by=["score"]), by=["score"])
    return finish(bl.join(auc, "score").join(ap, "score"))


POLICY_ROWS = [("medium", THRESHOLDS["medium"]), ("high", THRESHOLDS["high"]),
               ("critical", THRESHOLDS["critical"]), ("default", 0.5)]
POLICY_SQL = "(VALUES " + ", ".join(f"('{p}', {t}e0)" for p, t in POLICY_ROWS) + ") v(policy, threshold)"


@register("policy_confusion", ops=["A27", "A28"], views=["obs"],
          round_cols=["threshold", "accuracy", "precision", "recall", "f1"], sql=f"""
WITH c AS (
  SELECT policy, threshold, count_if(score_a < threshold AND failure = 0) AS tn,
         count_if(score_a >= threshold AND failure = 0) AS fp, count_if(score_a < threshold AND failure = 1) AS fn,
         count_if(score_a >= threshold AND failure = 1) AS tp
  FROM obs, {POLICY_SQL} GROUP BY policy, threshold)
SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
       coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1
FROM c""")
def policy_confusion(spark, sf_dir):
    """TN/FP/FN/TP and rates at every policy threshold (score >= t)."""
    th = spark.createDataFrame(POLICY_ROWS, "policy string, threshold double")
    return finish(metrics.confusion(tables.obs(spark, sf_dir), "score_a", "failure", th))


@register("classification_report", ops=["A29"], views=["obs"], round_cols=["precision", "recall", "f1", "support"],
          sql="""
WITH c AS (SELECT count_if(score_a < 0.5 AND failure = 0) AS c00, count_if(score_a < 0.5 AND failure = 1) AS c01,
                  count_if(score_a >= 0.5 AND failure = 0) AS c10, count_if(score_a >= 0.5 AND failure = 1) AS c11
           FROM obs),
k AS (SELECT '0' AS class, coalesce(c00 / nullif(c00 + c01, 0), 0) AS precision,
             coalesce(c00 / nullif(c00 + c10, 0), 0) AS recall, CAST(c00 + c10 AS DOUBLE) AS support FROM c
      UNION ALL
      SELECT '1', coalesce(c11 / nullif(c10 + c11, 0), 0), coalesce(c11 / nullif(c01 + c11, 0), 0),
             CAST(c01 + c11 AS DOUBLE) FROM c),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM k),
a AS (SELECT (c00 + c11) / (c00 + c01 + c10 + c11) AS acc, CAST(c00 + c01 + c10 + c11 AS DOUBLE) AS tot FROM c)
SELECT class, precision, recall, f1, support FROM f
UNION ALL SELECT 'accuracy', acc, acc, acc, tot FROM a
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), sum(support) FROM f""")
def classification_report(spark, sf_dir):
    """Per-class precision / recall / F1 / support with accuracy, macro and
    weighted averages at the 0.5 decision."""
    return finish(metrics.classification_report(tables.obs(spark, sf_dir), "score_a", "failure", 0.5))


@register("reliability_curve", ops=["A36"], views=["obs"], round_cols=["mean_score", "observed_rate"], sql="""
WITH e AS (SELECT [quantile_cont(score_b, 1/6e0), quantile_cont(score_b, 2/6e0), quantile_cont(score_b, 3/6e0),
                   quantile_cont(score_b, 4/6e0), quantile_cont(score_b, 5/6e0)] AS edges FROM obs),
b AS (SELECT score_b, failure, len(list_filter(edges, lambda x: x < score_b)) AS bin FROM obs, e)
SELECT CAST(bin AS INT) AS bin, count(*) AS n, avg(score_b) AS mean_score, avg(failure) AS observed_rate
FROM b GROUP BY bin""")
def reliability_curve(spark, sf_dir):
    """Six quantile bins of the score: mean score vs observed failure rate."""
    return finish(metrics.reliability_curve(tables.obs(spark, sf_dir), "score_b", "failure", 6))


@register("risk_category_profile", ops=["A26", "J6", "P12", "P24"], views=["obs"],
          round_cols=["share", "failure_rate"], sql="""
WITH c AS (SELECT CASE WHEN score_a < 0.3 THEN 'Low Risk' WHEN score_a < 0.6 THEN 'Medium Risk'
                       WHEN score_a < 0.9 THEN 'High Risk' ELSE 'Critical Risk' END AS category, failure FROM obs),
a AS (SELECT category, count(*) AS n, sum(failure) AS failures FROM c GROUP BY category),
d AS (SELECT * FROM (VALUES ('Low Risk', 0), ('Medium Risk', 1), ('High Risk', 2), ('Critical Risk', 3))
      v(category, category_order))
SELECT d.category, CAST(d.category_order AS INT) AS category_order, coalesce(n, 0) AS n,
       coalesce(n, 0) / (SELECT count(*) FROM obs) AS share, CAST(coalesce(failures, 0) AS BIGINT) AS failures,
       failures / nullif(n, 0) AS failure_rate,
       CASE WHEN coalesce(n, 0) < 20 THEN 'small sample: interpret with caution' END AS caution
FROM d LEFT JOIN a USING (category)""")
def risk_category_profile(spark, sf_dir):
    """All four risk categories (empty ones too) with size, share, failures and
    failure rate."""
    o = tables.obs(spark, sf_dir)
    th = THRESHOLDS
    cat = o.select(X.risk_category("score_a", th["medium"], th["high"], th["critical"]).alias("risk_category"),
                   "failure")
    return finish(metrics.category_profile(cat, "risk_category", "failure"))


REG_ROUND = ["rmse", "mae", "mean_error", "penalty_total", "penalty_mean", "r2"]
REG_SQL = """count(*) AS n, sqrt(avg((prediction - capped_rul) * (prediction - capped_rul))) AS rmse,
       avg(abs(prediction - capped_rul)) AS mae, avg(prediction - capped_rul) AS mean_error,
       sum(CASE WHEN prediction - capped_rul < 0 THEN exp(-(prediction - capped_rul) / 13e0) - 1
                ELSE exp((prediction - capped_rul) / 10e0) - 1 END) AS penalty_total,
       avg(CASE WHEN prediction - capped_rul < 0 THEN exp(-(prediction - capped_rul) / 13e0) - 1
                ELSE exp((prediction - capped_rul) / 10e0) - 1 END) AS penalty_mean,
       1 - sum((prediction - capped_rul) * (prediction - capped_rul)) / nullif(count(*) * var_pop(capped_rul), 0) AS r2"""
P_CTE = f"""p AS (SELECT unit_id, cycle, max(cycle) OVER (PARTITION BY unit_id) - cycle AS raw_rul,
                  least(max(cycle) OVER (PARTITION BY unit_id) - cycle, 125) AS capped_rul,
                  {PRED_SQL} AS prediction FROM traj)"""


@register("rul_regression_metrics", ops=["A37", "A38"], views=["traj"], round_cols=REG_ROUND,
          sql=f"WITH {P_CTE}\nSELECT {REG_SQL} FROM p")
def rul_regression_metrics(spark, sf_dir):
    """RMSE, MAE, R2, mean signed error and penalty total/mean over all rows."""
    p = _stand_in_prediction(tables.traj(spark, sf_dir).select("unit_id", "cycle", "l_quantity"))
    return finish(metrics.regression_metrics(p, "prediction", "capped_rul"))


@register("rul_error_by_band", ops=["A39", "P15"], views=["traj"], round_cols=REG_ROUND, sql=f"""
WITH {P_CTE}
SELECT CASE WHEN capped_rul <= 30 THEN 'Near failure (0–30)' WHEN capped_rul <= 80 THEN 'Mid-life (31–80)'
            ELSE 'Healthy/early (>80)' END AS rul_band, {REG_SQL}
FROM p GROUP BY 1""")
def rul_error_by_band(spark, sf_dir):
    """Error metrics per RUL band (bands present only)."""
    p = _stand_in_prediction(tables.traj(spark, sf_dir).select("unit_id", "cycle", "l_quantity"))
    return finish(metrics.regression_metrics(p.withColumn("rul_band", X.rul_band("capped_rul")), "prediction",
                                             "capped_rul", by=["rul_band"]))


@register("endpoint_overestimation", ops=["A40", "G11", "J2"], views=["traj"], sql=f"""
WITH {P_CTE},
e AS (SELECT p.unit_id, prediction - capped_rul AS d, raw_rul FROM p JOIN supplier s ON p.unit_id = s.s_suppkey
      WHERE p.raw_rul = 2 * s.s_nationkey),
a AS (SELECT 'all units' AS scope, count(*) AS n, count_if(d > 5) AS over_5, count_if(d > 10) AS over_10,
             count_if(d > 20) AS over_20 FROM e
      UNION ALL
      SELECT 'raw_rul <= 30', count(*), count_if(d > 5), count_if(d > 10), count_if(d > 20) FROM e
      WHERE raw_rul <= 30)
SELECT * FROM a""")
def endpoint_overestimation(spark, sf_dir):
    """Units over-estimated by more than 5 / 10 / 20 cycles at their evaluation
    endpoint (2 x nation key cycles before the end), overall and near failure;
    both scopes are always reported."""
    p = _stand_in_prediction(tables.traj(spark, sf_dir).select("unit_id", "cycle", "l_quantity"))
    sup = tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit_id"), "s_nationkey")
    e = p.join(sup, "unit_id").where(F.col("raw_rul") == 2 * F.col("s_nationkey"))
    scoped = e.withColumn("scope", F.lit("all units")).unionByName(
        e.where(F.col("raw_rul") <= 30).withColumn("scope", F.lit("raw_rul <= 30")))
    counts = metrics.overestimation_counts(scoped, "prediction", "capped_rul", by=["scope"])
    scopes = spark.createDataFrame([("all units",), ("raw_rul <= 30",)], "scope string")
    return joins.reindex(scopes, counts, "scope", {c: 0 for c in ["n", "over_5", "over_10", "over_20"]}).select(
        "scope", *[F.col(c).cast("bigint").alias(c) for c in ["n", "over_5", "over_10", "over_20"]])


@register("fold_metric_summary", ops=["A41", "R3", "U1", "M4"], views=["traj"],
          round_cols=["rmse_mean", "rmse_std", "mae_mean", "mae_std", "r2_mean", "r2_std"], sql=f"""
WITH {P_CTE},
f AS (SELECT p.*, ('0x' || substr(md5(CAST(unit_id AS VARCHAR) || ':42'), 1, 8))::BIGINT % 5 AS fold FROM p),
med AS (SELECT k.fold, quantile_cont(t.capped_rul, 0.5) AS naive
        FROM (SELECT DISTINCT fold FROM f) k JOIN f t ON t.fold <> k.fold GROUP BY k.fold),
m AS (SELECT 'stand_in' AS model, fold, sqrt(avg((prediction - capped_rul) ^ 2)) AS rmse,
             avg(abs(prediction - capped_rul)) AS mae,
             1 - sum((prediction - capped_rul) ^ 2) / (count(*) * var_pop(capped_rul)) AS r2 FROM f GROUP BY fold
      UNION ALL
      SELECT 'naive_median', f.fold, sqrt(avg((naive - capped_rul) ^ 2)), avg(abs(naive - capped_rul)),
             1 - sum((naive - capped_rul) ^ 2) / (count(*) * var_pop(capped_rul)) FROM f JOIN med USING (fold)
      GROUP BY f.fold)
SELECT model, count(*) AS folds, avg(rmse) AS rmse_mean, stddev_samp(rmse) AS rmse_std, avg(mae) AS mae_mean,
       stddev_samp(mae) AS mae_std, avg(r2) AS r2_mean, stddev_samp(r2) AS r2_std
FROM m GROUP BY model""")
def fold_metric_summary(spark, sf_dir):
    """Per-fold RMSE / MAE / R2 over whole-unit folds for the stand-in model and
    the naive training-fold median baseline, then mean and sample std."""
    p = _stand_in_prediction(tables.traj(spark, sf_dir).select("unit_id", "cycle", "l_quantity"))
    f = splits.group_kfold(p, "unit_id", k=5, seed=42)
    naive = splits.naive_median_baseline(f, "capped_rul", "fold")
    scored = f.join(F.broadcast(naive), "fold")
    per = (metrics.regression_metrics(scored, "prediction", "capped_rul", by=["fold"]).withColumn("model", F.lit("stand_in"))
           .unionByName(metrics.regression_metrics(scored, "naive_prediction", "capped_rul", by=["fold"])
                        .withColumn("model", F.lit("naive_median"))))
    summary = metrics.fold_summary(per, ["model"], ["rmse", "mae", "r2"])
    counts = per.groupBy("model").agg(F.count(F.lit(1)).alias("folds"))
    return finish(summary.join(counts, "model"))


del detect


@register("policy_summary_join", ops=["J5", "U6", "A27"], views=["obs"],
          round_cols=["threshold", "a_precision", "a_recall", "b_precision", "b_recall"], sql=f"""
WITH c AS (SELECT policy, threshold,
                  count_if(score_a >= threshold AND failure = 1) AS a_tp, count_if(score_a >= threshold) AS a_pp,
                  count_if(score_b >= threshold AND failure = 1) AS b_tp, count_if(score_b >= threshold) AS b_pp,
                  count_if(failure = 1) AS pos
           FROM obs, {POLICY_SQL} GROUP BY policy, threshold)
SELECT policy, threshold,
       coalesce(a_tp / nullif(a_pp, 0), 0) AS a_precision, coalesce(a_tp / nullif(pos, 0), 0) AS a_recall,
       coalesce(b_tp / nullif(b_pp, 0), 0) AS b_precision, coalesce(b_tp / nullif(pos, 0), 0) AS b_recall
FROM c""")
def policy_summary_join(spark, sf_dir):
    """Two policy tables (one per score) joined on the policy label, their
    metric columns prefixed per score."""
    th = spark.createDataFrame(POLICY_ROWS, "policy string, threshold double")
    o = tables.obs(spark, sf_dir)
    a = metrics.confusion(o, "score_a", "failure", th).select("policy", "threshold", "precision", "recall")
    b = metrics.confusion(o, "score_b", "failure", th).select("policy", "precision", "recall")
    a = joins.prefixed(a, "a_", keep=["policy", "threshold"])
    b = joins.prefixed(b, "b_", keep=["policy"])
    return finish(a.join(b, "policy"))
