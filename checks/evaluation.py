"""Checks of splits, folds and evaluation tables."""

from pyspark.sql import functions as F

from checks.common import RG, SC, check, load, regressed, rounded, scored, union_all
from millrace.operators import metrics, split


def predicted(spark, sf):
    return scored(spark, sf).withColumn("p", (F.col("score") >= 0.5).cast("int"))


SP = SC + ", sp AS (SELECT *, CAST(score >= 0.5 AS INT) AS p FROM sc)"


def multi(spark, sf):
    """Order status as the class, with a deterministic prediction of it."""
    return load(spark, sf, "orders").selectExpr("o_orderkey", "o_orderstatus AS y", "CASE WHEN o_orderkey % 7 = 0 THEN 'F' WHEN o_orderkey % 11 = 0 THEN 'O' ELSE o_orderstatus END AS p")


MU = "mu AS (SELECT o_orderkey, o_orderstatus AS y, CASE WHEN o_orderkey % 7 = 0 THEN 'F' WHEN o_orderkey % 11 = 0 THEN 'O' ELSE o_orderstatus END AS p FROM orders)"


@check("f11_split_sizes", "SELECT TRUE AS is_test, CAST(CEIL(ROUND(COUNT(*) * 0.2, 9)) AS BIGINT) AS n FROM orders UNION ALL SELECT FALSE, CAST(COUNT(*) - CEIL(ROUND(COUNT(*) * 0.2, 9)) AS BIGINT) FROM orders")
def f11(spark, sf):
    return split.mark_test(load(spark, sf, "orders"), "o_orderkey", 0.2).groupBy("is_test").agg(F.count("*").alias("n"))


@check("f11_split_stratified", "SELECT o_orderstatus, CAST(CEIL(ROUND(COUNT(*) * 0.3, 9)) AS BIGINT) AS n_test, COUNT(*) AS n FROM orders GROUP BY 1")
def f11_strata(spark, sf):
    m = split.mark_test(load(spark, sf, "orders"), "o_orderkey", 0.3, "o_orderstatus")
    return m.groupBy("o_orderstatus").agg(F.count_if("is_test").alias("n_test"), F.count("*").alias("n"))


@check("f11_train_rows")
def f11_train(spark, sf):
    return split.split_data(load(spark, sf, "orders"), "o_orderkey", 0.2)[0]


@check("f12_kfold_sizes", "SELECT CAST(i AS INT) AS fold, (n - i + 4) // 5 AS n FROM range(5) t(i), (SELECT COUNT(*) AS n FROM orders) c")
def f12(spark, sf):
    return split.assign_folds(load(spark, sf, "orders"), "o_orderkey", 5).groupBy("fold").agg(F.count("*").alias("n"))


@check("f12_stratified_sizes", "SELECT o_orderstatus, CAST(i AS INT) AS fold, (n - i + 4) // 5 AS n FROM range(5) t(i), (SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1) c")
def f12_strata(spark, sf):
    return split.assign_folds(load(spark, sf, "orders"), "o_orderkey", 5, "o_orderstatus").groupBy("o_orderstatus", "fold").agg(F.count("*").alias("n"))


@check("f12_time_series", """WITH r AS (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, COUNT(*) OVER () AS n FROM orders), s AS (SELECT *, n // 6 AS z FROM r)
 SELECT o_orderkey, CAST(CASE WHEN i < n - 5 * z THEN 0 ELSE 1 + (i - (n - 5 * z)) // z END AS INT) AS segment FROM s""")
def f12_time(spark, sf):
    return split.time_series_folds(load(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], 5).select("o_orderkey", "segment")


@check("v1_metrics_binary", f"""WITH {SP}, c AS (SELECT COUNT(*) FILTER (WHERE y = 1 AND p = 1) * 1.0 AS tp, COUNT(*) FILTER (WHERE y = 0 AND p = 1) AS fp, COUNT(*) FILTER (WHERE y = 1 AND p = 0) AS fn, COUNT(*) FILTER (WHERE y = p) * 1.0 / COUNT(*) AS a FROM sp)
 SELECT ROUND(a, 6) AS accuracy, ROUND(tp / (tp + fp), 6) AS "precision", ROUND(tp / (tp + fn), 6) AS recall, ROUND(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def v1(spark, sf):
    return rounded(metrics.classification_metrics(predicted(spark, sf), "y", "p"), 6)


_CLS = f"""{MU}, k AS (SELECT DISTINCT y AS label FROM mu UNION SELECT DISTINCT p FROM mu), t AS (SELECT label, (SELECT COUNT(*) FROM mu WHERE y = label) AS s, (SELECT COUNT(*) FROM mu WHERE p = label) AS q, (SELECT COUNT(*) FROM mu WHERE y = label AND p = label) AS h FROM k),
 r AS (SELECT *, COALESCE(h * 1.0 / NULLIF(q, 0), 0) AS pr, COALESCE(h * 1.0 / NULLIF(s, 0), 0) AS re, COALESCE(2.0 * h / NULLIF(q + s, 0), 0) AS f FROM t)"""


@check("v1_metrics_weighted", f"WITH {_CLS} SELECT ROUND(SUM(h) * 1.0 / SUM(s), 6) AS accuracy, ROUND(SUM(pr * s) / SUM(s), 6) AS \"precision\", ROUND(SUM(re * s) / SUM(s), 6) AS recall, ROUND(SUM(f * s) / SUM(s), 6) AS f1 FROM r")
def v1_weighted(spark, sf):
    return rounded(metrics.classification_metrics(multi(spark, sf), "y", "p"), 6)


@check("v1_auc_log_loss", f"""WITH {SC}, r AS (SELECT y, score, RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM sc)
 SELECT ROUND((SUM(r) FILTER (WHERE y = 1) - COUNT(*) FILTER (WHERE y = 1) * (COUNT(*) FILTER (WHERE y = 1) + 1) / 2.0) / (COUNT(*) FILTER (WHERE y = 1) * 1.0 * COUNT(*) FILTER (WHERE y = 0)), 6) AS roc_auc,
 ROUND(AVG(-LN(CASE WHEN y = 1 THEN GREATEST(LEAST(score, 1 - 1e-15), 1e-15) ELSE 1 - GREATEST(LEAST(score, 1 - 1e-15), 1e-15) END)), 6) AS log_loss FROM r""")
def v1_auc(spark, sf):
    a = metrics.auc(scored(spark, sf), "y", "score").first()["roc_auc"]
    return rounded(metrics.log_loss(scored(spark, sf), "y", "score").select(F.lit(a).alias("roc_auc"), "log_loss"), 6)


@check("v1_auc_one_vs_rest", """WITH s AS (SELECT o_orderstatus AS y, CAST(o_orderkey * 7919 % 1000 AS DOUBLE) / 1000 AS f, CAST(o_orderkey * 104729 % 997 AS DOUBLE) / 997 AS o FROM orders),
 a AS (SELECT 'F' AS label, y = 'F' AS pos, RANK() OVER (ORDER BY f) + (COUNT(*) OVER (PARTITION BY f) - 1) / 2.0 AS r FROM s UNION ALL SELECT 'O', y = 'O', RANK() OVER (ORDER BY o) + (COUNT(*) OVER (PARTITION BY o) - 1) / 2.0 FROM s),
 u AS (SELECT label, (SUM(r) FILTER (WHERE pos) - COUNT(*) FILTER (WHERE pos) * (COUNT(*) FILTER (WHERE pos) + 1) / 2.0) / (COUNT(*) FILTER (WHERE pos) * 1.0 * COUNT(*) FILTER (WHERE NOT pos)) AS v FROM a GROUP BY label)
 SELECT label, ROUND(v, 6) AS roc_auc FROM u UNION ALL SELECT 'macro', ROUND(AVG(v), 6) FROM u""")
def v1_ovr(spark, sf):
    df = load(spark, sf, "orders").selectExpr("o_orderstatus AS y", "(o_orderkey * 7919 % 1000) / 1000.0D AS f", "(o_orderkey * 104729 % 997) / 997.0D AS o")
    return rounded(metrics.auc_one_vs_rest(df, "y", {"F": "f", "O": "o"}), 6)


@check("v1_compare_models", f"""WITH {SP}, m AS (SELECT 'half' AS model, COUNT(*) FILTER (WHERE y = p) * 1.0 / COUNT(*) AS a FROM sp UNION ALL SELECT 'low', COUNT(*) FILTER (WHERE y = CAST(score >= 0.2 AS INT)) * 1.0 / COUNT(*) FROM sp)
 SELECT model, ROUND(a, 6) AS accuracy, a = MAX(a) OVER () AS best FROM m""")
def v1_compare(spark, sf):
    low = scored(spark, sf).withColumn("p", (F.col("score") >= 0.2).cast("int"))
    out = metrics.compare_models({"half": metrics.classification_metrics(predicted(spark, sf), "y", "p"), "low": metrics.classification_metrics(low, "y", "p")}, "accuracy")
    return rounded(out.select("model", "accuracy", "best"), 6)


@check("v3_confusion_matrix", f"WITH {MU}, k AS (SELECT DISTINCT y AS l FROM mu UNION SELECT DISTINCT p FROM mu) SELECT a.l AS actual, b.l AS predicted, (SELECT COUNT(*) FROM mu WHERE y = a.l AND p = b.l) AS count FROM k a, k b")
def v3(spark, sf):
    return metrics.confusion_matrix(multi(spark, sf), "y", "p")


@check("v3_confusion_normalized", f"WITH {MU}, k AS (SELECT DISTINCT y AS l FROM mu UNION SELECT DISTINCT p FROM mu) SELECT a.l AS actual, b.l AS predicted, ROUND((SELECT COUNT(*) FROM mu WHERE y = a.l AND p = b.l) * 1.0 / (SELECT COUNT(*) FROM mu WHERE y = a.l), 3) AS share FROM k a, k b")
def v3_normalized(spark, sf):
    return metrics.confusion_matrix(multi(spark, sf), "y", "p", normalize=True)


@check("v3_binary_rates", f"""WITH {SP}, c AS (SELECT COUNT(*) FILTER (WHERE y = 1 AND p = 1) AS tp, COUNT(*) FILTER (WHERE y = 0 AND p = 1) AS fp, COUNT(*) FILTER (WHERE y = 1 AND p = 0) AS fn, COUNT(*) FILTER (WHERE y = 0 AND p = 0) AS tn FROM sp)
 SELECT tp, fp, fn, tn, ROUND(tp * 1.0 / (tp + fn), 6) AS sensitivity, ROUND(tn * 1.0 / (tn + fp), 6) AS specificity, ROUND(fp * 1.0 / (fp + tn), 6) AS false_positive_rate, ROUND(fn * 1.0 / (fn + tp), 6) AS false_negative_rate,
 ROUND(tp * 1.0 / (tp + fp), 6) AS "precision", ROUND(tn * 1.0 / (tn + fn), 6) AS negative_predictive_value FROM c""")
def v3_rates(spark, sf):
    return rounded(metrics.binary_rates(predicted(spark, sf), "y", "p"), 6)


@check("v4_classification_report", f"""WITH {_CLS} SELECT label, ROUND(pr, 6) AS "precision", ROUND(re, 6) AS recall, ROUND(f, 6) AS f1, s AS support FROM r
 UNION ALL SELECT 'accuracy', ROUND(SUM(h) * 1.0 / SUM(s), 6), ROUND(SUM(h) * 1.0 / SUM(s), 6), ROUND(SUM(h) * 1.0 / SUM(s), 6), CAST(SUM(s) AS BIGINT) FROM r
 UNION ALL SELECT 'macro avg', ROUND(AVG(pr), 6), ROUND(AVG(re), 6), ROUND(AVG(f), 6), CAST(SUM(s) AS BIGINT) FROM r
 UNION ALL SELECT 'weighted avg', ROUND(SUM(pr * s) / SUM(s), 6), ROUND(SUM(re * s) / SUM(s), 6), ROUND(SUM(f * s) / SUM(s), 6), CAST(SUM(s) AS BIGINT) FROM r""")
def v4(spark, sf):
    return rounded(metrics.classification_report(multi(spark, sf), "y", "p"), 6)


@check("v5_regression_metrics", f"""WITH {RG} SELECT ROUND(AVG((y - p) * (y - p)), 2) AS mse, ROUND(SQRT(AVG((y - p) * (y - p))), 2) AS rmse, ROUND(AVG(ABS(y - p)), 2) AS mae, ROUND(1 - AVG((y - p) * (y - p)) / VAR_POP(y), 6) AS r2,
 ROUND(MEDIAN(ABS(y - p)), 2) AS median_ae, ROUND(AVG(ABS(y - p) / ABS(y)) * 100, 4) AS mape, ROUND(1 - VAR_POP(y - p) / VAR_POP(y), 6) AS explained_variance, ROUND(AVG(y - p), 2) AS residual_mean, ROUND(STDDEV_SAMP(y - p), 2) AS residual_std FROM rg""")
def v5(spark, sf):
    m = metrics.regression_metrics(regressed(spark, sf), "y", "p")
    k = {"r2": 6, "explained_variance": 6, "mape": 4}
    return m.select(*[F.round(c, k.get(c, 2)).alias(c) for c in m.columns])


_CUM = "c AS (SELECT score AS threshold, SUM(SUM(y)) OVER w AS tp, SUM(COUNT(*) - SUM(y)) OVER w AS fp, SUM(SUM(y)) OVER () AS pp, SUM(COUNT(*) - SUM(y)) OVER () AS nn FROM sc GROUP BY 1 WINDOW w AS (ORDER BY score DESC))"


@check("v6_roc_curve", f"WITH {SC}, {_CUM} SELECT threshold, ROUND(fp * 1.0 / nn, 6) AS fpr, ROUND(tp * 1.0 / pp, 6) AS tpr FROM c UNION ALL SELECT CAST('inf' AS DOUBLE), 0, 0")
def v6(spark, sf):
    out = metrics.roc_curve(scored(spark, sf), "y", "score")
    return out.select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@check("v6_precision_recall", f"WITH {SC}, {_CUM} SELECT threshold, ROUND(tp * 1.0 / (tp + fp), 6) AS \"precision\", ROUND(tp * 1.0 / pp, 6) AS recall FROM c UNION ALL SELECT NULL, 1, 0")
def v6_pr(spark, sf):
    return rounded(metrics.precision_recall_curve(scored(spark, sf), "y", "score"), 6)


@check("v6_best_threshold", f"WITH {SC}, {_CUM} SELECT threshold, ROUND(fp * 1.0 / nn, 6) AS fpr, ROUND(tp * 1.0 / pp, 6) AS tpr FROM c ORDER BY tp * 1.0 / pp - fp * 1.0 / nn DESC, threshold DESC LIMIT 1")
def v6_best(spark, sf):
    return rounded(metrics.best_threshold(scored(spark, sf), "y", "score"), 6)


@check("v8_top_confusions", f"WITH {MU} SELECT y AS actual, p AS predicted, COUNT(*) AS count FROM mu WHERE y <> p GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 5")
def v8(spark, sf):
    return metrics.top_confusions(multi(spark, sf), "y", "p")


@check("v8_error_rates", f"WITH {MU} SELECT y AS label, COUNT(*) AS total, COUNT(*) FILTER (WHERE y <> p) AS errors, ROUND(COUNT(*) FILTER (WHERE y <> p) * 1.0 / COUNT(*), 6) AS error_rate FROM mu GROUP BY 1")
def v8_rates(spark, sf):
    return rounded(metrics.error_rates(multi(spark, sf), "y", "p"), 6)


@check("v9_error_by_range", f"""WITH {RG}, e AS (SELECT MIN(y) AS lo, (MAX(y) - MIN(y)) / 5 AS w FROM rg), b AS (SELECT *, """ + " + ".join(f"CASE WHEN y > lo + {i} * w THEN 1 ELSE 0 END" for i in range(1, 5)) + """ AS bin FROM rg, e)
 SELECT bin, ROUND(MAX(lo) + bin * MAX(w), 2) AS low, ROUND(MAX(lo) + (bin + 1) * MAX(w), 2) AS high, COUNT(*) AS count, ROUND(AVG(ABS(y - p)), 2) AS mean_absolute_error, ROUND(STDDEV_SAMP(ABS(y - p)), 2) AS std_absolute_error, ROUND(AVG(y - p), 2) AS mean_error FROM b GROUP BY bin""")
def v9(spark, sf):
    return rounded(metrics.error_by_range(regressed(spark, sf), "y", "p"), 2)
