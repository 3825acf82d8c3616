"""Checks of reduction, models, search, scoring and neighbour methods."""

from pyspark.sql import functions as F

from checks.common import check, lineitem_null, load, rounded, scored
from millrace.operators import cluster, metrics, models, outliers, reduce, search, select
from millrace.operators.knn import knn_classify
from millrace.operators.missing import handle_missing_values
from millrace.operators.split import split_data

_X = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def li(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_X, "l_returnflag")


def vectors(spark, sf, d=64):
    """The first d of the 64 values of every embedding; fewer only where the SQL of a check states fewer."""
    e = load(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[F.get("embedding", i).cast("double").alias(f"e{i}") for i in range(d)])


_E = [f"e{i}" for i in range(64)]


def graded(spark, sf):
    """Labelled documents with text counts as features."""
    from millrace.plans.spec import fit_transform

    d = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id").select("doc_id", "text", "quality", "toxic")
    out = fit_transform("text_features", d, ["text"], features=["char_count", "word_count", "avg_word_length", "special_char_count"], drop_original=True)
    return out


_D = ["text_char_count", "text_word_count", "text_avg_word_length", "text_special_char_count"]


# --- reduction ------------------------------------------------------------------------------

@check("d1_pca")
def d1(spark, sf):
    return reduce.pca(li(spark, sf), _X, 2)


@check("d1_pca_variance", """WITH c AS (SELECT VAR_SAMP(l_quantity) AS a, VAR_SAMP(l_extendedprice / 1000) AS b, COVAR_SAMP(l_quantity, l_extendedprice / 1000) AS m FROM lineitem),
 v AS (SELECT (a + b) / 2 + SQRT(POWER((a - b) / 2, 2) + m * m) AS hi, (a + b) / 2 - SQRT(POWER((a - b) / 2, 2) + m * m) AS lo FROM c)
 SELECT 1 AS component, ROUND(hi, 4) AS variance, ROUND(hi / (hi + lo), 6) AS ratio, ROUND(hi / (hi + lo), 6) AS cumulative, hi / (hi + lo) >= 0.95 AS reaches FROM v
 UNION ALL SELECT 2, ROUND(lo, 4), ROUND(lo / (hi + lo), 6), 1.0, hi / (hi + lo) < 0.95 FROM v""")
def d1_variance(spark, sf):
    out = reduce.pca_variance(li(spark, sf).withColumn("price", F.col("l_extendedprice") / 1000), ["l_quantity", "price"])
    return out.select(F.col("component").cast("int").alias("component"), F.round("variance", 4).alias("variance"), F.round("ratio", 6).alias("ratio"), F.round("cumulative", 6).alias("cumulative"), "reaches")


@check("d2_lda")
def d2(spark, sf):
    return reduce.lda(vectors(spark, sf), "label", _E, 2)


@check("d3_kernel_pca")
def d3(spark, sf):
    return reduce.kernel_pca(vectors(spark, sf), _E, 2)


@check("g17_pca_features")
def g17(spark, sf):
    return reduce.pca_features(vectors(spark, sf), _E, 0.8)


@check("g18_cluster_kmeans")
def g18(spark, sf):
    return cluster.cluster_labels(vectors(spark, sf), _E, "kmeans", 4)


@check("g18_cluster_gmm")
def g18_gmm(spark, sf):
    return cluster.cluster_labels(vectors(spark, sf), _E, "gmm", 3)


# --- models ---------------------------------------------------------------------------------

def _classifier(algorithm, **params):
    def run(spark, sf):
        df = graded(spark, sf)
        return models.score(models.train_model(df, "quality", _D, algorithm, **params), df)

    return run


for _name, _params in (("logistic_regression", {"class_weight": "balanced"}), ("decision_tree_classifier", {}), ("random_forest_classifier", {"numTrees": 10}),
                       ("gradient_boosting_classifier", {"maxIter": 5}), ("naive_bayes", {}), ("neural_network", {"hidden_layers": [6], "maxIter": 20}), ("linear_svm", {"maxIter": 20})):
    check(f"c1_{_name}")(_classifier(_name, **_params))


@check("c1_boosting_many_classes")
def c1_many(spark, sf):
    v = vectors(spark, sf)
    return models.score(models.train_model(v, "label", _E, "gradient_boosting_classifier", maxIter=2, maxDepth=2), v)


@check("c2_knn_classify", """WITH v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings),
 d AS (SELECT q.vec_id, p.label, ROW_NUMBER() OVER (PARTITION BY q.vec_id ORDER BY (q.a - p.a) * (q.a - p.a) + (q.b - p.b) * (q.b - p.b) + (q.c - p.c) * (q.c - p.c), p.a, p.b, p.c, p.label) AS r
  FROM v q, v p WHERE q.vec_id % 4 = 0 AND p.vec_id % 4 <> 0),
 t AS (SELECT vec_id, label, COUNT(*) AS n FROM d WHERE r <= 5 GROUP BY 1, 2)
 SELECT vec_id, CAST(ARG_MIN(label, n * -1000000 + label) AS VARCHAR) AS "Predicted_Class" FROM t GROUP BY 1""")
def c2(spark, sf):
    v = vectors(spark, sf, 3)
    return knn_classify(v.where("vec_id % 4 != 0"), v.where("vec_id % 4 = 0"), "label", _E[:3], "vec_id", 5)


def _regressor(algorithm, **params):
    def run(spark, sf):
        df = li(spark, sf)
        return models.score(models.train_model(df, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], algorithm, **params), df)

    return run


@check("c3_linear_regression", """WITH m AS (SELECT REGR_SLOPE(l_extendedprice, l_quantity) AS a, REGR_INTERCEPT(l_extendedprice, l_quantity) AS b FROM lineitem)
 SELECT l_orderkey, l_linenumber, ROUND(a * l_quantity + b, 2) AS "Predicted_Value" FROM lineitem, m""")
def c3(spark, sf):
    df = li(spark, sf)
    out = models.score(models.train_model(df, "l_extendedprice", ["l_quantity"], "linear_regression"), df)
    return rounded(out.select("l_orderkey", "l_linenumber", "Predicted_Value"), 2)


@check("c3_ridge", """WITH m AS (SELECT AVG(l_quantity) AS mx, AVG(l_extendedprice) AS my, COVAR_POP(l_quantity, l_extendedprice) * COUNT(*) AS sxy, VAR_POP(l_quantity) * COUNT(*) AS sxx FROM lineitem)
 SELECT l_orderkey, l_linenumber, ROUND(my + sxy / (sxx + 1000) * (l_quantity - mx), 2) AS "Predicted_Value" FROM lineitem, m""")
def c3_ridge(spark, sf):
    df = li(spark, sf)
    out = models.score(models.train_model(df, "l_extendedprice", ["l_quantity"], "ridge", alpha=1000.0), df)
    return rounded(out.select("l_orderkey", "l_linenumber", "Predicted_Value"), 2)


@check("c3_lasso", """WITH m AS (SELECT AVG(l_quantity) AS mx, AVG(l_extendedprice) AS my, COVAR_POP(l_quantity, l_extendedprice) AS sxy, VAR_POP(l_quantity) AS sxx FROM lineitem)
 SELECT l_orderkey, l_linenumber, ROUND(my + SIGN(sxy) * GREATEST(ABS(sxy) - 1000, 0) / sxx * (l_quantity - mx), 1) AS "Predicted_Value" FROM lineitem, m""")
def c3_lasso(spark, sf):
    df = li(spark, sf)
    out = models.score(models.train_model(df, "l_extendedprice", ["l_quantity"], "lasso", alpha=1000.0, tol=1e-12, maxIter=500), df)
    return rounded(out.select("l_orderkey", "l_linenumber", "Predicted_Value"), 1)


for _name, _params in (("elastic_net", {"alpha": 10.0}), ("decision_tree_regressor", {}), ("random_forest_regressor", {"numTrees": 5}), ("gradient_boosting_regressor", {"maxIter": 5})):
    check(f"c3_{_name}")(_regressor(_name, **_params))


@check("c4_kmeans")
def c4(spark, sf):
    v = vectors(spark, sf)
    return models.score(models.train_model(v, None, _E, "kmeans", k=4), v)


@check("c4_gaussian_mixture")
def c4_gmm(spark, sf):
    v = vectors(spark, sf)
    return models.score(models.train_model(v, None, _E, "gaussian_mixture", k=3), v)


@check("c5_dbscan", """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
 p AS (SELECT q.vec_id AS i, r.vec_id AS j FROM v q, v r WHERE SQRT((q.a - r.a) * (q.a - r.a) + (q.b - r.b) * (q.b - r.b)) <= 0.05),
 core AS (SELECT i FROM p GROUP BY i HAVING COUNT(*) >= 5),
 e AS (SELECT i, j FROM p WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)),
 walk AS (SELECT i, i AS j FROM core UNION SELECT walk.i, e.j FROM walk JOIN e ON e.i = walk.j),
 comp AS (SELECT i, MIN(j) AS c FROM walk GROUP BY i),
 o AS (SELECT comp.c, ROW_NUMBER() OVER (ORDER BY MIN((a, b))) - 1 AS k FROM comp JOIN v ON v.vec_id = comp.i GROUP BY comp.c),
 l AS (SELECT i, k FROM comp JOIN o USING (c))
 SELECT v.vec_id, CAST(COALESCE((SELECT k FROM l WHERE l.i = v.vec_id), (SELECT MIN(k) FROM p JOIN l ON l.i = p.j WHERE p.i = v.vec_id), -1) AS INT) AS cluster FROM v""")
def c5(spark, sf):
    return cluster.dbscan(vectors(spark, sf, 2), _E[:2], eps=0.05, min_samples=5).select("vec_id", "cluster")


@check("c6_hierarchical")
def c6(spark, sf):
    return cluster.cluster_labels(vectors(spark, sf), _E, "hierarchical", 4)


@check("c7_training_metadata", """SELECT COUNT(*) AS n, MIN(l_extendedprice) AS min, MAX(l_extendedprice) AS max, ROUND(AVG(l_extendedprice), 4) AS mean, ROUND(STDDEV_SAMP(l_extendedprice), 4) AS std FROM lineitem""")
def c7(spark, sf):
    m = models.train_model(li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount"], "linear_regression").metadata
    return rounded(spark.range(1).select(F.lit(m["n"]).cast("long").alias("n"), *[F.lit(m["target_stats"][k]).alias(k) for k in ("min", "max", "mean", "std")]))


@check("l5_select_by_model")
def l5(spark, sf):
    return select.select_features(li(spark, sf), "model", "l_extendedprice", _X[:1] + _X[2:], num_trees=5)


@check("l6_rfe", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_extendedprice FROM (SELECT *, 0 AS z FROM lineitem) q")
def l6(spark, sf):
    df = li(spark, sf).withColumn("l_extendedprice", F.col("l_extendedprice"))
    out = select.select_features(df.withColumn("y", F.col("l_quantity") * 1000 + F.col("l_tax")), "rfe", "y", ["l_quantity", "l_discount", "l_tax"], n_features=1, strength=0.01)
    return out.drop("y")


@check("l9_select_sequentially")
def l9(spark, sf):
    return select.select_features(li(spark, sf).withColumn("y", F.col("l_quantity") * 2 + F.col("l_tax")), "sequential", "y", ["l_quantity", "l_discount", "l_tax"], key=["l_orderkey", "l_linenumber", "l_extendedprice"], n_features=1, folds=2)


# --- neighbours and trees -------------------------------------------------------------------

@check("m8_fill_knn", """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN NULL ELSE CAST(embedding[1] AS DOUBLE) END AS a, CASE WHEN vec_id % 15 = 0 THEN NULL ELSE CAST(embedding[2] AS DOUBLE) END AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings),
 d AS (SELECT q.vec_id, p.a, p.b, SQRT(3.0 / (1 + CAST(q.a IS NOT NULL AND p.a IS NOT NULL AS INT) + CAST(q.b IS NOT NULL AND p.b IS NOT NULL AS INT)) * (COALESCE((q.a - p.a) * (q.a - p.a), 0) + COALESCE((q.b - p.b) * (q.b - p.b), 0) + (q.c - p.c) * (q.c - p.c))) AS s
  FROM v q, v p WHERE (q.a IS NULL OR q.b IS NULL) AND p.vec_id <> q.vec_id),
 fa AS (SELECT vec_id, AVG(a) AS a FROM (SELECT vec_id, a, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY s) AS r FROM d WHERE a IS NOT NULL) z WHERE r <= 5 GROUP BY 1),
 fb AS (SELECT vec_id, AVG(b) AS b FROM (SELECT vec_id, b, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY s) AS r FROM d WHERE b IS NOT NULL) z WHERE r <= 5 GROUP BY 1)
 SELECT vec_id, ROUND(COALESCE(v.a, fa.a), 6) AS e0, ROUND(COALESCE(v.b, fb.b), 6) AS e1, ROUND(c, 6) AS e2 FROM v LEFT JOIN fa USING (vec_id) LEFT JOIN fb USING (vec_id)""")
def m8(spark, sf):
    v = vectors(spark, sf, 3).drop("label").withColumns({"e0": F.expr("CASE WHEN vec_id % 10 = 0 THEN NULL ELSE e0 END"), "e1": F.expr("CASE WHEN vec_id % 15 = 0 THEN NULL ELSE e1 END")})
    return rounded(handle_missing_values(v, "fill_knn", ["e0", "e1", "e2"]), 6)


@check("o4_local_outlier_factor", """WITH v AS (SELECT vec_id AS i, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings),
 d AS (SELECT q.i, p.i AS j, SQRT((q.a - p.a) * (q.a - p.a) + (q.b - p.b) * (q.b - p.b) + (q.c - p.c) * (q.c - p.c)) AS s, ROW_NUMBER() OVER (PARTITION BY q.i ORDER BY (q.a - p.a) * (q.a - p.a) + (q.b - p.b) * (q.b - p.b) + (q.c - p.c) * (q.c - p.c)) AS r FROM v q, v p WHERE q.i <> p.i),
 n AS (SELECT * FROM d WHERE r <= 20), k AS (SELECT i, MAX(s) AS kd FROM n GROUP BY i),
 l AS (SELECT n.i, 1 / (AVG(GREATEST(s, kd)) + 1e-10) AS lrd FROM n JOIN k ON k.i = n.j GROUP BY n.i)
 SELECT n.i AS vec_id, ROUND(AVG(o.lrd) / MAX(l.lrd), 6) AS lof, AVG(o.lrd) / MAX(l.lrd) > 1.5 AS outlier FROM n JOIN l o ON o.i = n.j JOIN l ON l.i = n.i GROUP BY n.i""")
def o4(spark, sf):
    return rounded(outliers.detect_outliers(vectors(spark, sf, 3), _E[:3], "lof").select("vec_id", "lof", "outlier"), 6)


@check("o5_isolation_forest")
def o5(spark, sf):
    return outliers.detect_outliers(li(spark, sf), _X, "isolation_forest", contamination=0.05)


# --- search and scoring ---------------------------------------------------------------------

_KEY = ["l_orderkey", "l_linenumber", "l_extendedprice"]


@check("v2_cross_validation")
def v2(spark, sf):
    return search.cross_validation_table(li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount"], "linear_regression", _KEY, 3)


@check("v2_learning_curve")
def v2_curve(spark, sf):
    return search.learning_curve(li(spark, sf), "l_extendedprice", ["l_quantity"], "linear_regression", _KEY, sizes=(0.1, 0.5, 1.0), folds=2)


@check("v7_clustering_metrics", """WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
 c AS (SELECT label, i, AVG(x) AS m, COUNT(*) AS n FROM v GROUP BY 1, 2), d AS (SELECT vec_id, v.label, c.label AS other, c.n, SUM((x - m) * (x - m)) AS d FROM v JOIN c USING (i) GROUP BY ALL),
 s AS (SELECT label, n, SUM(d) AS w, AVG(SQRT(d)) AS s FROM d WHERE label = other GROUP BY 1, 2),
 q AS (SELECT vec_id, MAX(CASE WHEN d.label = other THEN (d + s.w / s.n) * s.n / (s.n - 1) END) AS a, MIN(CASE WHEN d.label <> other THEN d + s.w / s.n END) AS b FROM d JOIN s ON s.label = other GROUP BY 1),
 g AS (SELECT i, AVG(x) AS g FROM v GROUP BY 1), b AS (SELECT SUM(n * (m - g) * (m - g)) AS b FROM c JOIN g USING (i)),
 r AS (SELECT p.label, MAX((sp.s + sq.s) / SQRT(gap)) AS r FROM (SELECT p.label, q.label AS other, SUM((p.m - q.m) * (p.m - q.m)) AS gap FROM c p JOIN c q ON p.i = q.i AND p.label <> q.label GROUP BY 1, 2) p JOIN s sp ON sp.label = p.label JOIN s sq ON sq.label = p.other GROUP BY 1),
 k AS (SELECT COUNT(*) AS k, SUM(n) AS nn, SUM(w) AS w FROM s)
 SELECT k AS clusters, ROUND((SELECT AVG((b - a) / GREATEST(a, b)) FROM q), 6) AS silhouette, ROUND((SELECT AVG(r) FROM r), 6) AS davies_bouldin, ROUND(b / (k - 1) / (w / (nn - k)), 6) AS calinski_harabasz FROM b, k""")
def v7(spark, sf):
    v = vectors(spark, sf)
    return rounded(metrics.clustering_metrics(v, "label", _E), 6)


# The 64 values of every embedding as rows (vec_id, label, i, x), and the means of the labels.
_LONG = """v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
 c AS (SELECT label, i, AVG(x) AS m, COUNT(*) AS n FROM v GROUP BY 1, 2)"""


@check("v7_calinski_harabasz", f"""WITH {_LONG}, w AS (SELECT SUM((x - m) * (x - m)) AS w FROM v JOIN c USING (label, i)), g AS (SELECT i, AVG(x) AS g FROM v GROUP BY 1),
 b AS (SELECT SUM(n * (m - g) * (m - g)) AS b FROM c JOIN g USING (i)), k AS (SELECT COUNT(DISTINCT label) AS k, COUNT(*) AS nn FROM embeddings)
 SELECT ROUND(b / (k - 1) / (w / (nn - k)), 6) AS calinski_harabasz FROM w, b, k""")
def v7_ch(spark, sf):
    return rounded(metrics.clustering_metrics(vectors(spark, sf), "label", _E).select("calinski_harabasz"), 6)


@check("v7_silhouette_samples", f"""WITH {_LONG}, d AS (SELECT vec_id, v.label, c.label AS other, c.n, SUM((x - m) * (x - m)) AS d FROM v JOIN c USING (i) GROUP BY ALL),
 s AS (SELECT label, SUM(d) / n AS w FROM d WHERE label = other GROUP BY label, n),
 q AS (SELECT vec_id, d.label, MAX(CASE WHEN d.label = other THEN (d + w) * n / (n - 1) END) AS a, MIN(CASE WHEN d.label <> other THEN d + w END) AS b FROM d JOIN s ON s.label = other GROUP BY 1, 2)
 SELECT vec_id, label, ROUND((b - a) / GREATEST(a, b), 6) AS silhouette FROM q""")
def v7_samples(spark, sf):
    return rounded(metrics.silhouette_samples(vectors(spark, sf), "label", _E).select("vec_id", "label", "silhouette"), 6)


@check("h1_grid_search")
def h1(spark, sf):
    return search.grid_search(graded(spark, sf), "quality", _D, "decision_tree_classifier", "doc_id", {"maxDepth": [2, 4]}, folds=2)


@check("h2_random_search")
def h2(spark, sf):
    return search.random_search(li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount"], "ridge", _KEY, {"alpha": (0.1, 100.0)}, n_iter=3, folds=2)


@check("h3_nested_cross_validation")
def h3(spark, sf):
    return search.nested_cross_validation(li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount"], "ridge", _KEY, {"alpha": [0.1, 100.0]}, outer=2, inner=2)


@check("r1_batch_scoring")
def r1(spark, sf):
    train, test = split_data(graded(spark, sf), "doc_id", 0.3)
    return models.score(models.train_model(train, "toxic", _D, "logistic_regression"), test)


@check("r2_centre_distances", """SELECT vec_id, CAST(rank AS INT) AS rank, cluster, ROUND(distance, 6) AS distance FROM (SELECT vec_id, c AS cluster, d AS distance, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY d, c) - 1 AS rank
 FROM (SELECT vec_id, CAST(c AS INT) AS c, SQRT(POWER(CAST(embedding[1] AS DOUBLE) - c * 0.1, 2) + POWER(CAST(embedding[2] AS DOUBLE) + c * 0.1, 2)) AS d FROM embeddings, range(3) t(c)) q) z""")
def r2(spark, sf):
    centres = [[i * 0.1, -i * 0.1] for i in range(3)]
    return rounded(models.centre_distances(vectors(spark, sf, 2), _E[:2], centres, "vec_id"), 6)


@check("r3_export_selection", "SELECT doc_id, quality, toxic, CAST(quality AS VARCHAR) AS kept FROM documents JOIN labels USING (doc_id)")
def r3(spark, sf):
    df = graded(spark, sf)
    out = models.score(models.train_model(df, "toxic", _D, "decision_tree_classifier"), df)
    out = models.export_selection(out, _D, keep_probabilities=False)
    return out.withColumn("kept", F.col("quality").cast("string")).drop("Predicted_Class")


@check("out5_model_round_trip")
def out5(spark, sf):
    from millrace.plans.sizing import scratch_path

    df = li(spark, sf)
    path = scratch_path(spark, "model")
    models.save_model(models.train_model(df, "l_extendedprice", ["l_quantity"], "linear_regression"), path)
    return models.score(models.load_model(path, "regressor"), df)
