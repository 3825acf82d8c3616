"""Checks of correlations, tests, chart tables and feature selection."""

from itertools import combinations

from pyspark.sql import functions as F

from checks.common import EN, LN, LO, RG, check, events_null, lineitem_null, lineitem_outlier, load, regressed, rounded, union_all
from millrace.operators import charts, corr, hypothesis, profile, select

_C = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_P = list(combinations(_C, 2))


def li(spark, sf):
    return load(spark, sf, "lineitem")


# --- correlations ---------------------------------------------------------------------------

@check("t1_pearson", f"WITH {LN}\n" + union_all([f"SELECT '{a}' AS column_1, '{b}' AS column_2, ROUND(CORR({a}, {b}), 6) AS correlation FROM ln" for a, b in _P]))
def t1(spark, sf):
    return rounded(corr.correlations(lineitem_null(spark, sf), _C), 6)


def _spear(a, b, table="ln"):
    avg_rank = lambda c: f"RANK() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return f"SELECT '{a}' AS column_1, '{b}' AS column_2, ROUND(CORR(ra, rb), 6) AS correlation FROM (SELECT {avg_rank(a)} AS ra, {avg_rank(b)} AS rb FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) q"


@check("t1_spearman", f"WITH {LN}\n" + union_all([_spear("l_quantity", "l_discount"), _spear("l_quantity", "l_tax"), _spear("l_discount", "l_tax")]))
def t1_spearman(spark, sf):
    return rounded(corr.correlations(lineitem_null(spark, sf), ["l_quantity", "l_discount", "l_tax"], "spearman"), 6)


def _kendall(a, b, table):
    return f"""SELECT '{a}' AS column_1, '{b}' AS column_2, ROUND(s / SQRT((n0 - tx) * (n0 - ty)), 6) AS correlation FROM
 (SELECT SUM(CAST(p.n AS DOUBLE) * q.n * SIGN(p.x - q.x) * SIGN(p.y - q.y)) / 2 AS s FROM (SELECT {a} AS x, {b} AS y, COUNT(*) AS n FROM {table} GROUP BY 1, 2) p, (SELECT {a} AS x, {b} AS y, COUNT(*) AS n FROM {table} GROUP BY 1, 2) q) c,
 (SELECT COUNT(*) * (COUNT(*) - 1.0) / 2 AS n0 FROM {table}) t, (SELECT SUM(n * (n - 1.0) / 2) AS tx FROM (SELECT COUNT(*) AS n FROM {table} GROUP BY {a}) g) u,
 (SELECT SUM(n * (n - 1.0) / 2) AS ty FROM (SELECT COUNT(*) AS n FROM {table} GROUP BY {b}) h) v"""


@check("t1_kendall", union_all([_kendall("l_quantity", "l_linenumber", "lineitem"), _kendall("l_quantity", "l_discount", "lineitem"), _kendall("l_linenumber", "l_discount", "lineitem")]))
def t1_kendall(spark, sf):
    return rounded(corr.correlations(li(spark, sf), ["l_quantity", "l_linenumber", "l_discount"], "kendall"), 6)


@check("t2_strong_pairs", "SELECT * FROM (" + union_all([f"SELECT '{a}' AS column_1, '{b}' AS column_2, ROUND(CORR({a}, {b}), 6) AS correlation FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem) q"
       for a, b in combinations(["l_quantity", "l_extendedprice", "net", "l_discount"], 2)]) + ") z WHERE ABS(correlation) >= 0.7")
def t2(spark, sf):
    df = li(spark, sf).withColumn("net", F.expr("l_extendedprice * (1 - l_discount)"))
    return rounded(corr.strong_pairs(df, ["l_quantity", "l_extendedprice", "net", "l_discount"], threshold=0.7), 6)


@check("t3_target_correlations", f"WITH {LN}\n" + union_all([f"SELECT '{c}' AS \"column\", ROUND(CORR({c}, l_extendedprice), 6) AS correlation FROM ln" for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")]))
def t3(spark, sf):
    return rounded(corr.target_correlations(lineitem_null(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber"]), 6)


@check("t17_trend_line", "SELECT ROUND(REGR_SLOPE(l_extendedprice, l_quantity), 6) AS slope, ROUND(REGR_INTERCEPT(l_extendedprice, l_quantity), 4) AS intercept, ROUND(REGR_R2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def t17(spark, sf):
    out = corr.trend_line(li(spark, sf), "l_quantity", "l_extendedprice")
    return out.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


# --- tests ----------------------------------------------------------------------------------

def _anova_sql(src, v, g):
    return f"""g AS (SELECT {g} AS g, COUNT({v}) AS n, AVG({v}) AS m, VAR_SAMP({v}) AS s FROM {src} GROUP BY 1),
 a AS (SELECT SUM(n) AS nn, COUNT(*) AS k, SUM(n * m) / SUM(n) AS mm, SUM((n - 1) * s) AS w FROM g),
 f AS (SELECT (SELECT SUM(n * (m - mm) * (m - mm)) FROM g, a) / (k - 1) / (w / (nn - k)) AS f FROM a)"""


@check("t4_anova", f"WITH {_anova_sql('orders', 'o_totalprice', 'o_orderpriority')} SELECT ROUND(f, 4) AS f_statistic FROM f")
def t4(spark, sf):
    return rounded(hypothesis.anova(load(spark, sf, "orders"), "o_totalprice", "o_orderpriority").select("f_statistic"))


def _chi_sql(a, b, table):
    return f"""o AS (SELECT {a} AS a, {b} AS b, COUNT(*) AS o FROM {table} GROUP BY 1, 2), ra AS (SELECT a, SUM(o) AS r FROM o GROUP BY 1), rb AS (SELECT b, SUM(o) AS c FROM o GROUP BY 1),
 e AS (SELECT r * 1.0 * c / (SELECT SUM(o) FROM o) AS e, COALESCE(o.o, 0) AS o FROM ra CROSS JOIN rb LEFT JOIN o USING (a, b))"""


@check("t5_chi2", f"WITH {_chi_sql('o_orderpriority', 'o_orderstatus', 'orders')} SELECT ROUND(SUM((o - e) * (o - e) / e), 4) AS chi2, CAST((SELECT COUNT(*) - 1 FROM ra) * (SELECT COUNT(*) - 1 FROM rb) AS BIGINT) AS dof FROM e")
def t5(spark, sf):
    return rounded(hypothesis.chi2(load(spark, sf, "orders"), "o_orderpriority", "o_orderstatus").select("chi2", "dof"))


@check("t5_chi2_yates", f"WITH {_chi_sql('quality', 'toxic', 'labels')} SELECT ROUND(SUM(POWER(ABS(o - e) - LEAST(0.5, ABS(o - e)), 2) / e), 4) AS chi2, 1 AS dof FROM e")
def t5_yates(spark, sf):
    return rounded(hypothesis.chi2(load(spark, sf, "labels"), "quality", "toxic").select("chi2", F.col("dof").cast("int").alias("dof")))


_TT = "a AS (SELECT COUNT(*) AS n, AVG(o_totalprice) AS m, VAR_SAMP(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT COUNT(*) AS n, AVG(o_totalprice) AS m, VAR_SAMP(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O')"


@check("t6_t_test", f"WITH {_TT} SELECT ROUND((a.m - b.m) / SQRT(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 6) AS t_statistic, ROUND(CAST(a.n + b.n - 2 AS DOUBLE), 6) AS dof FROM a, b")
def t6(spark, sf):
    return rounded(hypothesis.t_test(load(spark, sf, "orders"), "o_totalprice", "o_orderstatus", "F", "O").select("t_statistic", "dof"), 6)


@check("t6_welch", f"WITH {_TT} SELECT ROUND((a.m - b.m) / SQRT(a.v / a.n + b.v / b.n), 6) AS t_statistic, ROUND(POWER(a.v / a.n + b.v / b.n, 2) / (POWER(a.v / a.n, 2) / (a.n - 1) + POWER(b.v / b.n, 2) / (b.n - 1)), 4) AS dof FROM a, b")
def t6_welch(spark, sf):
    out = hypothesis.t_test(load(spark, sf, "orders"), "o_totalprice", "o_orderstatus", "F", "O", equal_var=False)
    return out.select(F.round("t_statistic", 6).alias("t_statistic"), F.round("dof", 4).alias("dof"))


@check("t7_paired_t_test", f"WITH {RG} SELECT ROUND(AVG(y - p) / (STDDEV_SAMP(y - p) / SQRT(COUNT(*))), 6) AS t_statistic FROM rg")
def t7(spark, sf):
    return rounded(hypothesis.paired_t_test(regressed(spark, sf), "y", "p").select("t_statistic"), 6)


_RANK = "RANK() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@check("t8_mann_whitney", f"""WITH r AS (SELECT l_returnflag AS g, {_RANK.format(c='l_quantity')} AS r FROM lineitem WHERE l_returnflag IN ('A', 'R'))
 SELECT ROUND(SUM(r) - COUNT(*) * (COUNT(*) + 1) / 2.0, 4) AS u_statistic FROM r WHERE g = 'A'""")
def t8(spark, sf):
    return rounded(hypothesis.mann_whitney(li(spark, sf), "l_quantity", "l_returnflag", "A", "R").select("u_statistic"))


@check("t9_wilcoxon", f"""WITH {RG}, d AS (SELECT y - p AS d FROM rg WHERE y - p <> 0), r AS (SELECT d, {_RANK.format(c='ABS(d)')} AS r FROM d)
 SELECT ROUND(LEAST(SUM(r) FILTER (WHERE d > 0), SUM(r) FILTER (WHERE d < 0)), 4) AS w_statistic FROM r""")
def t9(spark, sf):
    return rounded(hypothesis.wilcoxon(regressed(spark, sf), "y", "p").select("w_statistic"))


@check("t10_kruskal", f"""WITH r AS (SELECT l_returnflag AS g, l_quantity AS v, {_RANK.format(c='l_quantity')} AS r FROM lineitem), s AS (SELECT SUM(r) AS s, COUNT(*) AS n FROM r GROUP BY g),
 t AS (SELECT SUM(CAST(c AS DOUBLE) * c * c - c) AS t FROM (SELECT COUNT(*) AS c FROM r GROUP BY v) q), a AS (SELECT SUM(n) * 1.0 AS n, SUM(s * s / n) AS q FROM s)
 SELECT ROUND((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 4) AS h_statistic FROM a, t""")
def t10(spark, sf):
    return rounded(hypothesis.kruskal(li(spark, sf), "l_quantity", "l_returnflag").select("h_statistic"))


@check("t11_levene", f"WITH d AS (SELECT o_orderpriority AS g, ABS(o_totalprice - MEDIAN(o_totalprice) OVER (PARTITION BY o_orderpriority)) AS d FROM orders), {_anova_sql('d', 'd', 'd.g')} SELECT ROUND(f, 4) AS statistic FROM f")
def t11(spark, sf):
    return rounded(hypothesis.levene(load(spark, sf, "orders"), "o_totalprice", "o_orderpriority").select("statistic"))


@check("t12_normality")
def t12(spark, sf):
    return hypothesis.normality(load(spark, sf, "customer"), ["c_acctbal"])


@check("t13_bootstrap_ci")
def t13(spark, sf):
    return hypothesis.bootstrap_ci(load(spark, sf, "orders"), "o_totalprice", "o_orderkey")


@check("t13_bootstrap_median")
def t13_median(spark, sf):
    return hypothesis.bootstrap_ci(load(spark, sf, "orders"), "o_totalprice", "o_orderkey", "median")


@check("t14_vif", f"""WITH g AS (SELECT SUM(l_quantity * l_quantity) AS aa, SUM(l_quantity * l_tax) AS ab, SUM(l_tax * l_tax) AS bb FROM lineitem)
 SELECT 'l_quantity' AS "column", ROUND(aa * bb / (aa * bb - ab * ab), 6) AS vif FROM g UNION ALL SELECT 'l_tax', ROUND(aa * bb / (aa * bb - ab * ab), 6) FROM g""")
def t14(spark, sf):
    return rounded(hypothesis.vif(li(spark, sf), ["l_quantity", "l_tax"]), 6)


def _mi_sql(c):
    q = ", ".join(f"{i / 10!r}" for i in range(1, 10))
    return f"""SELECT '{c}' AS "column", ROUND(SUM(n * 1.0 / t * LN(n * 1.0 * t / (nx * 1.0 * ny))), 6) AS score FROM (SELECT x, y, COUNT(*) AS n, SUM(COUNT(*)) OVER (PARTITION BY x) AS nx, SUM(COUNT(*)) OVER (PARTITION BY y) AS ny, SUM(COUNT(*)) OVER () AS t
 FROM (SELECT len(list_filter(list_distinct((SELECT QUANTILE_CONT({c}, [{q}]) FROM lineitem)), lambda e: e < {c})) AS x, l_returnflag AS y FROM lineitem) b GROUP BY 1, 2) c"""


@check("t15_mutual_information", union_all([_mi_sql("l_quantity"), _mi_sql("l_extendedprice")]))
def t15(spark, sf):
    return rounded(hypothesis.mutual_information(li(spark, sf), ["l_quantity", "l_extendedprice"], "l_returnflag"), 6)


# --- chart tables ---------------------------------------------------------------------------

@check("p1_histogram_tax", """WITH e AS (SELECT MIN(l_tax) AS lo, (MAX(l_tax) - MIN(l_tax)) / 7 AS w FROM lineitem), b AS (SELECT CAST(LEAST(FLOOR((l_tax - lo) / w), 6) AS INT) AS bin, COUNT(*) AS c FROM lineitem, e GROUP BY 1)
 SELECT CAST(i AS INT) AS bin, ROUND(lo + i * w, 4) AS left_edge, ROUND(lo + (i + 1) * w, 4) AS right_edge, COALESCE(c, 0) AS count FROM range(7) t(i) CROSS JOIN e LEFT JOIN b ON b.bin = t.i""")
def p1(spark, sf):
    return rounded(profile.histogram(li(spark, sf), "l_tax", 7))


@check("p2_ecdf", "SELECT o_totalprice AS value, ROUND(SUM(COUNT(*)) OVER (ORDER BY o_totalprice) * 1.0 / SUM(COUNT(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def p2(spark, sf):
    out = charts.ecdf(load(spark, sf, "orders"), "o_totalprice")
    return out.select("value", F.round("share", 6).alias("share"))


def _density_sql(column, points, group):
    k = f"{group}, " if group else ""
    return f"""WITH g AS (SELECT MIN({column}) AS lo, (MAX({column}) - MIN({column})) / {points - 1} AS step FROM lineitem), s AS (SELECT {k}COUNT(*) AS n, STDDEV_SAMP({column}) * POWER(COUNT(*), -0.2) AS h FROM lineitem {f'GROUP BY {group}' if group else ''}),
 v AS (SELECT {k}{column} AS m, COUNT(*) AS c FROM lineitem GROUP BY ALL), p AS (SELECT CAST(i AS INTEGER) AS point, lo + i * step AS x FROM range({points}) t(i), g)
 SELECT {k}point, ROUND(x, 4) AS x, ROUND(SUM(c * EXP(-0.5 * POWER((x - m) / h, 2)) / (n * h * SQRT(2 * PI()))) * 1e6, 4) AS density FROM v {f'JOIN s USING ({group})' if group else 'CROSS JOIN s'} CROSS JOIN p GROUP BY {k}point, x"""


@check("p3_density", _density_sql("l_extendedprice", 200, None))
def p3(spark, sf):
    out = charts.density(li(spark, sf), "l_extendedprice")
    return rounded(out.withColumn("density", F.col("density") * 1e6))


@check("p4_box_plot", """WITH q AS (SELECT l_returnflag AS k, QUANTILE_CONT(l_extendedprice, 0.25) AS a, MEDIAN(l_extendedprice) AS m, QUANTILE_CONT(l_extendedprice, 0.75) AS b FROM lo GROUP BY 1)
 SELECT l_returnflag, COUNT(*) AS count, ROUND(MIN(l_extendedprice) FILTER (WHERE l_extendedprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)), 4) AS low_whisker, ROUND(MAX(a), 4) AS q1, ROUND(MAX(m), 4) AS median, ROUND(MAX(b), 4) AS q3,
 ROUND(MAX(l_extendedprice) FILTER (WHERE l_extendedprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)), 4) AS high_whisker,
 COUNT(*) FILTER (WHERE l_extendedprice < a - 1.5 * (b - a) OR l_extendedprice > b + 1.5 * (b - a)) AS outliers FROM lo JOIN q ON k = l_returnflag GROUP BY 1""".replace("WITH q", f"WITH {LO}, q"))
def p4(spark, sf):
    return rounded(charts.box_plot(lineitem_outlier(spark, sf), "l_extendedprice", "l_returnflag"))


@check("p5_count_plot", "SELECT l_returnflag, l_linestatus, COUNT(*) AS count FROM lineitem GROUP BY 1, 2")
def p5(spark, sf):
    return charts.count_plot(li(spark, sf), "l_returnflag", "l_linestatus")


@check("p5_bar_means", "SELECT l_returnflag, l_linestatus, ROUND(AVG(l_quantity), 4) AS mean, COUNT(*) AS count FROM lineitem GROUP BY 1, 2")
def p5_bar(spark, sf):
    return rounded(charts.bar_means(li(spark, sf), "l_returnflag", "l_quantity", "l_linestatus"))


@check("p6_correlation_cells", union_all([f"SELECT '{b}' AS \"row\", '{a}' AS \"column\", ROUND(CORR({a}, {b}), 6) AS correlation FROM lineitem" for a, b in _P]))
def p6(spark, sf):
    return rounded(charts.correlation_cells(li(spark, sf), _C), 6)


@check("p7_qq_points")
def p7(spark, sf):
    return charts.qq_points(load(spark, sf, "orders"), "o_totalprice")


@check("p7_qq_fit")
def p7_fit(spark, sf):
    return charts.qq_fit(charts.qq_points(load(spark, sf, "orders"), "o_totalprice"))


@check("p8_violin_density", _density_sql("l_quantity", 100, "l_returnflag"))
def p8(spark, sf):
    out = charts.violin(li(spark, sf), "l_quantity", "l_returnflag", 100)[0]
    return rounded(out.withColumn("density", F.col("density") * 1e6))


@check("p9_melt_series", union_all([f"SELECT o_orderkey, '{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM orders" for c in ("o_totalprice", "o_custkey")]))
def p9(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    return charts.melt_series(df, ["o_orderkey"], ["o_totalprice", "o_custkey"])


@check("p10_residual_scatter", f"WITH {RG} SELECT COUNT(*) AS count, ROUND(AVG(y - p), 2) AS mean_residual, ROUND(STDDEV_SAMP(y - p), 2) AS std_residual, ROUND(CORR(y - p, p), 4) AS correlation, ROUND(REGR_SLOPE(y - p, p), 4) AS slope, ROUND(REGR_INTERCEPT(y - p, p), 2) AS intercept FROM rg")
def p10(spark, sf):
    r = charts.residual_scatter(regressed(spark, sf), "y", "p")
    k = {"correlation": 4, "slope": 4}
    return r.select("count", *[F.round(c, k.get(c, 2)).alias(c) for c in r.columns if c != "count"])


@check("p11_pie_shares", "SELECT o_orderstatus, ROUND(SUM(o_totalprice), 2) AS total, ROUND(SUM(o_totalprice) / SUM(SUM(o_totalprice)) OVER (), 6) AS share FROM orders GROUP BY 1")
def p11(spark, sf):
    out = charts.pie_shares(load(spark, sf, "orders"), "o_orderstatus", "o_totalprice")
    return out.select("o_orderstatus", F.round("total", 2).alias("total"), F.round("share", 6).alias("share"))


_MASK = " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in ("l_quantity", "l_discount", "l_returnflag", "l_tax"))


@check("p12_null_pattern", f"WITH {LN} SELECT {_MASK} AS pattern, COUNT(*) AS \"rows\" FROM ln GROUP BY 1")
def p12(spark, sf):
    return profile.null_pattern(lineitem_null(spark, sf).select("l_quantity", "l_discount", "l_returnflag", "l_tax"))


@check("p13_scatter_bins", """WITH e AS (SELECT MIN(l_quantity) AS xl, (MAX(l_quantity) - MIN(l_quantity)) / 20 AS xw, MIN(l_extendedprice) AS yl, (MAX(l_extendedprice) - MIN(l_extendedprice)) / 20 AS yw FROM lineitem)
 SELECT CAST(LEAST(FLOOR((l_quantity - xl) / xw), 19) AS INT) AS x_bin, CAST(LEAST(FLOOR((l_extendedprice - yl) / yw), 19) AS INT) AS y_bin, COUNT(*) AS count, ROUND(AVG(l_quantity), 3) AS x_mean, ROUND(AVG(l_extendedprice), 3) AS y_mean FROM lineitem, e GROUP BY 1, 2""")
def p13(spark, sf):
    return rounded(charts.scatter_bins(li(spark, sf), "l_quantity", "l_extendedprice"), 3)


# --- feature selection ----------------------------------------------------------------------

@check("l1_select_by_variance", "SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def l1(spark, sf):
    df = li(spark, sf).select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return select.select_features(df, "variance", threshold=0.1)


@check("l2_select_by_correlation", "SELECT l_orderkey, l_quantity, l_extendedprice, l_discount FROM lineitem")
def l2(spark, sf):
    df = li(spark, sf).selectExpr("l_orderkey", "l_quantity", "l_extendedprice", "l_extendedprice * (1 - l_discount) AS net", "l_discount")
    return select.select_features(df, "correlation", columns=["l_quantity", "l_extendedprice", "net", "l_discount"], threshold=0.96)


@check("l3_select_by_information")
def l3(spark, sf):
    df = li(spark, sf).select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return select.select_features(df, "mutual_info", "l_returnflag", k=2)


def _fclass(c):
    return f"""SELECT '{c}' AS "column", ROUND((SUM(s * s / n) - SUM(s) * SUM(s) / SUM(n)) / (COUNT(*) - 1) / (SUM(v * (n - 1)) / (SUM(n) - COUNT(*))), 4) AS score
 FROM (SELECT COUNT({c}) AS n, SUM({c}) AS s, VAR_SAMP({c}) AS v FROM lineitem GROUP BY l_returnflag) g"""


@check("l4_f_classif", union_all([_fclass(c) for c in _C]))
def l4(spark, sf):
    return rounded(select.feature_scores(li(spark, sf), "l_returnflag", _C, "f_classif"))


def _chi_feature(c):
    return f"""SELECT '{c}' AS "column", ROUND(SUM(POWER(s - n * 1.0 / nn * ss, 2) / (n * 1.0 / nn * ss)), 4) AS score FROM (SELECT COUNT(*) AS n, SUM({c}) AS s, SUM(COUNT(*)) OVER () AS nn, SUM(SUM({c})) OVER () AS ss FROM lineitem GROUP BY l_returnflag) g"""


@check("l4_chi2", union_all([_chi_feature(c) for c in _C]))
def l4_chi2(spark, sf):
    return rounded(select.feature_scores(li(spark, sf), "l_returnflag", _C))


@check("l4_f_regression", union_all([f"SELECT '{c}' AS \"column\", ROUND(POWER(CORR({c}, l_extendedprice), 2) * (COUNT(*) - 2) / (1 - POWER(CORR({c}, l_extendedprice), 2)), 3) AS score FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")]))
def l4_regression(spark, sf):
    return rounded(select.feature_scores(li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]), 3)


@check("l4_select_best_k", "SELECT l_extendedprice, ROUND(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem")
def l4_best(spark, sf):
    df = li(spark, sf).selectExpr("l_extendedprice", "l_discount", "ROUND(l_extendedprice * (1 - l_discount), 6) AS net", "l_tax")
    return select.select_features(df, "k_best", "l_extendedprice", k=1)


@check("l8_task_rule", "SELECT CASE WHEN COUNT(DISTINCT l_linenumber) > 10 THEN 'regression' ELSE 'classification' END AS linenumber, CASE WHEN COUNT(DISTINCT l_quantity) > 10 THEN 'regression' ELSE 'classification' END AS quantity, 'classification' AS flag FROM lineitem")
def l8(spark, sf):
    df = li(spark, sf)
    tasks = {n: select.task_of(df, c) for n, c in (("linenumber", "l_linenumber"), ("quantity", "l_quantity"), ("flag", "l_returnflag"))}
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in tasks.items()])
