"""Checks of missing values, outliers, encoding, scaling and numeric transforms."""

import math

from pyspark.sql import functions as F

from checks.common import EN, LN, LO, check, events_null, lineitem_null, lineitem_outlier, load, rounded, union_all
from millrace.operators import encode, missing, outliers, scale, transform
from millrace.plans.spec import Recipe, fit, fit_transform

NUM = ["l_quantity", "l_discount"]
_KEEP = "l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag"


def ln(spark, sf):
    return lineitem_null(spark, sf).select(*_KEEP.split(", "))


# --- missing values -------------------------------------------------------------------------

@check("m1_remove_rows", f"WITH {LN} SELECT {_KEEP} FROM ln WHERE CAST(l_quantity IS NOT NULL AS INT) + CAST(l_discount IS NOT NULL AS INT) + CAST(l_returnflag IS NOT NULL AS INT) >= 2")
def m1(spark, sf):
    return missing.handle_missing_values(ln(spark, sf), "remove_rows", ["l_quantity", "l_discount", "l_returnflag"], threshold=0.7)


@check("m1_remove_rows_any", f"WITH {LN} SELECT {_KEEP} FROM ln WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_returnflag IS NOT NULL")
def m1_any(spark, sf):
    return missing.handle_missing_values(ln(spark, sf), "remove_rows")


@check("m2_remove_columns", f"WITH {LN} SELECT l_orderkey, l_linenumber, l_discount, l_returnflag FROM ln")
def m2(spark, sf):
    return missing.handle_missing_values(ln(spark, sf), "remove_columns", threshold=0.25)


def _fill_sql(expr):
    fill = ", ".join(f"ROUND(COALESCE({c}, (SELECT {expr.format(c=c)} FROM ln)), 6) AS {c}" for c in NUM)
    return f"WITH {LN} SELECT l_orderkey, l_linenumber, {fill}, l_returnflag FROM ln"


@check("m3_fill_mean", _fill_sql("AVG({c})"))
def m3(spark, sf):
    return rounded(missing.handle_missing_values(ln(spark, sf), "fill_mean", NUM), 6)


@check("m4_fill_median", _fill_sql("MEDIAN({c})"))
def m4(spark, sf):
    return rounded(missing.handle_missing_values(ln(spark, sf), "fill_median", NUM), 6)


_MODE = "(SELECT {c} FROM ln WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1)"


@check("m5_fill_mode", f"WITH {LN} SELECT l_orderkey, l_linenumber, " + ", ".join(f"COALESCE({c}, {_MODE.format(c=c)}) AS {c}" for c in NUM + ["l_returnflag"]) + " FROM ln")
def m5(spark, sf):
    return missing.handle_missing_values(ln(spark, sf), "fill_mode", NUM + ["l_returnflag"])


@check("m6_fill_constant", f"WITH {LN} SELECT l_orderkey, l_linenumber, COALESCE(l_quantity, -1) AS l_quantity, COALESCE(l_discount, -1) AS l_discount, COALESCE(l_returnflag, 'unknown') AS l_returnflag FROM ln")
def m6(spark, sf):
    df = missing.handle_missing_values(ln(spark, sf), "fill_constant", NUM, value=-1)
    return missing.handle_missing_values(df, "fill_constant", ["l_returnflag"], value="unknown")


def _interp_sql(part, inner):
    p = f"PARTITION BY {part} " if part else ""
    g = f"{part}, " if part else ""
    return f"""WITH {EN}, r AS (SELECT event_id, user_id, value, epoch_us(ts) / 1.0 AS us, ROW_NUMBER() OVER ({p}ORDER BY ts, event_id) AS pos FROM en),
 w AS (SELECT *, LAST_VALUE(value IGNORE NULLS) OVER a AS pv, LAST_VALUE(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS pp,
  LAST_VALUE(CASE WHEN value IS NOT NULL THEN us END IGNORE NULLS) OVER a AS pt,
  FIRST_VALUE(value IGNORE NULLS) OVER b AS nv, FIRST_VALUE(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS np,
  FIRST_VALUE(CASE WHEN value IS NOT NULL THEN us END IGNORE NULLS) OVER b AS nt FROM r
  WINDOW a AS ({p}ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS ({p}ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT event_id, user_id, ROUND(COALESCE(value, {inner}, pv, nv), 6) AS value FROM w"""


def _interp(spark, sf, method, part=()):
    e = events_null(spark, sf)
    return rounded(missing.fill_interpolation(e, ["value"], ["ts", "event_id"], part, method, "ts").select("event_id", "user_id", "value"), 6)


@check("m7_interpolate_linear", _interp_sql(None, "pv + (nv - pv) * (pos - pp) / (np - pp)"))
def m7(spark, sf):
    return _interp(spark, sf, "linear")


@check("m7_interpolate_grouped", _interp_sql("user_id", "pv + (nv - pv) * (pos - pp) / (np - pp)"))
def m7_grouped(spark, sf):
    return _interp(spark, sf, "linear", ["user_id"])


@check("m7_interpolate_time", _interp_sql(None, "pv + (nv - pv) * (us - pt) / NULLIF(nt - pt, 0)"))
def m7_time(spark, sf):
    return _interp(spark, sf, "time")


@check("m7_interpolate_nearest", _interp_sql("user_id", "CASE WHEN nv IS NULL OR pos - pp <= np - pos THEN pv ELSE nv END"))
def m7_nearest(spark, sf):
    return _interp(spark, sf, "nearest", ["user_id"])


@check("m7_interpolate_zero", _interp_sql("user_id", "pv"))
def m7_zero(spark, sf):
    return _interp(spark, sf, "zero", ["user_id"])


@check("m9_fill_regression", f"""WITH {LN}, m AS (SELECT REGR_SLOPE(l_extendedprice, l_quantity) AS a, REGR_INTERCEPT(l_extendedprice, l_quantity) AS b
 FROM (SELECT CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS l_quantity FROM lineitem) q)
 SELECT l_orderkey, l_linenumber, l_quantity, ROUND(COALESCE(CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_extendedprice END, a * l_quantity + b), 2) AS l_extendedprice FROM ln, m""")
def m9(spark, sf):
    df = lineitem_null(spark, sf).withColumn("l_extendedprice", F.expr("CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_extendedprice END"))
    out = missing.handle_missing_values(df, "fill_regression", ["l_extendedprice"], features=["l_quantity"])
    return rounded(out.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), 2)


# --- outliers -------------------------------------------------------------------------------

_X = "l_extendedprice"
_Z = f"z AS (SELECT AVG({_X}) AS m, STDDEV_POP({_X}) AS s, STDDEV_SAMP({_X}) AS ss FROM lo)"
_Q = f"q AS (SELECT QUANTILE_CONT({_X}, 0.25) AS a, QUANTILE_CONT({_X}, 0.75) AS b, QUANTILE_CONT({_X}, 0.01) AS p1, QUANTILE_CONT({_X}, 0.99) AS p99, QUANTILE_CONT({_X}, 0.05) AS p5, QUANTILE_CONT({_X}, 0.95) AS p95 FROM lo)"
_IQR = "(l_extendedprice < a - 1.5 * (b - a) OR l_extendedprice > b + 1.5 * (b - a))"


def lo(spark, sf):
    return lineitem_outlier(spark, sf).select("l_orderkey", "l_linenumber", _X)


@check("o1_detect_zscore", f"WITH {LO}, {_Z} SELECT l_orderkey, l_linenumber, {_X}, ABS({_X} - m) / s > 3 AS l_extendedprice_outlier FROM lo, z")
def o1(spark, sf):
    return outliers.detect_outliers(lo(spark, sf), [_X], "zscore")


@check("o2_detect_iqr", f"WITH {LO}, {_Q} SELECT l_orderkey, l_linenumber, {_X}, {_IQR} AS l_extendedprice_outlier FROM lo, q")
def o2(spark, sf):
    return outliers.detect_outliers(lo(spark, sf), [_X], "iqr")


@check("o3_detect_quantile", f"WITH {LO}, {_Q} SELECT l_orderkey, l_linenumber, {_X}, {_X} < p1 OR {_X} > p99 AS l_extendedprice_outlier FROM lo, q")
def o3(spark, sf):
    return outliers.detect_outliers(lo(spark, sf), [_X], "quantile")


@check("o6_remove_outliers", f"WITH {LO}, {_Q} SELECT l_orderkey, l_linenumber, {_X} FROM lo, q WHERE NOT {_IQR}")
def o6(spark, sf):
    return fit_transform("remove_outliers", lo(spark, sf), [_X], method="iqr")


def _cap_sql(lo_, hi_):
    return f"WITH {LO}, {_Z}, {_Q} SELECT l_orderkey, l_linenumber, ROUND(GREATEST(LEAST({_X}, {hi_}), {lo_}), 4) AS {_X} FROM lo, z, q"


@check("o7_cap_iqr", _cap_sql("a - 1.5 * (b - a)", "b + 1.5 * (b - a)"))
def o7(spark, sf):
    return rounded(fit_transform("cap_outliers", lo(spark, sf), [_X], method="iqr"))


@check("o7_cap_quantile", _cap_sql("p5", "p95"))
def o7_quantile(spark, sf):
    return rounded(fit_transform("cap_outliers", lo(spark, sf), [_X], method="quantile", lower=0.05, upper=0.95))


@check("o7_cap_zscore", _cap_sql("m - 3 * ss", "m + 3 * ss"))
def o7_zscore(spark, sf):
    return rounded(fit_transform("cap_outliers", lo(spark, sf), [_X], method="zscore"))


@check("o8_replace_mean", f"WITH {LO}, {_Q}, {_Z} SELECT l_orderkey, l_linenumber, ROUND(CASE WHEN {_IQR} THEN m ELSE {_X} END, 4) AS {_X} FROM lo, q, z")
def o8(spark, sf):
    return rounded(fit_transform("replace_outliers_mean", lo(spark, sf), [_X], method="iqr"))


@check("o9_replace_median", f"WITH {LO}, {_Q}, d AS (SELECT MEDIAN({_X}) AS m FROM lo) SELECT l_orderkey, l_linenumber, ROUND(CASE WHEN {_IQR} THEN m ELSE {_X} END, 4) AS {_X} FROM lo, q, d")
def o9(spark, sf):
    return rounded(fit_transform("replace_outliers_median", lo(spark, sf), [_X], method="iqr"))


def _osum(c):
    return f"""SELECT '{c}' AS "column", COUNT(*) FILTER (WHERE ABS({c} - m) / s > 3) AS count, ROUND(COUNT(*) FILTER (WHERE ABS({c} - m) / s > 3) * 100.0 / COUNT({c}), 2) AS percentage,
 ROUND(MIN({c}) FILTER (WHERE ABS({c} - m) / s > 3), 4) AS min, ROUND(MAX({c}) FILTER (WHERE ABS({c} - m) / s > 3), 4) AS max FROM lo, (SELECT AVG({c}) AS m, STDDEV_POP({c}) AS s FROM lo) z"""


@check("o10_outlier_summary", f"WITH {LO}\n" + union_all([_osum("l_extendedprice"), _osum("l_quantity")]))
def o10(spark, sf):
    return rounded(outliers.outlier_summary(lineitem_outlier(spark, sf), ["l_extendedprice", "l_quantity"]))


# --- encoding -------------------------------------------------------------------------------

def flags(spark, sf):
    return lineitem_null(spark, sf).select("l_orderkey", "l_extendedprice", "l_returnflag", "l_linestatus")


@check("e1_one_hot", f"""WITH {LN} SELECT l_orderkey, l_extendedprice, """ + ", ".join(
    f"CAST(l_returnflag IS NOT DISTINCT FROM '{v}' AS DOUBLE) AS \"l_returnflag_{v}\"" for v in "ANR") +
    """, CAST(l_returnflag IS NULL AS DOUBLE) AS l_returnflag_nan, CAST(l_linestatus = 'F' AS DOUBLE) AS "l_linestatus_F", CAST(l_linestatus = 'O' AS DOUBLE) AS "l_linestatus_O" FROM ln""")
def e1(spark, sf):
    return encode.encode_features(flags(spark, sf), "one_hot")


@check("e1_one_hot_drop_first", f"""WITH {LN} SELECT l_orderkey, l_extendedprice, CAST(l_returnflag IS NOT DISTINCT FROM 'N' AS DOUBLE) AS "l_returnflag_N",
 CAST(l_returnflag IS NOT DISTINCT FROM 'R' AS DOUBLE) AS "l_returnflag_R", CAST(l_returnflag IS NULL AS DOUBLE) AS l_returnflag_nan, CAST(l_linestatus = 'O' AS DOUBLE) AS "l_linestatus_O" FROM ln""")
def e1_drop(spark, sf):
    return encode.encode_features(flags(spark, sf), "one_hot", drop_first=True)


@check("e1_one_hot_vector")
def e1_vector(spark, sf):
    return encode.one_hot_vector(load(spark, sf, "part"), ["p_brand", "p_type"]).select("p_partkey", "p_brand_vector", "p_type_vector")


def _code_sql(c, start=0):
    return f"(SELECT v, DENSE_RANK() OVER (ORDER BY v) - 1 + {start} AS code FROM (SELECT DISTINCT COALESCE({c}, 'nan') AS v FROM ln) d)"


@check("e2_label", f"""WITH {LN} SELECT l_orderkey, l_extendedprice, a.code AS l_returnflag, b.code AS l_linestatus FROM ln
 JOIN {_code_sql('l_returnflag')} a ON a.v = COALESCE(l_returnflag, 'nan') JOIN {_code_sql('l_linestatus')} b ON b.v = l_linestatus""")
def e2(spark, sf):
    return encode.encode_features(flags(spark, sf), "label", ["l_returnflag", "l_linestatus"])


@check("e3_ordinal", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0.0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 END AS o_orderpriority,
 CASE o_orderstatus WHEN 'P' THEN 0.0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS o_orderstatus FROM orders""")
def e3(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return encode.encode_features(o, "ordinal", ["o_orderpriority", "o_orderstatus"], categories={"o_orderstatus": ["P", "O", "F"]})


@check("e4_target", f"""WITH {LN}, s AS (SELECT l_returnflag AS k, COUNT(*) AS n, AVG(l_extendedprice) AS m FROM ln WHERE l_returnflag IS NOT NULL GROUP BY 1),
 p AS (SELECT AVG(l_extendedprice) AS prior FROM ln)
 SELECT l_orderkey, l_extendedprice, ROUND(COALESCE(prior * (1 - 1 / (1 + EXP(-(n - 20) / 10.0))) + m / (1 + EXP(-(n - 20) / 10.0)), prior), 4) AS l_returnflag, l_linestatus
 FROM ln CROSS JOIN p LEFT JOIN s ON k = l_returnflag""")
def e4(spark, sf):
    return rounded(encode.encode_features(flags(spark, sf), "target", ["l_returnflag"], target="l_extendedprice"))


@check("e5_binary", """WITH c AS (SELECT v, ROW_NUMBER() OVER (ORDER BY v) AS code FROM (SELECT DISTINCT p_brand AS v FROM part) d)
 SELECT p_partkey, """ + ", ".join(f"CAST((code >> {4 - i}) & 1 AS INT) AS p_brand_{i}" for i in range(5)) + " FROM part JOIN c ON v = p_brand")
def e5(spark, sf):
    return encode.encode_features(load(spark, sf, "part").select("p_partkey", "p_brand"), "binary", ["p_brand"])


@check("e6_frequency", f"""WITH {LN}, s AS (SELECT l_returnflag AS k, COUNT(*) * 1.0 / SUM(COUNT(*)) OVER () AS f FROM ln WHERE l_returnflag IS NOT NULL GROUP BY 1)
 SELECT l_orderkey, l_extendedprice, ROUND(f, 6) AS l_returnflag, l_linestatus FROM ln LEFT JOIN s ON k = l_returnflag""")
def e6(spark, sf):
    return rounded(encode.encode_features(flags(spark, sf), "frequency", ["l_returnflag"]), 6)


@check("e7_hash")
def e7(spark, sf):
    return encode.encode_features(load(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), "hash", ["p_brand", "p_type"], features=64)


# --- scaling and transforms -----------------------------------------------------------------

def wide(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")


_S = ["l_quantity", "l_extendedprice"]


def _scale_sql(expr, decimals=6):
    cols = ", ".join(f"ROUND({expr.format(c=c)}, {decimals}) AS {c}" for c in _S)
    stats = ", ".join(
        f"AVG({c}) AS {c}_m, STDDEV_POP({c}) AS {c}_s, MIN({c}) AS {c}_a, MAX({c}) AS {c}_b, MEDIAN({c}) AS {c}_d, QUANTILE_CONT({c}, 0.25) AS {c}_q1, QUANTILE_CONT({c}, 0.75) AS {c}_q3" for c in _S)
    return f"WITH s AS (SELECT {stats} FROM lineitem) SELECT l_orderkey, l_linenumber, {cols}, ROUND(l_discount, {decimals}) AS l_discount FROM lineitem, s"


@check("n1_standardize", _scale_sql("({c} - {c}_m) / {c}_s"))
def n1(spark, sf):
    return rounded(scale.scale_features(wide(spark, sf), "standard", _S), 6)


@check("n2_minmax", _scale_sql("({c} - {c}_a) / ({c}_b - {c}_a) * 2 - 1"))
def n2(spark, sf):
    return rounded(scale.scale_features(wide(spark, sf), "minmax", _S, feature_range=(-1, 1)), 6)


@check("n3_robust", _scale_sql("({c} - {c}_d) / ({c}_q3 - {c}_q1)"))
def n3(spark, sf):
    return rounded(scale.scale_features(wide(spark, sf), "robust", _S), 6)


_L2 = "SQRT(l_quantity * l_quantity + l_extendedprice * l_extendedprice)"


@check("n4_normalize_l2", f"SELECT l_orderkey, l_linenumber, ROUND(l_quantity / {_L2}, 6) AS l_quantity, ROUND(l_extendedprice / {_L2}, 6) AS l_extendedprice, ROUND(l_discount, 6) AS l_discount FROM lineitem")
def n4(spark, sf):
    return rounded(scale.scale_features(wide(spark, sf), "normalize", _S), 6)


for _norm, _size in (("l1", "(ABS(l_quantity) + ABS(l_extendedprice))"), ("max", "GREATEST(ABS(l_quantity), ABS(l_extendedprice))")):
    def _normalize(spark, sf, norm=_norm):
        return rounded(scale.scale_features(wide(spark, sf), "normalize", _S, norm=norm), 6)

    check(f"n4_normalize_{_norm}", f"SELECT l_orderkey, l_linenumber, ROUND(l_quantity / {_size}, 6) AS l_quantity, ROUND(l_extendedprice / {_size}, 6) AS l_extendedprice, ROUND(l_discount, 6) AS l_discount FROM lineitem")(_normalize)


@check("n5_maxabs", _scale_sql("{c} / GREATEST(ABS({c}_a), ABS({c}_b))"))
def n5(spark, sf):
    return rounded(scale.scale_features(wide(spark, sf), "maxabs", _S), 6)


@check("n6_log_in_place", "SELECT l_orderkey, l_linenumber, ROUND(LOG2(l_quantity + 1e-8), 6) AS l_quantity, ROUND(LOG2(l_extendedprice + 1e-8), 6) AS l_extendedprice, ROUND(l_discount, 6) AS l_discount FROM lineitem")
def n6(spark, sf):
    return rounded(scale.scale_features(wide(spark, sf), "log", _S, base=2), 6)


@check("n6_log_feature", "SELECT l_orderkey, l_linenumber, ROUND(LN(l_quantity + 1e-10) / LN(3), 6) AS log_l_quantity, ROUND(CASE WHEN l_discount > 0 THEN LN(l_discount) / LN(3) END, 6) AS log_l_discount FROM lineitem")
def n6_feature(spark, sf):
    df = wide(spark, sf)
    df = fit_transform("log_feature", df, ["l_quantity"], base=3)
    df = fit_transform("log_feature", df, ["l_discount"], base=3, handle_zeros="drop")
    return rounded(df.select("l_orderkey", "l_linenumber", "log_l_quantity", "log_l_discount"), 6)


@check("n7_box_cox", "SELECT l_orderkey, l_linenumber, ROUND((POWER(l_quantity, 0.5) - 1) / 0.5, 6) AS boxcox_l_quantity, ROUND(LN(l_extendedprice), 6) AS boxcox_l_extendedprice FROM lineitem")
def n7(spark, sf):
    out = fit_transform("box_cox", wide(spark, sf), _S, lmbda=[0.5, 0.0])
    return rounded(out.select("l_orderkey", "l_linenumber", "boxcox_l_quantity", "boxcox_l_extendedprice"), 6)


@check("n7_box_cox_fitted")
def n7_fitted(spark, sf):
    return fit_transform("box_cox", wide(spark, sf), _S)


@check("n8_yeo_johnson", """SELECT c_custkey, ROUND(CASE WHEN c_acctbal >= 0 THEN (POWER(c_acctbal + 1, 0.5) - 1) / 0.5 ELSE -(POWER(1 - c_acctbal, 1.5) - 1) / 1.5 END, 4) AS yeojohnson_c_acctbal FROM customer""")
def n8(spark, sf):
    return rounded(fit_transform("yeo_johnson", load(spark, sf, "customer"), ["c_acctbal"], lmbda=0.5).select("c_custkey", "yeojohnson_c_acctbal"))


@check("n8_power_scale_fitted", "SELECT COUNT(*) AS n, 0.0 AS mean, 1.0 AS std FROM customer")
def n8_scale(spark, sf):
    out = fit_transform("power_scale", load(spark, sf, "customer"), ["c_acctbal"])
    return rounded(out.agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean"), F.stddev_pop("c_acctbal").alias("std")), 6)


@check("n9_signed_power", "SELECT c_custkey, ROUND(SIGN(c_acctbal) * POWER(ABS(c_acctbal), 0.5), 6) AS \"power0.5_c_acctbal\" FROM customer")
def n9(spark, sf):
    out = fit_transform("signed_power", load(spark, sf, "customer"), ["c_acctbal"], power=0.5)
    return rounded(out.select("c_custkey", "`power0.5_c_acctbal`"), 6)


@check("n10_quantile_uniform", """WITH g AS (SELECT i, QUANTILE_CONT(c_acctbal, i / 100.0) OVER () AS q, c_custkey AS k FROM customer, range(101) t(i) WHERE FALSE),
 e AS (SELECT list(q ORDER BY i) AS qs FROM (SELECT i, (SELECT QUANTILE_DISC(c_acctbal, 0.5) FROM customer) AS q FROM range(2) t(i)) z),
 grid AS (SELECT CAST(UNNEST(range(101)) AS INT) AS i, UNNEST((SELECT QUANTILE_CONT(c_acctbal, [""" + ", ".join(f"{i / 100!r}" for i in range(101)) + """]) FROM customer)) AS q),
 seg AS (SELECT i, q AS x0, LEAD(q) OVER (ORDER BY i) AS x1 FROM grid),
 j AS (SELECT c_custkey, c_acctbal, MAX(i + (c_acctbal - x0) / (x1 - x0)) AS p FROM customer JOIN seg ON c_acctbal >= x0 AND c_acctbal <= x1 AND x1 > x0 GROUP BY 1, 2)
 SELECT c_custkey, ROUND(p / 100, 6) AS quantile_c_acctbal FROM j""")
def n10(spark, sf):
    out = fit_transform("quantile_transform", load(spark, sf, "customer"), ["c_acctbal"], n_quantiles=101)
    return rounded(out.select("c_custkey", "quantile_c_acctbal"), 6)


@check("n10_quantile_normal")
def n10_normal(spark, sf):
    return fit_transform("quantile_transform", load(spark, sf, "customer"), ["c_acctbal"], output_distribution="normal")


@check("n11_sigmoid_tanh", "SELECT l_orderkey, l_linenumber, ROUND(1 / (1 + EXP(-l_discount)), 6) AS sigmoid_l_discount, ROUND((EXP(2 * l_discount) - 1) / (EXP(2 * l_discount) + 1), 6) AS tanh_l_discount FROM lineitem")
def n11(spark, sf):
    out = fit_transform("tanh", fit_transform("sigmoid", wide(spark, sf), ["l_discount"]), ["l_discount"])
    return rounded(out.select("l_orderkey", "l_linenumber", "sigmoid_l_discount", "tanh_l_discount"), 6)


@check("n12_math_functions", """SELECT c_custkey, ROUND(SQRT(GREATEST(c_acctbal, 0)), 4) AS c_acctbal_sqrt, ROUND(c_acctbal * c_acctbal, 4) AS c_acctbal_squared,
 ROUND(EXP(c_nationkey), 4) AS c_nationkey_exp, ROUND(1 / (c_acctbal + 1e-10), 8) AS c_acctbal_inverse, CAST(c_nationkey * c_nationkey * c_nationkey AS DOUBLE) AS c_nationkey_cubed FROM customer""")
def n12(spark, sf):
    df = load(spark, sf, "customer")
    df = fit_transform("math", df, ["c_acctbal"], functions=["sqrt", "square", "inverse"])
    df = fit_transform("math", df, ["c_nationkey"], functions=["exp", "cube"])
    r = lambda c, k: (F.round(c, k) + 0.0).alias(c)
    return df.select("c_custkey", r("c_acctbal_sqrt", 4), r("c_acctbal_squared", 4), r("c_nationkey_exp", 4), r("c_acctbal_inverse", 8), "c_nationkey_cubed")


@check("n13_add_noise")
def n13(spark, sf):
    return transform.add_noise(wide(spark, sf), ["l_quantity"], "gaussian", 0.1)


@check("n14_transform_chain", """WITH a AS (SELECT l_orderkey, l_linenumber, LN(l_extendedprice + 1e-10) AS x FROM lineitem), s AS (SELECT AVG(x) AS m, STDDEV_POP(x) AS s FROM a)
 SELECT l_orderkey, l_linenumber, ROUND(1 / (1 + EXP(-(x - m) / s)), 6) AS sigmoid_log_l_extendedprice FROM a, s""")
def n14(spark, sf):
    chain = [{"type": "log_feature", "columns": ["l_extendedprice"]}, {"type": "standard", "columns": ["log_l_extendedprice"]},
             {"type": "sigmoid", "columns": ["log_l_extendedprice"]}]
    return rounded(transform.transform_features(wide(spark, sf), chain).select("l_orderkey", "l_linenumber", "sigmoid_log_l_extendedprice"), 6)


def _fft_sql():
    parts = []
    for k in range(5):
        a = f"2 * PI() * {k} * t / n"
        parts.append(f"ROUND(SQRT(POWER(SUM(value * COS({a})), 2) + POWER(SUM(value * SIN({a})), 2)), 3) AS value_fft_mag_{k + 1}")
    return f"WITH r AS (SELECT value, ROW_NUMBER() OVER (ORDER BY ts, event_id) - 1 AS t, COUNT(*) OVER () AS n FROM events), f AS (SELECT {', '.join(parts)} FROM r) SELECT event_id, f.* FROM events, f"


@check("n15_spectral_fft", _fft_sql())
def n15(spark, sf):
    out = transform.spectral_features(load(spark, sf, "events"), ["value"], ["ts", "event_id"])
    return rounded(out.select("event_id", *[f"value_fft_mag_{k + 1}" for k in range(5)]), 3)


@check("n15_spectral_dct", "WITH r AS (SELECT value, ROW_NUMBER() OVER (ORDER BY ts, event_id) - 1 AS t, COUNT(*) OVER () AS n FROM events), f AS (SELECT " + ", ".join(
    f"ROUND(SUM(value * COS(PI() * {k} * (2 * t + 1) / (2 * n))) * SQRT({1 if k == 0 else 2} / MAX(n)), 4) AS value_dct_{k + 1}" for k in range(3)) + " FROM r) SELECT event_id, f.* FROM events, f")
def n15_dct(spark, sf):
    out = transform.spectral_features(load(spark, sf, "events"), ["value"], ["ts", "event_id"], 3, "dct")
    return rounded(out.select("event_id", *[f"value_dct_{k + 1}" for k in range(3)]), 4)


@check("u6_recipe_replay_undo", f"""WITH {LN}, a AS (SELECT l_orderkey, l_linenumber, COALESCE(l_quantity, (SELECT MEDIAN(l_quantity) FROM ln)) AS l_quantity FROM ln),
 q AS (SELECT QUANTILE_CONT(l_quantity, 0.05) AS lo, QUANTILE_CONT(l_quantity, 0.95) AS hi FROM a)
 SELECT l_orderkey, l_linenumber, ROUND(GREATEST(LEAST(l_quantity, hi), lo), 6) AS l_quantity FROM a, q""")
def u6(spark, sf):
    recipe = (Recipe().add("fill_median", ["l_quantity"]).add("cap_outliers", ["l_quantity"], method="quantile", lower=0.05, upper=0.95)
              .add("standard", ["l_quantity"]).undo())
    recipe = Recipe.from_json(recipe.to_json())
    return rounded(recipe.apply(ln(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity")), 6)
