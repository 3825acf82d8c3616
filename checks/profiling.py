"""Checks of schema inference, filters, sampling and profiling."""

from pyspark.sql import functions as F

from checks.common import EN, LN, LO, RG, check, lineitem_null, load, regressed, rounded, union_all
from millrace.operators import filters, profile, schema

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
           "l_returnflag", "l_linestatus", "l_shipdate"]


# --- schema ---------------------------------------------------------------------------------

def mixed_orders(spark, sf):
    """Orders plus text columns that hold numbers and dates."""
    return load(spark, sf, "orders").selectExpr(
        "*", "CAST(o_orderkey AS STRING) AS key_text", "CAST(CAST(o_orderdate AS DATE) AS STRING) AS date_text",
        "CASE WHEN o_orderkey % 10 = 0 THEN 'none' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS mostly_date",
        "CAST(o_orderkey % 1000 / 8.0D AS STRING) AS real_text",
    )


MX = """mx AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS key_text, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date_text,
 CASE WHEN o_orderkey % 10 = 0 THEN 'none' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS mostly_date,
 CAST(o_orderkey % 1000 / 8.0 AS VARCHAR) AS real_text FROM orders)"""
MX_TYPES = {"o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "text", "o_totalprice": "numeric", "o_orderdate": "datetime",
            "o_orderpriority": "text", "key_text": "text", "date_text": "text", "mostly_date": "text", "real_text": "text"}


def _facts_sql(cte, table, types):
    parts = []
    for c, k in types.items():
        text = k == "text"
        parts.append(
            f"SELECT '{c}' AS col, '{k}' AS class, COUNT(*) AS n, COUNT(DISTINCT {c}) AS u, "
            + (f"AVG(length({c})) AS len, AVG(CASE WHEN TRY_CAST({c} AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0 END) AS num, "
               f"AVG(CASE WHEN {c} LIKE '%-%' AND TRY_CAST({c} AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0 END) AS dat, "
               f"MAX(CASE WHEN {c} LIKE '%.%' THEN 1 ELSE 0 END) AS dot" if text else
               "NULL AS len, NULL AS num, NULL AS dat, NULL AS dot") + f" FROM {table}"
        )
    return f"WITH {cte}, facts AS ({union_all(parts)})"


@check("s1_detect_roles", _facts_sql(MX, "mx", MX_TYPES) + """
SELECT col AS "column", CASE WHEN class = 'datetime' THEN 'datetime'
 WHEN class = 'numeric' THEN CASE WHEN u < 20 AND u * 1.0 / n < 0.05 THEN 'categorical' ELSE 'numeric' END
 WHEN u < 20 THEN 'categorical' WHEN class = 'text' AND len > 20 THEN 'text' ELSE 'categorical' END AS role FROM facts""")
def s1(spark, sf):
    return schema.detect_roles(mixed_orders(spark, sf))


@check("s2_detect_roles_with_ids", _facts_sql(MX, "mx", MX_TYPES) + """
SELECT col AS "column", CASE
 WHEN (lower(col) LIKE '%id%' OR lower(col) LIKE '%key%' OR lower(col) LIKE '%code%') AND u > 0.9 * n THEN 'id'
 WHEN class IN ('numeric', 'datetime') THEN class WHEN dat = 1 THEN 'datetime'
 WHEN u < LEAST(20, n * 0.1) THEN 'categorical' WHEN class = 'text' THEN 'text' ELSE 'categorical' END AS role FROM facts""")
def s2(spark, sf):
    return schema.detect_roles_with_ids(mixed_orders(spark, sf))


@check("s3_infer_types", _facts_sql(MX, "mx", MX_TYPES) + """,
inf AS (SELECT *, CASE WHEN class = 'text' AND dat = 1 THEN 'datetime' WHEN class = 'text' AND num = 1 THEN 'numeric' ELSE class END AS i FROM facts)
SELECT col AS "column", CASE WHEN i = 'numeric' AND u <= 20 AND u * 1.0 / n < 0.05 THEN 'category' ELSE i END AS inferred FROM inf""")
def s3(spark, sf):
    return schema.infer_types(mixed_orders(spark, sf))


@check("s3_convert_types", f"""WITH {MX} SELECT o_orderkey, CAST(key_text AS BIGINT) AS key_text, CAST(date_text AS TIMESTAMP) AS date_text,
 mostly_date, CAST(real_text AS DOUBLE) AS real_text FROM mx""")
def s3_convert(spark, sf):
    out = schema.convert_types(mixed_orders(spark, sf).select("o_orderkey", "key_text", "date_text", "mostly_date", "real_text"))
    return out.withColumn("date_text", F.col("date_text").cast("timestamp_ntz"))


@check("s4_parse_datetime_columns", f"""WITH {MX} SELECT o_orderkey, o_orderstatus, CAST(date_text AS TIMESTAMP) AS date_text,
 TRY_CAST(mostly_date AS TIMESTAMP) AS mostly_date, key_text FROM mx""")
def s4(spark, sf):
    out = schema.parse_datetime_columns(mixed_orders(spark, sf).select("o_orderkey", "o_orderstatus", "date_text", "mostly_date", "key_text"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("date_text", "mostly_date")})


@check("s5_suggest_types", _facts_sql(MX, "mx", {c: k for c, k in MX_TYPES.items() if k == "text"}) + """
SELECT col AS "column", CASE WHEN num > 0.8 THEN CASE WHEN dot = 0 THEN 'int' ELSE 'float' END WHEN dat > 0.8 THEN 'datetime'
 WHEN u * 1.0 / n < 0.05 AND u <= 100 THEN 'category' ELSE 'object' END AS suggestion FROM facts""")
def s5(spark, sf):
    return schema.suggest_types(mixed_orders(spark, sf))


_S6_TEXT = union_all([f"SELECT '{c}' AS \"column\" FROM part HAVING COUNT(DISTINCT {c}) <= 20" for c in ("p_name", "p_brand", "p_type")])
_S6_NUM = union_all([
    f"""SELECT '{c}' AS "column" FROM (SELECT {c} AS v, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS t FROM part GROUP BY {c}) q
    HAVING COUNT(*) <= GREATEST(20, MAX(t) * 0.01) AND BOOL_AND(v = FLOOR(v)) AND COUNT(*) FILTER (WHERE n * 1.0 / t >= 0.01) <= 20"""
    for c in ("p_partkey", "p_size", "p_retailprice")])


@check("s6_detect_categorical", f"{_S6_TEXT}\nUNION ALL\n{_S6_NUM}")
def s6(spark, sf):
    return schema.detect_categorical(load(spark, sf, "part"))


@check("s7_clean_column_names", """SELECT n_nationkey AS nation_key, n_name AS name, n_regionkey AS region_no FROM nation""")
def s7(spark, sf):
    return schema.clean_column_names(load(spark, sf, "nation").toDF("Nation Key!", " (Name) ", "region no."))


@check("s9_narrow_types", "SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, ROUND(CAST(CAST(l_discount AS FLOAT) AS DOUBLE), 4) AS l_discount FROM lineitem")
def s9(spark, sf):
    out = schema.narrow_types(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"))
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in ("l_orderkey", "l_linenumber")}))


@check("s10_select_by_type", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def s10(spark, sf):
    from millrace.operators.columns import columns_of_type

    df = load(spark, sf, "lineitem")
    return df.select(*columns_of_type(df, "numeric"))


@check("s11_project_and_drop", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def s11(spark, sf):
    return schema.drop_columns(schema.select_columns(load(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]), ["o_custkey"])


# --- filters --------------------------------------------------------------------------------

@check("f1_apply_filters", """SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 30 AND l_returnflag IN ('A', 'R')
 AND CAST(l_shipdate AS DATE) BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'""")
def f1(spark, sf):
    return filters.apply_filters(load(spark, sf, "lineitem"), ranges={"l_quantity": (10, 30)}, categories={"l_returnflag": ["A", "R"]},
                                 dates={"l_shipdate": ("1994-01-01", "1995-12-31")})


@check("f2_keep_top_categories", """SELECT * FROM part WHERE p_brand IN
 (SELECT p_brand FROM part GROUP BY p_brand ORDER BY COUNT(*) DESC, p_brand LIMIT 10)""")
def f2(spark, sf):
    return filters.keep_top_categories(load(spark, sf, "part"), "p_brand", 10)


@check("f3_head", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
def f3(spark, sf):
    return filters.head(load(spark, sf, "orders"), 20, ["o_orderkey"])


@check("f4_largest", f"WITH {RG} SELECT o_orderkey, ROUND(ABS(y - p), 4) AS absolute_error FROM rg ORDER BY ABS(y - p) DESC, o_orderkey LIMIT 10")
def f4(spark, sf):
    e = regressed(spark, sf).select("o_orderkey", F.abs(F.col("y") - F.col("p")).alias("absolute_error"))
    return rounded(filters.largest(e, 10, "absolute_error", ["o_orderkey"]))


@check("f5_sample_rows")
def f5(spark, sf):
    return filters.sample_rows(load(spark, sf, "orders"), 1000, "o_orderkey", seed=42)


@check("f5_sample_rows_count", "SELECT LEAST(1000, COUNT(*)) AS n FROM orders")
def f5_count(spark, sf):
    return filters.sample_rows(load(spark, sf, "orders"), 1000, "o_orderkey", seed=42).agg(F.count("*").alias("n"))


@check("f6_sample_stratified_quota", """WITH s AS (SELECT c_mktsegment, COUNT(*) AS c, SUM(COUNT(*)) OVER () AS t FROM customer GROUP BY c_mktsegment),
 q AS (SELECT *, c * (LEAST(100, t) * 1.0 / t) AS e FROM s), f AS (SELECT *, FLOOR(e) AS b FROM q),
 g AS (SELECT *, ROW_NUMBER() OVER (ORDER BY b - e, c_mktsegment) AS r, LEAST(100, t) - SUM(b) OVER () AS l FROM f)
 SELECT c_mktsegment, CAST(b + CASE WHEN r <= l THEN 1 ELSE 0 END AS BIGINT) AS n FROM g""")
def f6(spark, sf):
    out = filters.sample_stratified(load(spark, sf, "customer"), 100, "c_custkey", "c_mktsegment")
    return out.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def dup_orders(spark, sf):
    o = load(spark, sf, "orders")
    return filters.concat_tables(o, o.where("o_orderkey % 10 = 0"))


DUP = "dup AS (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0)"


@check("f7_duplicates_summary", f"""WITH {DUP}, g AS (SELECT COUNT(*) AS c FROM dup GROUP BY ALL)
 SELECT CAST(SUM(c) AS BIGINT) AS "rows", CAST(SUM(c - 1) AS BIGINT) AS duplicate_rows, ROUND(SUM(c - 1) * 100.0 / SUM(c), 4) AS duplicate_pct,
 COUNT(*) FILTER (WHERE c > 1) AS duplicate_groups, MAX(c) FILTER (WHERE c > 1) AS max_copies
 FROM (SELECT COUNT(*) AS c FROM dup GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority) g2""".replace(", g AS (SELECT COUNT(*) AS c FROM dup GROUP BY ALL)", ""))
def f7(spark, sf):
    return profile.duplicates_summary(dup_orders(spark, sf))


@check("f7_drop_duplicates", "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem")
def f7_drop(spark, sf):
    return filters.drop_duplicates(load(spark, sf, "lineitem").select("l_orderkey", "l_partkey"))


@check("f8_concat_tables", """SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier
 UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer""")
def f8(spark, sf):
    s = load(spark, sf, "supplier").selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS balance")
    c = load(spark, sf, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_mktsegment AS segment", "c_acctbal AS balance")
    return filters.concat_tables(s, c).select("key", "name", "balance", "segment")


@check("f9_frequency_with_other", """WITH c AS (SELECT p_brand, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS t,
 ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, p_brand) AS r FROM part GROUP BY p_brand)
 SELECT CASE WHEN r <= 19 THEN p_brand ELSE 'Other' END AS category, CAST(SUM(n) AS BIGINT) AS count, ROUND(SUM(n) * 100.0 / MAX(t), 2) AS percentage
 FROM c GROUP BY 1""")
def f9(spark, sf):
    return profile.frequency_with_other(load(spark, sf, "part"), "p_brand", 20)


@check("f10_sort_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def f10(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@check("f13_in_batches", "SELECT batch, COUNT(*) AS n, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM (SELECT o_orderkey, (ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch FROM orders) q GROUP BY batch")
def f13(spark, sf):
    out = filters.in_batches(load(spark, sf, "orders").select("o_orderkey"), 1000, ["o_orderkey"])
    return out.groupBy("batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


# --- profiling ------------------------------------------------------------------------------

_TYPES = {"bigint": 3, "int": 1, "double": 4, "string": 2, "timestamp_ntz": 1}


@check("a1_table_info", f"WITH {LN}, d AS (SELECT DISTINCT * FROM ln)\n" + union_all(
    ["SELECT 'rows' AS measure, '' AS name, COUNT(*) AS value FROM ln", "SELECT 'columns', '', 11", "SELECT 'size', '', COUNT(*) * 11 FROM ln",
     "SELECT 'duplicated_rows', '', (SELECT COUNT(*) FROM ln) - (SELECT COUNT(*) FROM d)"]
    + [f"SELECT 'dtype', '{t}', {n}" for t, n in _TYPES.items()]
    + [f"SELECT 'nulls', '{c}', COUNT(*) - COUNT({c}) FROM ln" for c in LI_COLS]))
def a1(spark, sf):
    return profile.table_info(lineitem_null(spark, sf))


def summary_sql(table, col, label=None, group=None, decimals=4):
    r = lambda e, n: f"ROUND({e}, {decimals}) AS {n}"
    return ", ".join([
        f"COUNT({col}) AS count", r(f"AVG({col})", "mean"), r(f"STDDEV_SAMP({col})", "std"), r(f"MIN({col})", "min"),
        r(f"QUANTILE_CONT({col}, 0.25)", "q1"), r(f"MEDIAN({col})", "median"), r(f"QUANTILE_CONT({col}, 0.75)", "q3"), r(f"MAX({col})", "max"),
        r(f"SKEWNESS({col})", "skew"), r(f"KURTOSIS({col})", "kurtosis")])


@check("a2_numeric_summary", f"WITH {LN}\n" + union_all(
    [f"SELECT '{c}' AS \"column\", {summary_sql('ln', c)}, COUNT(*) - COUNT({c}) AS missing, ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 4) AS missing_pct FROM ln" for c in NUM]))
def a2(spark, sf):
    return rounded(profile.numeric_summary(lineitem_null(spark, sf), NUM))


def _cat_sql(table, c):
    return f"""SELECT '{c}' AS "column", COUNT(DISTINCT {c}) AS unique_values, COUNT(*) - COUNT({c}) AS null_count,
 ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 2) AS null_percentage,
 (SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1) AS mode,
 (SELECT COUNT(*) FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1) AS mode_count,
 ROUND((SELECT COUNT(*) FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1) * 100.0 / COUNT(*), 2) AS mode_pct FROM {table}"""


@check("a3_categorical_summary", f"WITH {LN}\n" + union_all([_cat_sql("ln", c) for c in ("l_returnflag", "l_linestatus")]))
def a3(spark, sf):
    return profile.categorical_summary(lineitem_null(spark, sf))


@check("a4_missing_by_column", f"WITH {LN}\n" + union_all(
    [f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS missing_count, ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 2) AS missing_percentage FROM ln" for c in LI_COLS]))
def a4(spark, sf):
    return profile.missing_by_column(lineitem_null(spark, sf))


_MISS = " + ".join(f"CAST({c} IS NULL AS INT)" for c in LI_COLS)


@check("a4_missing_by_row", f"""WITH {LN}, m AS (SELECT {_MISS} AS k FROM ln)
 SELECT CASE WHEN k = 0 THEN '0' WHEN k = 1 THEN '1' WHEN k <= 5 THEN '2-5' WHEN k <= 10 THEN '6-10' WHEN k <= 20 THEN '11-20' ELSE '>20' END AS missing_columns,
 COUNT(*) AS "rows", ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 2) AS percentage FROM m GROUP BY 1""")
def a4_rows(spark, sf):
    return profile.missing_by_row(lineitem_null(spark, sf))


_A5 = {"l_orderkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_returnflag": "string", "l_shipdate": "timestamp_ntz"}


@check("a5_column_info", f"WITH {LN}\n" + union_all(
    [f"SELECT '{c}' AS \"column\", '{t}' AS type, COUNT({c}) AS non_null, COUNT(*) - COUNT({c}) AS nulls, ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 2) AS null_pct, COUNT(DISTINCT {c}) AS \"unique\" FROM ln" for c, t in _A5.items()]))
def a5(spark, sf):
    return profile.column_info(lineitem_null(spark, sf).select(*_A5))


_N = lambda names: ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in names)


@check("a6_describe_table", f"WITH {LN}\n" + union_all(
    [f"""SELECT '{c}' AS "column", {summary_sql('ln', c, decimals=2)}, ROUND(QUANTILE_CONT({c}, 0.75) - QUANTILE_CONT({c}, 0.25), 2) AS iqr,
 COUNT(*) - COUNT({c}) AS missing, ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 2) AS missing_pct, COUNT(DISTINCT {c}) AS "unique", NULL AS top, NULL AS freq FROM ln""" for c in NUM]
    + [f"""SELECT '{c}', COUNT({c}), {_N(['mean', 'std', 'min', 'q1', 'median', 'q3', 'max', 'skew', 'kurtosis', 'iqr'])},
 COUNT(*) - COUNT({c}), ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 2), COUNT(DISTINCT {c}),
 (SELECT {c} FROM ln WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1),
 (SELECT COUNT(*) FROM ln WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1) FROM ln""" for c in ("l_returnflag", "l_linestatus")]))
def a6(spark, sf):
    return profile.describe_table(lineitem_null(spark, sf), NUM)


@check("a7_histogram", f"""WITH e AS (SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi, (MAX(l_extendedprice) - MIN(l_extendedprice)) / 30 AS w FROM lineitem),
 b AS (SELECT CAST(LEAST(FLOOR((l_extendedprice - lo) / w), 29) AS INT) AS bin, COUNT(*) AS c FROM lineitem, e GROUP BY 1)
 SELECT CAST(i AS INT) AS bin, ROUND(lo + i * w, 4) AS left_edge, ROUND(lo + (i + 1) * w, 4) AS right_edge, COALESCE(c, 0) AS count
 FROM range(30) t(i) CROSS JOIN e LEFT JOIN b ON b.bin = t.i""")
def a7(spark, sf):
    return rounded(profile.histogram(load(spark, sf, "lineitem"), "l_extendedprice", 30))


@check("a7_categorical_distribution", """SELECT o_orderpriority, COUNT(*) AS count, ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 2) AS percentage FROM orders GROUP BY 1""")
def a7_cat(spark, sf):
    return profile.column_distribution(load(spark, sf, "orders"), "o_orderpriority")["table"]


def _group_sql(col):
    r = lambda e, n: f"ROUND({e}, 4) AS {n}"
    return ", ".join([f"COUNT({col}) AS count", r(f"AVG({col})", "mean"), r(f"STDDEV_SAMP({col})", "std"), r(f"MIN({col})", "min"), r(f"MAX({col})", "max"),
                      r(f"QUANTILE_CONT({col}, 0.25)", "q1"), r(f"MEDIAN({col})", "median"), r(f"QUANTILE_CONT({col}, 0.75)", "q3"),
                      r(f"SKEWNESS({col})", "skew"), r(f"KURTOSIS({col})", "kurtosis")])


@check("a8_group_summary", f"WITH {LN} SELECT l_returnflag, {_group_sql('l_extendedprice')} FROM ln WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag")
def a8(spark, sf):
    return rounded(profile.group_summary(lineitem_null(spark, sf), "l_extendedprice", "l_returnflag"))


@check("a9_bar_aggregation", "SELECT o_custkey, ROUND(AVG(o_totalprice), 6) AS value FROM orders GROUP BY o_custkey ORDER BY AVG(o_totalprice) DESC, o_custkey LIMIT 15")
def a9(spark, sf):
    return rounded(profile.aggregate_by(load(spark, sf, "orders"), "o_custkey", "o_totalprice", "mean", 15), 6)


@check("a10_value_shares", "SELECT p_brand, COUNT(*) AS count, ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 2) AS percentage FROM part GROUP BY p_brand ORDER BY 2 DESC, 1 LIMIT 15")
def a10(spark, sf):
    return profile.value_shares(load(spark, sf, "part"), "p_brand", 15)


@check("a11_line_aggregation", "SELECT l_linenumber, ROUND(SUM(l_quantity), 4) AS value FROM lineitem GROUP BY l_linenumber ORDER BY l_linenumber")
def a11(spark, sf):
    return rounded(profile.line_by(load(spark, sf, "lineitem"), "l_linenumber", "l_quantity", "sum"))


_ST = ["F", "O", "P"]


@check("a12_crosstab", "SELECT o_orderpriority, " + ", ".join(f"ROUND(COUNT(*) FILTER (WHERE o_orderstatus = '{s}') * 1.0 / COUNT(*), 4) AS \"{s}\"" for s in _ST)
       + " FROM orders GROUP BY o_orderpriority")
def a12(spark, sf):
    return rounded(profile.crosstab(load(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", normalize=True))


@check("a13_pivot_mean", "SELECT o_orderpriority, " + ", ".join(f"ROUND(AVG(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 6) AS \"{s}\"" for s in _ST)
       + " FROM orders GROUP BY o_orderpriority")
def a13(spark, sf):
    return rounded(profile.pivot_mean(load(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice"), 6)


def _resample_sql(unit, step, label, agg, fill=False):
    v = f"ROUND({agg}, 6)"
    return f"""WITH g AS (SELECT CAST(date_trunc('{unit}', ts) AS DATE) AS st, {v} AS value FROM events GROUP BY 1),
 cal AS (SELECT CAST(unnest(generate_series(MIN(st), MAX(st), INTERVAL '{step}')) AS DATE) AS st FROM g)
 SELECT {label} AS period, {"COALESCE(value, 0)" if fill else "value"} AS value FROM cal LEFT JOIN g USING (st)"""


_PER = {"d": ("day", "1 day", "st"), "w": ("week", "7 days", "CAST(st + INTERVAL 6 DAY AS DATE)"), "m": ("month", "1 month", "last_day(st)"),
        "q": ("quarter", "3 months", "last_day(CAST(st + INTERVAL 2 MONTH AS DATE))"), "y": ("year", "1 year", "last_day(CAST(st + INTERVAL 11 MONTH AS DATE))")}
for _f, _how, _agg, _fill in (("d", "mean", "AVG(value)", False), ("w", "sum", "SUM(value)", True), ("m", "max", "MAX(value)", False),
                              ("q", "min", "MIN(value)", False), ("y", "count", "COUNT(value)", True)):
    def _run(spark, sf, f=_f, how=_how):
        return rounded(profile.resample(load(spark, sf, "events"), "ts", "value", f.upper(), how), 6)

    _sql = _resample_sql(*_PER[_f], _agg, _fill)
    check(f"a14_resample_{_f}", _sql.replace("ROUND(COUNT(value), 6)", "COUNT(value)"))(_run)


@check("a15_class_balance", """WITH c AS (SELECT o_orderstatus, COUNT(*) AS count FROM orders GROUP BY 1)
 SELECT o_orderstatus, count, ROUND(count * 100.0 / SUM(count) OVER (), 2) AS percentage, ROUND(MAX(count) OVER () * 1.0 / MIN(count) OVER (), 6) AS imbalance_ratio,
 MAX(count) OVER () * 1.0 / MIN(count) OVER () > 10 AS imbalanced, MIN(count) OVER () * 1.0 / MAX(count) OVER () < 0.2 AS minority_below_20pct FROM c""")
def a15(spark, sf):
    return profile.class_balance(load(spark, sf, "orders"), "o_orderstatus")


@check("a16_residual_statistics", f"WITH {RG}, e AS (SELECT y - p AS residual, ABS(y - p) AS absolute_error, (y - p) * (y - p) AS squared_error FROM rg)\n" + union_all(
    [f"""SELECT '{c}' AS series, COUNT({c}) AS count, ROUND(AVG({c}), 2) AS mean, ROUND(MEDIAN({c}), 2) AS median, ROUND(STDDEV_SAMP({c}), 2) AS std,
 ROUND(MIN({c}), 2) AS min, ROUND(MAX({c}), 2) AS max, ROUND(SKEWNESS({c}), 2) AS skew, ROUND(KURTOSIS({c}), 2) AS kurtosis FROM e""" for c in ("residual", "absolute_error", "squared_error")]))
def a16(spark, sf):
    return rounded(profile.residual_statistics(regressed(spark, sf), "y", "p"), 2)


@check("a17_cluster_profile", """SELECT l_linenumber, COUNT(*) AS size, ROUND(AVG(l_quantity), 4) AS l_quantity_mean, ROUND(STDDEV_SAMP(l_quantity), 4) AS l_quantity_std,
 ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 2) AS percentage FROM lineitem GROUP BY l_linenumber""")
def a17(spark, sf):
    return rounded(profile.cluster_profile(load(spark, sf, "lineitem"), "l_linenumber", ["l_quantity"]))


@check("a18_most_common_duplicates", """SELECT l_orderkey, l_linenumber, COUNT(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1
 ORDER BY 3 DESC, 1, 2 LIMIT 5""")
def a18(spark, sf):
    return profile.most_common_duplicates(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], 5)
