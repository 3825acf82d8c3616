"""Checks of feature creation, ordered features and scalar functions."""

import math

from pyspark.sql import functions as F

from checks.common import LN, check, lineitem_null, load, rounded, union_all
from millrace.functions import scalar
from millrace.operators import create, profile, timefeat
from millrace.plans.spec import fit_transform

_LK = "l_orderkey, l_linenumber"


def wide(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@check("g1_group_aggregates", f"""WITH {LN}, g AS (SELECT l_returnflag AS k, ROUND(AVG(l_extendedprice), 4) AS l_extendedprice_mean, ROUND(MIN(l_extendedprice), 4) AS l_extendedprice_min,
 ROUND(MAX(l_extendedprice), 4) AS l_extendedprice_max, ROUND(STDDEV_SAMP(l_extendedprice), 4) AS l_extendedprice_std, COUNT(l_extendedprice) AS l_extendedprice_count
 FROM ln WHERE l_returnflag IS NOT NULL GROUP BY 1)
 SELECT {_LK}, l_returnflag, l_extendedprice, g.* EXCLUDE k FROM ln LEFT JOIN g ON k = l_returnflag""")
def g1(spark, sf):
    df = lineitem_null(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return rounded(create.group_aggregates(df, ["l_returnflag"], ["l_extendedprice"]))


_EV = "SELECT event_id, user_id, {x} FROM events"
_OVER = "PARTITION BY user_id ORDER BY ts, event_id"


def _frame(w, over=_OVER):
    return f"({over} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def ev(spark, sf):
    return load(spark, sf, "events").select("event_id", "user_id", "ts", "value")


def _roll_sql(over):
    return "SELECT event_id, user_id, ts, value, " + ", ".join(
        f"ROUND({f}(value) OVER {_frame(w, over)}, 4) AS value_{w}_{n}" for w in (3, 7) for n, f in (("mean", "AVG"), ("std", "STDDEV_SAMP"), ("min", "MIN"), ("max", "MAX"))) + " FROM events"


@check("g2_rolling_grouped", _roll_sql(_OVER))
def g2(spark, sf):
    return rounded(timefeat.rolling_features(ev(spark, sf), ["value"], ["ts", "event_id"], (3, 7), partition_by=["user_id"]))


@check("g2_rolling_ungrouped", _roll_sql("ORDER BY ts, event_id"))
def g2_all(spark, sf):
    return rounded(timefeat.rolling_features(ev(spark, sf), ["value"], ["ts", "event_id"], (3, 7)))


@check("g2b_rolling_population", "SELECT event_id, user_id, ts, value, " + ", ".join(
    f"ROUND({e}(value) OVER {_frame(5)}, 6) AS value_window_5_{n}" for n, e in (("std", "STDDEV_POP"), ("var", "VAR_POP"), ("sum", "SUM"), ("median", "MEDIAN"))) +
    f", COUNT(value) OVER {_frame(5)} AS value_window_5_count FROM events")
def g2b(spark, sf):
    return rounded(timefeat.rolling_features(ev(spark, sf), ["value"], ["ts", "event_id"], (5,), ("std", "var", "sum", "median", "count"), ["user_id"], population=True), 6)


@check("g2b_rolling_skew_kurt")
def g2b_shape(spark, sf):
    return timefeat.rolling_features(ev(spark, sf), ["value"], ["ts", "event_id"], (5,), ("skew", "kurt"), ["user_id"], population=True)


@check("g3_lag_grouped", "SELECT event_id, user_id, ts, value, " + ", ".join(f"LAG(value, {k}) OVER ({_OVER}) AS value_lag_{k}" for k in (1, 2, 7)) + " FROM events")
def g3(spark, sf):
    return timefeat.lag_features(ev(spark, sf), ["value"], ["ts", "event_id"], (1, 2, 7), ["user_id"])


@check("g3_lag_text", "SELECT conv_id, turn, role, LAG(role, 1) OVER (PARTITION BY conv_id ORDER BY turn, role) AS role_lag_1 FROM conversations")
def g3_text(spark, sf):
    return timefeat.lag_features(load(spark, sf, "conversations").select("conv_id", "turn", "role"), ["role"], ["turn", "role"], (1,), ["conv_id"])


@check("g4_diff_pct", "SELECT event_id, user_id, ts, value, " + ", ".join(
    f"ROUND(value - LAG(value, {k}) OVER ({_OVER}), 6) AS value_diff_{k}, ROUND(value / NULLIF(LAG(value, {k}) OVER ({_OVER}), 0) - 1, 6) AS value_pct_change_{k}" for k in (1, 3)) + " FROM events")
def g4(spark, sf):
    return rounded(timefeat.diff_features(ev(spark, sf), ["value"], ["ts", "event_id"], (1, 3), ["user_id"]), 6)


@check("g5_trend", f"SELECT event_id, user_id, ts, value, ROUND(CASE WHEN COUNT(value) OVER {_frame(7)} = 7 THEN AVG(value) OVER {_frame(7)} END, 4) AS trend FROM events")
def g5(spark, sf):
    return rounded(timefeat.trend(ev(spark, sf), "value", ["ts", "event_id"], 7, ["user_id"]))


@check("g6_interactions", f"SELECT {_LK}, " + ", ".join(f"ROUND({a} * {b}, 4) AS {a}_x_{b}" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))) +
       ", ROUND(l_extendedprice / (l_quantity + 1e-8), 4) AS l_extendedprice_div_l_quantity FROM lineitem")
def g6(spark, sf):
    df = fit_transform("interactions", wide(spark, sf), ["l_quantity", "l_extendedprice", "l_discount"])
    df = fit_transform("interactions", df, pairs=[["l_extendedprice", "l_quantity"]], interaction_type="ratio")
    return rounded(df.drop("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@check("g7_polynomial", f"""SELECT {_LK}, ROUND(l_quantity * l_quantity, 4) AS "l_quantity^2", ROUND(l_quantity * l_discount, 4) AS "l_quantity l_discount", ROUND(l_discount * l_discount, 4) AS "l_discount^2",
 ROUND(l_quantity * l_quantity * l_quantity, 4) AS "l_quantity^3", ROUND(l_quantity * l_quantity * l_discount, 4) AS "l_quantity^2 l_discount",
 ROUND(l_quantity * l_discount * l_discount, 4) AS "l_quantity l_discount^2", ROUND(l_discount * l_discount * l_discount, 4) AS "l_discount^3" FROM lineitem""")
def g7(spark, sf):
    out = fit_transform("polynomial", wide(spark, sf), ["l_quantity", "l_discount"], degree=3)
    return rounded(out.drop("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@check("g8_ratios", f"SELECT {_LK}, ROUND(l_extendedprice / (l_quantity + 1e-10), 4) AS ratio_unit, ROUND(l_tax / (l_quantity + 1e-10), 6) AS ratio_l_tax_to_l_quantity FROM lineitem")
def g8(spark, sf):
    out = fit_transform("ratios", wide(spark, sf), numerators=["l_extendedprice", "l_tax"], denominators=["l_quantity", "l_quantity"], suffixes=["unit"])
    return out.select("l_orderkey", "l_linenumber", (F.round("ratio_unit", 4) + 0.0).alias("ratio_unit"), (F.round("ratio_l_tax_to_l_quantity", 6) + 0.0).alias("ratio_l_tax_to_l_quantity"))


_TS = "ts"


@check("g9_datetime_features", """SELECT event_id, YEAR(ts) AS ts_year, MONTH(ts) AS ts_month, DAY(ts) AS ts_day, HOUR(ts) AS ts_hour, MINUTE(ts) AS ts_minute, SECOND(ts) AS ts_second,
 ISODOW(ts) - 1 AS ts_weekday, QUARTER(ts) AS ts_quarter, DAYOFYEAR(ts) AS ts_day_of_year, WEEKOFYEAR(ts) AS ts_week_of_year, CAST(ISODOW(ts) >= 6 AS INT) AS ts_is_weekend,
 CAST(DAY(ts) = 1 AS INT) AS ts_is_month_start, CAST(CAST(ts AS DATE) = LAST_DAY(ts) AS INT) AS ts_is_month_end FROM events""")
def g9(spark, sf):
    return fit_transform("datetime_features", load(spark, sf, "events").select("event_id", "ts"), ["ts"], drop_original=True)


_SP = create.SPACE.replace("'", "''")
_WORDS = f"regexp_extract_all(text, '[^{_SP}]+')"


def _text_sql(table, key):
    w = f"len({_WORDS})"
    n = lambda p: f"len(regexp_extract_all(text, '{p}'))"
    return f"""SELECT {key}, length(text) AS text_char_count, {w} AS text_word_count, {n('[.!?]+')} AS text_sentence_count,
 ROUND(CASE WHEN {w} = 0 THEN 0 ELSE length(regexp_replace(text, '[{_SP}]+', '', 'g')) * 1.0 / {w} END, 6) AS text_avg_word_length,
 {n('[^a-zA-Z0-9' + _SP + ']')} AS text_special_char_count, {n('[A-Z]')} AS text_uppercase_count, {n('[a-z]')} AS text_lowercase_count, {n('[0-9]')} AS text_digit_count,
 len(list_distinct(regexp_extract_all(lower(text), '[^{_SP}]+'))) AS text_unique_word_count FROM {table}"""


_TF = ["char_count", "word_count", "sentence_count", "avg_word_length", "special_char_count", "uppercase_count", "lowercase_count", "digit_count", "unique_word_count"]


@check("g10_text_features", _text_sql("documents", "doc_id"))
def g10(spark, sf):
    return rounded(fit_transform("text_features", load(spark, sf, "documents").select("doc_id", "text"), ["text"], features=_TF, drop_original=True), 6)


@check("g10_text_features_turns", _text_sql("conversations", "conv_id, turn"))
def g10_turns(spark, sf):
    return rounded(fit_transform("text_features", load(spark, sf, "conversations").select("conv_id", "turn", "text"), ["text"], features=_TF, drop_original=True), 6)


@check("g11_text_density_punctuation", f"""SELECT doc_id, ROUND(len({_WORDS}) * 1.0 / (length(text) + 1), 6) AS text_word_density,
 len(regexp_extract_all(text, '[.,;:!?()\\[\\]{{}}"'']')) AS text_punctuation_count FROM documents""")
def g11(spark, sf):
    return rounded(fit_transform("text_features", load(spark, sf, "documents").select("doc_id", "text"), ["text"], features=["word_density", "punctuation_count"], drop_original=True), 6)


@check("g11_stopword_count")
def g11_stop(spark, sf):
    return fit_transform("text_features", load(spark, sf, "documents").select("doc_id", "text"), ["text"], features=["stopword_count"], drop_original=True)


@check("g12_text_length", f"SELECT item_id, length(text) AS text_char_length, len({_WORDS}) AS text_word_count FROM benchmark")
def g12(spark, sf):
    return fit_transform("text_features", load(spark, sf, "benchmark"), ["text"], features=["char_length", "word_count"], drop_original=True)


_ED = "e AS (SELECT MIN(l_extendedprice) AS lo, (MAX(l_extendedprice) - MIN(l_extendedprice)) AS w FROM lineitem)"


@check("g13_bins_uniform", f"WITH {_ED} SELECT {_LK}, CAST(" + " + ".join(f"CASE WHEN l_extendedprice >= lo + w * {j} / 5 THEN 1 ELSE 0 END" for j in range(1, 5)) + " AS BIGINT) AS l_extendedprice_bin FROM lineitem, e")
def g13(spark, sf):
    return fit_transform("bins", wide(spark, sf), ["l_extendedprice"], bins=5).select("l_orderkey", "l_linenumber", "l_extendedprice_bin")


_QE = "q AS (SELECT QUANTILE_CONT(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem)"


@check("g13_bins_quantile_one_hot", f"WITH {_QE}, b AS (SELECT {_LK}, CASE WHEN l_extendedprice < q[1] THEN 0 WHEN l_extendedprice < q[2] THEN 1 WHEN l_extendedprice < q[3] THEN 2 ELSE 3 END AS b FROM lineitem, q) SELECT {_LK}, "
       + ", ".join(f"CAST(b = {j} AS DOUBLE) AS l_extendedprice_bin_{j}" for j in range(4)) + " FROM b")
def g13_quantile(spark, sf):
    out = fit_transform("bins", wide(spark, sf), ["l_extendedprice"], bins=4, strategy="quantile", one_hot=True)
    return out.drop("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@check("g13_bins_kmeans")
def g13_kmeans(spark, sf):
    return fit_transform("bins", wide(spark, sf), ["l_extendedprice"], bins=4, strategy="kmeans")


@check("g14_cut", f"SELECT {_LK}, CASE WHEN l_quantity >= 1 AND l_quantity <= 10 THEN 'low' WHEN l_quantity > 10 AND l_quantity <= 30 THEN 'mid' WHEN l_quantity > 30 AND l_quantity <= 50 THEN 'high' END AS l_quantity_bin FROM lineitem")
def g14(spark, sf):
    return fit_transform("cut", wide(spark, sf), ["l_quantity"], edges=[1, 10, 30, 50], labels=["low", "mid", "high"]).select("l_orderkey", "l_linenumber", "l_quantity_bin")


@check("g15_cyclical", "SELECT event_id, ROUND(SIN(2 * PI() * HOUR(ts) / 24), 6) AS ts_hour_sin, ROUND(COS(2 * PI() * HOUR(ts) / 24), 6) AS ts_hour_cos, ROUND(SIN(2 * PI() * MONTH(ts) / 24), 6) AS part_sin, ROUND(COS(2 * PI() * MONTH(ts) / 24), 6) AS part_cos FROM events")
def g15(spark, sf):
    e = load(spark, sf, "events").select("event_id", F.hour("ts").alias("ts_hour"), F.month("ts").alias("part"))
    return rounded(fit_transform("cyclical", e, ["ts_hour", "part"]).drop("ts_hour", "part"), 6)


@check("g16_custom_expression", f"SELECT {_LK}, ROUND(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem")
def g16(spark, sf):
    out = fit_transform("custom", wide(spark, sf), expressions={"charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)"})
    return rounded(out.select("l_orderkey", "l_linenumber", "charge"), 6)


@check("t16_autocorrelation", "WITH m AS (SELECT ROW_NUMBER() OVER (ORDER BY ts, event_id) AS i, value - AVG(value) OVER () AS d FROM events), v AS (SELECT SUM(d * d) AS s FROM m)\n" +
       union_all([f"SELECT {k} AS lag, ROUND(SUM(a.d * b.d) / MAX(s), 6) AS autocorrelation FROM m a JOIN m b ON b.i = a.i - {k}, v" for k in range(1, 6)]))
def t16(spark, sf):
    return rounded(timefeat.autocorrelation(load(spark, sf, "events"), "value", ["ts", "event_id"], 5), 6)


# --- scalar functions and user functions ----------------------------------------------------

@check("x1_valid_json", "SELECT event_id, json_valid(props) AS ok, json_valid(event_type) AS bad FROM events")
def x1(spark, sf):
    return load(spark, sf, "events").select("event_id", scalar.is_valid_json("props").alias("ok"), scalar.is_valid_json("event_type").alias("bad"))


@check("x2_digests", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md FROM documents")
def x2(spark, sf):
    return load(spark, sf, "documents").select("doc_id", scalar.digest("text").alias("sha"), scalar.digest("text", "md5").alias("md"))


@check("x3_base64", "SELECT c_custkey, base64(encode(c_name)) AS enc, c_name AS dec FROM customer")
def x3(spark, sf):
    df = load(spark, sf, "customer").withColumn("enc", scalar.encode_base64("c_name"))
    return df.select("c_custkey", "enc", scalar.decode_base64("enc").alias("dec"))


@check("x4_nested_value", "SELECT event_id, json_extract_string(props, '$.k') AS k, COALESCE(json_extract_string(props, '$.a.b'), 'none') AS ab FROM events")
def x4(spark, sf):
    return load(spark, sf, "events").select("event_id", scalar.nested_value("props", "k").alias("k"), scalar.nested_value("props", "a.b", "none").alias("ab"))


@check("x5_truncate_text", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 77) || '...' ELSE text END AS short FROM documents")
def x5(spark, sf):
    return load(spark, sf, "documents").select("doc_id", scalar.truncate_text("text", 80).alias("short"))


@check("x6_parse_query_string", "SELECT page_id, CAST(page_id AS VARCHAR) AS pid, 'a=b' AS eq, CASE WHEN contains(url, '?id=') THEN regexp_extract(url, '[?]id=([^&]*)', 1) END AS id FROM pages")
def x6(spark, sf):
    join = F.when(F.contains("url", F.lit("?")), "&").otherwise("?")
    url = F.concat("url", join, F.lit("pid="), F.col("page_id").cast("string"), F.lit("&eq=a=b&flag"))
    m = load(spark, sf, "pages").select("page_id", scalar.parse_query_string(url).alias("m"))
    return m.select("page_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("pid", "eq", "id")])


@check("x7_valid_email", "SELECT c_custkey, regexp_matches(CASE WHEN c_custkey % 2 = 0 THEN replace(c_name, '#', '.') || '@mail.example.com' ELSE c_name END, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') AS ok FROM customer")
def x7(spark, sf):
    df = load(spark, sf, "customer").withColumn("m", F.expr("CASE WHEN c_custkey % 2 = 0 THEN replace(c_name, '#', '.') || '@mail.example.com' ELSE c_name END"))
    return df.select("c_custkey", scalar.is_valid_email("m").alias("ok"))


@check("x8_file_extension", "SELECT page_id, lower(regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1), '[^.]\\.([^.]+)$', 1)) AS ext FROM pages")
def x8(spark, sf):
    return load(spark, sf, "pages").select("page_id", scalar.file_extension("url").alias("ext"))


@check("u2_custom_function", "SELECT l_orderkey, l_linenumber, ROUND(l_quantity * l_discount + 1, 6) AS made FROM lineitem")
def u2(spark, sf):
    def made(q, d):
        return q * d + 1

    return rounded(create.custom_function(wide(spark, sf), "made", made, ["l_quantity", "l_discount"]).select("l_orderkey", "l_linenumber", "made"), 6)
