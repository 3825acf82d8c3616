"""Schema inference: column roles, type suggestions, date parsing, name cleaning, narrowing.

Every rule reads one row of facts per column, gathered in one aggregate over the whole table.
"""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.columns import datetime_columns, numeric_columns, replace_columns, string_columns
from millrace.plans.distinct import settled_counts, sketched
from millrace.plans.quantiles import melt, number

# Name parts that mark identifiers, and date shapes looked for in text columns.
ID_NAME_PARTS = ("id", "identifier", "key", "code")
DATE_SHAPES = (r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}", r"\d{4}/\d{2}/\d{2}")
DATE_FORMATS = ("MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd")


def to_datetime(c):
    """Text to timestamp in any supported shape; NULL where it is none (bare numbers are none)."""
    c = F.col(c) if isinstance(c, str) else c
    parsed = F.coalesce(F.try_to_timestamp(c), *[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])
    return F.when(c.rlike("[-/:]"), parsed)


# The numbers of distinct values, and shares of the rows, at which a rule turns.
COUNT_LIMITS, SHARE_LIMITS = (20, 100), (0.05, 0.1, 0.9)


def column_facts(df: DataFrame, parse=True, counts=(), shares=()):
    """One row per column: class, rows, nonnull, uniques, mean text length, shares of parsable text.

    ``parse=False`` leaves out the shares that need every text to be parsed. ``uniques`` is an estimate from a
    sketch of the same pass, and exact near the limits of the rules (those above, ``counts`` and ``shares``).
    """
    num, txt, dat = numeric_columns(df), string_columns(df), datetime_columns(df)
    aggs = [F.count("*").alias("_rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count(c).alias(f"n{i}"))
        if c in txt:
            t = F.col(c)
            aggs.append(F.avg(F.length(t)).alias(f"len{i}"))
        if c in txt and parse:
            aggs += [
                F.avg(F.when(t.isNotNull(), F.expr(f"try_cast(trim(`{c}`) as double)").isNotNull().cast("double"))).alias(f"num{i}"),
                F.avg(F.when(t.isNotNull(), to_datetime(c).isNotNull().cast("double"))).alias(f"dat{i}"),
                F.max(F.when(F.contains(t, F.lit(".")), 1).otherwise(0)).alias(f"dot{i}"),
                *[F.avg(F.when(t.isNotNull(), t.rlike(s).cast("double"))).alias(f"shape{j}_{i}") for j, s in enumerate(DATE_SHAPES)],
            ]
        elif c in num:
            v = number(c)
            aggs.append(F.min((v == F.floor(v)).cast("int")).alias(f"whole{i}"))
    items = []
    for i, c in enumerate(df.columns):
        text = c in txt
        null = lambda kind: F.lit(None).cast(kind)
        items.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit("numeric" if c in num else "text" if text else "datetime" if c in dat else "other").alias("class"),
                F.col("_rows").alias("rows"), F.col(f"n{i}").alias("non_null"),
                (F.col(f"len{i}") if text else null("double")).alias("mean_length"),
                (F.col(f"num{i}") if text and parse else null("double")).alias("numeric_share"),
                (F.col(f"dat{i}") if text and parse else null("double")).alias("datetime_share"),
                (F.col(f"dot{i}") if text and parse else null("int")).alias("has_dot"),
                (F.greatest(*[F.col(f"shape{j}_{i}") for j in range(len(DATE_SHAPES))]) if text and parse else null("double")).alias("date_shape_share"),
                (F.col(f"whole{i}") if c in num else null("int")).alias("whole"),
            )
        )
    aggs += [sketched(c).alias(f"d{i}") for i, c in enumerate(df.columns)]
    found = df.agg(*aggs)
    first = found.select("_rows", *[f"d{i}" for i in range(len(df.columns))], F.array(*items).alias("_items")).first()
    limits = [*COUNT_LIMITS, *[share * first["_rows"] for share in (*SHARE_LIMITS, *shares)], *counts]
    uniques = settled_counts(df, {c: first[f"d{i}"] for i, c in enumerate(df.columns)}, limits)
    rows = [(*r, uniques[r["column"]]) for r in first["_items"]]
    return df.sparkSession.createDataFrame(rows, found.select(F.inline(F.array(*items))).schema.add("uniques", "long"))


def detect_roles(df: DataFrame):
    """column -> numeric / categorical / datetime / text."""
    few = F.col("uniques") < 20
    role = (
        F.when(F.col("class") == "datetime", "datetime")
        .when(F.col("class") == "numeric", F.when(few & (F.col("uniques") / F.col("rows") < 0.05), "categorical").otherwise("numeric"))
        .when(few, "categorical")
        .when((F.col("class") == "text") & (F.col("mean_length") > 20), "text")
        .otherwise("categorical")
    )
    return column_facts(df, parse=False).select("column", role.alias("role"))


def detect_roles_with_ids(df: DataFrame):
    """column -> id / numeric / datetime / categorical / text, names and uniqueness marking ids."""
    named = F.lit(False)
    for part in ID_NAME_PARTS:
        named = named | F.contains(F.lower("column"), F.lit(part))
    role = (
        F.when(named & (F.col("uniques") > F.col("rows") * 0.9), "id")
        .when(F.col("class").isin("numeric", "datetime"), F.col("class"))
        .when((F.col("class") == "text") & (F.col("datetime_share") == 1), "datetime")
        .when(F.col("uniques") < F.least(F.lit(20), F.col("rows") * 0.1), "categorical")
        .when(F.col("class") == "text", "text")
        .otherwise("categorical")
    )
    return column_facts(df).select("column", role.alias("role"))


def infer_types(df: DataFrame):
    """column -> inferred type: text that always parses becomes datetime or numeric; few values, category."""
    c = F.col
    inferred = (
        F.when((c("class") == "text") & (c("datetime_share") == 1), "datetime")
        .when((c("class") == "text") & (c("numeric_share") == 1), "numeric")
        .otherwise(c("class"))
    )
    out = column_facts(df).withColumn("inferred", inferred)
    few = (c("uniques") <= 20) & (c("uniques") / c("rows") < 0.05)
    return out.select("column", F.when((c("inferred") == "numeric") & few, "category").otherwise(c("inferred")).alias("inferred"))


def convert_types(df: DataFrame):
    """Apply the all-or-nothing conversions of ``infer_types`` to the text columns."""
    facts = {r["column"]: r for r in column_facts(df.select(*string_columns(df))).collect()} if string_columns(df) else {}
    new = {}
    for c, f in facts.items():
        if f["datetime_share"] == 1:
            new[c] = to_datetime(c)
        elif f["numeric_share"] == 1:
            new[c] = F.expr(f"try_cast(trim(`{c}`) as {'double' if f['has_dot'] else 'bigint'})")
    return replace_columns(df, new)


def parse_datetime_columns(df: DataFrame, share=0.8):
    """Text columns of which more than ``share`` look like dates become timestamps (NULL otherwise)."""
    texts = string_columns(df)
    if not texts:
        return df
    facts = column_facts(df.select(*texts)).where(F.col("date_shape_share") > share).select("column").collect()
    return replace_columns(df, {r[0]: to_datetime(r[0]) for r in facts})


def suggest_types(df: DataFrame):
    """Text column -> int / float / datetime / category / object, from the shares of parsable values."""
    c = F.col
    suggestion = (
        F.when(c("numeric_share") > 0.8, F.when(c("has_dot") == 0, "int").otherwise("float"))
        .when(c("datetime_share") > 0.8, "datetime")
        .when((c("uniques") / c("rows") < 0.05) & (c("uniques") <= 100), "category")
        .otherwise("object")
    )
    return column_facts(df.select(*string_columns(df))).select("column", suggestion.alias("suggestion"))


def detect_categorical(df: DataFrame, max_unique=20, min_freq=0.01):
    """Columns that are likely categorical (one column ``column``)."""
    facts = column_facts(df, parse=False, counts=[max_unique], shares=[min_freq])
    ok = F.col("uniques") <= F.greatest(F.lit(float(max_unique)), F.col("rows") * min_freq)
    text = facts.where(ok & (F.col("class") == "text") & (F.col("uniques") <= max_unique)).select("column")
    nums = [c for c in numeric_columns(df)]
    if not nums:
        return text
    counts = melt(df, nums).groupBy("_column", "_value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("_column").agg(F.sum("n").alias("t"))
    frequent = counts.join(totals, "_column").groupBy(F.col("_column").alias("column")).agg(
        F.count_if(F.col("n") / F.col("t") >= min_freq).alias("frequent")
    )
    whole = facts.where(ok & (F.col("class") == "numeric") & (F.col("whole") == 1)).join(frequent, "column")
    return text.unionByName(whole.where(F.col("frequent") <= max_unique).select("column"))


def clean_column_names(df: DataFrame):
    names = [re.sub(r"[^\w\s]", "", c).strip().lower().replace(" ", "_") for c in df.columns]
    clash = {n for n in names if names.count(n) > 1}
    if clash:
        raise ValueError(f"cleaned names collide: {sorted(clash)}")
    return df.toDF(*names)


_INTS = [("tinyint", 8, T.ByteType), ("smallint", 16, T.ShortType), ("int", 32, T.IntegerType)]


def narrow_types(df: DataFrame):
    """Cast integer and double columns to the smallest type that holds their range."""
    whole = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]
    real = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    if not whole + real:
        return df
    row = df.agg(*[f(c).alias(f"{t}{i}") for i, c in enumerate(whole + real) for t, f in (("a", F.min), ("b", F.max))]).first()
    new = {}
    for i, c in enumerate(whole + real):
        lo, hi = row[f"a{i}"], row[f"b{i}"]
        if lo is None:
            continue
        if c in whole:
            fit = next((name for name, bits, _ in _INTS if -(2 ** (bits - 1)) <= lo and hi < 2 ** (bits - 1)), "bigint")
            new[c] = F.col(c).cast(fit)
        elif abs(lo) < 3.4e38 and abs(hi) < 3.4e38:
            new[c] = F.col(c).cast("float")
    return replace_columns(df, new)


def select_columns(df: DataFrame, columns):
    return df.select(*columns)


def drop_columns(df: DataFrame, columns):
    return df.drop(*columns)
