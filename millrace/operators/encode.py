"""Categorical encoders. Learned maps are small tables that are joined back to the data."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.columns import string_columns
from millrace.plans.lookup import attach
from millrace.plans.ordered import number_rows
from millrace.plans.sizing import LOCAL_TABLE_ROWS, freeze
from millrace.plans.spec import fit_transform, step


def _remember(table: DataFrame):
    """JSON-able form of a learned map: its rows while they are few, else the path of a table."""
    rows = table.limit(LOCAL_TABLE_ROWS + 1).collect()
    if len(rows) <= LOCAL_TABLE_ROWS:
        return {"ddl": _ddl(table), "rows": [list(r) for r in rows]}
    from millrace.plans.sizing import scratch_path

    path = scratch_path(table.sparkSession, "codes")
    freeze(table, path=path)
    return {"ddl": _ddl(table), "path": path}


def _ddl(table):
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)


def _recall(spark, learned):
    import pandas as pd

    if "path" in learned:
        return spark.read.schema(learned["ddl"]).parquet(learned["path"])
    names = spark.createDataFrame([], learned["ddl"]).schema.names
    frame = pd.DataFrame({n: pd.Series([r[i] for r in learned["rows"]], dtype=object) for i, n in enumerate(names)})
    return spark.createDataFrame(frame, learned["ddl"])


def text(c):
    """Category as text; a missing value is the category 'nan'."""
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


def category_counts(df, c):
    return df.groupBy(text(c).alias("_key")).agg(F.count("*").alias("_n"))


def category_codes(df, c, start=0):
    """Alphabetical codes of the categories of one column."""
    coded = number_rows(category_counts(df, c), ["_key"], name="_code")
    return coded.select("_key", "_n", (F.col("_code") - 1 + start).alias("_code"))


def _cols(df, columns):
    return list(columns or string_columns(df))


def _join_map(df, c, table, value, unseen=None):
    out = attach(df.withColumn("_key", text(c)), table, ["_key"], [value], weight="_n").drop("_key")
    return out if unseen is None else out.withColumn(value, F.coalesce(F.col(value), F.lit(unseen)))


def _fit_one_hot(df, columns, drop_first=False, max_categories=1000):
    cats = {}
    for c in _cols(df, columns):
        rows = df.select(F.col(c).cast("string")).distinct().limit(max_categories + 1).collect()
        if len(rows) > max_categories:
            raise ValueError(f"{c} has more than {max_categories} categories; use one_hot_vector")
        known = sorted(r[0] for r in rows if r[0] is not None)
        known += [None] if any(r[0] is None for r in rows) else []
        cats[c] = known[1:] if drop_first else known
    return {"categories": cats}


@step("one_hot", _fit_one_hot)
def one_hot(df, learned):
    """0/1 column per category, named column_value; missing is a category of its own."""
    cats = learned["categories"]
    new = [
        F.col(c).cast("string").eqNullSafe(F.lit(v)).cast("double").alias(f"{c}_{'nan' if v is None else v}")
        for c, values in cats.items() for v in values
    ]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in cats], *new)


def one_hot_vector(df: DataFrame, columns):
    """Sparse one-hot vectors for columns with very many categories."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    cols = list(columns)
    indexer = StringIndexer(inputCols=cols, outputCols=[f"{c}_index" for c in cols], stringOrderType="alphabetAsc", handleInvalid="keep")
    encoder = OneHotEncoder(inputCols=[f"{c}_index" for c in cols], outputCols=[f"{c}_vector" for c in cols], dropLast=False)
    return Pipeline(stages=[indexer, encoder]).fit(df).transform(df).drop(*[f"{c}_index" for c in cols])


def _fit_codes(df, columns, start=0):
    return {"maps": {c: _remember(category_codes(df, c, start)) for c in _cols(df, columns)}}


@step("label", _fit_codes)
def label_encode(df, learned):
    """Alphabetical integer codes from 0, in place."""
    order = df.columns
    for c, m in learned["maps"].items():
        df = _join_map(df, c, _recall(df.sparkSession, m), "_code").withColumn(c, F.col("_code")).drop("_code")
    return df.select(*order)


def _fit_ordinal(df, columns, categories=None):
    categories = categories or {}
    auto = [c for c in _cols(df, columns) if c not in categories]
    return {"given": {c: categories[c] for c in _cols(df, columns) if c in categories}, "maps": _fit_codes(df, auto)["maps"] if auto else {}}


@step("ordinal", _fit_ordinal)
def ordinal_encode(df, learned):
    """Codes in the given category order (unlisted values NULL), else alphabetical; doubles."""
    order = df.columns
    if learned["maps"]:
        df = label_encode(df, learned)
    given = learned["given"]
    out = []
    for c in order:
        if c in given:
            e = F.lit(None).cast("double")
            for i, v in reversed(list(enumerate(given[c]))):
                e = F.when(F.col(c) == v, F.lit(float(i))).otherwise(e)
            out.append(e.alias(c))
        elif c in learned["maps"]:
            out.append(F.col(c).cast("double").alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def _fit_target(df, columns, target=None, min_samples=20, smoothing=10.0):
    y = F.col(target).cast("double")
    prior = df.agg(F.avg(y)).first()[0]
    maps = {}
    for c in _cols(df, columns):
        weight = 1.0 / (1.0 + F.exp(-(F.col("_n") - F.lit(min_samples)) / F.lit(smoothing)))
        stats = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("_key")).agg(F.count("*").alias("_n"), F.avg(y).alias("_m"))
        maps[c] = _remember(stats.select("_key", "_n", (F.lit(prior) * (1 - weight) + F.col("_m") * weight).alias("_code")))
    return {"maps": maps, "prior": prior}


@step("target", _fit_target)
def target_encode(df, learned):
    """Smoothed target mean per category; unseen and missing categories take the overall mean."""
    order = df.columns
    for c, m in learned["maps"].items():
        table = _recall(df.sparkSession, m)
        out = attach(df.withColumn("_key", F.col(c).cast("string")), table, ["_key"], ["_code"], weight="_n")
        df = out.withColumn(c, F.coalesce(F.col("_code"), F.lit(learned["prior"]))).drop("_key", "_code")
    return df.select(*order)


def _fit_binary(df, columns):
    maps, widths = {}, {}
    for c in _cols(df, columns):
        codes = category_codes(df, c, 1)
        maps[c] = _remember(codes)
        widths[c] = max(1, int(codes.count()).bit_length())
    return {"maps": maps, "widths": widths}


@step("binary", _fit_binary)
def binary_encode(df, learned):
    """Base-2 digits of the alphabetical code (from 1), most significant first."""
    for c, m in learned["maps"].items():
        w = learned["widths"][c]
        df = _join_map(df, c, _recall(df.sparkSession, m), "_code", 0)
        digits = {f"{c}_{i}": F.shiftright("_code", w - 1 - i).bitwiseAND(F.lit(1)).cast("int") for i in range(w)}
        df = df.withColumns(digits).drop("_code", c)
    return df


def _fit_frequency(df, columns):
    maps = {}
    for c in _cols(df, columns):
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("_key")).agg(F.count("*").alias("_n"))
        total = counts.agg(F.sum("_n")).first()[0] or 1
        maps[c] = _remember(counts.withColumn("_code", F.col("_n") / F.lit(total)))
    return {"maps": maps}


@step("frequency", _fit_frequency)
def frequency_encode(df, learned):
    """Relative frequency among the non-missing values; missing stays NULL."""
    order = df.columns
    for c, m in learned["maps"].items():
        out = attach(df.withColumn("_key", F.col(c).cast("string")), _recall(df.sparkSession, m), ["_key"], ["_code"], weight="_n")
        df = out.withColumn(c, F.when(F.col(c).isNotNull(), F.col("_code"))).drop("_key", "_code")
    return df.select(*order)


def hash_encode(df: DataFrame, columns, features=1024, output="hashed"):
    from pyspark.ml.feature import FeatureHasher

    return FeatureHasher(inputCols=list(columns), outputCol=output, numFeatures=features).transform(df)


def encode_features(df: DataFrame, method, columns=None, **params):
    if method == "hash":
        return hash_encode(df, _cols(df, columns), **params)
    return fit_transform(method, df, columns, **params)
