"""Profiling: table info, summaries, missing analysis, distributions, groupings, resampling."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.columns import numeric_columns, numeric_or, string_columns
from millrace.operators.moments import kurt, skew
from millrace.plans.distinct import distinct_counts
from millrace.plans.quantiles import exact_quantiles, is_compact, melt, number
from millrace.plans.sizing import keep

STAT_NAMES = ["count", "mean", "std", "min", "q1", "median", "q3", "max", "skew", "kurtosis", "missing", "missing_pct"]


def _single(df, aggs):
    """Run one aggregate over the table and return its row as a dict."""
    return df.agg(*aggs).first().asDict()


def null_counts(df: DataFrame):
    """One pass: null count of every column and the number of rows."""
    row = _single(df, [F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in df.columns]])
    return row["_rows"], {c: row["_rows"] - row[c] for c in df.columns}


def duplicate_groups(df: DataFrame, subset=None):
    """Groups of equal rows with their size; NULLs compare equal."""
    keys = list(subset or df.columns)
    return df.groupBy(*keys).agg(F.count("*").alias("copies"))


def duplicates_summary(df: DataFrame, subset=None):
    groups = duplicate_groups(df, subset)
    extra = F.col("copies") - 1
    dup = F.when(F.col("copies") > 1, F.lit(1))
    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(extra), F.lit(0)).alias("duplicate_rows"),
        F.round(F.try_divide(F.sum(extra) * 100.0, F.sum("copies")), 4).alias("duplicate_pct"),
        F.count(dup).alias("duplicate_groups"),
        F.coalesce(F.max(F.when(F.col("copies") > 1, F.col("copies"))), F.lit(0)).alias("max_copies"),
    )


def most_common_duplicates(df: DataFrame, subset, k=5):
    return duplicate_groups(df, subset).where("copies > 1").orderBy(F.desc("copies"), *subset).limit(k)


def table_info(df: DataFrame):
    """Long table (measure, name, value): shape, size, type counts, nulls, duplicated rows."""
    types = {}
    for f in df.schema:
        types[f.dataType.simpleString()] = types.get(f.dataType.simpleString(), 0) + 1
    width = len(df.columns)
    dup = duplicates_summary(df).select(F.col("duplicate_rows").alias("value"))
    counted = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(f"_{i}") for i, c in enumerate(df.columns)])
    item = lambda measure, name, value: F.struct(
        F.lit(measure).alias("measure"), F.lit(name).alias("name"), value.cast("long").alias("value")
    )
    rows = [item("rows", "", F.col("_rows")), item("columns", "", F.lit(width)), item("size", "", F.col("_rows") * width)]
    rows += [item("dtype", t, F.lit(n)) for t, n in types.items()]
    rows += [item("nulls", c, F.col("_rows") - F.col(f"_{i}")) for i, c in enumerate(df.columns)]
    info = counted.select(F.inline(F.array(*rows)))
    return info.unionByName(
        dup.select(F.lit("duplicated_rows").alias("measure"), F.lit("").alias("name"), F.col("value").cast("long"))
    )


def column_info(df: DataFrame):
    """Type, non-null, null, null % and distinct count of every column."""
    rows, nulls = null_counts(df)
    unique = distinct_counts(df, df.columns)
    facts = [(f.name, f.dataType.simpleString(), rows - nulls[f.name], nulls[f.name], unique[f.name]) for f in df.schema]
    out = df.sparkSession.createDataFrame(facts, "column string, type string, non_null long, nulls long, unique long")
    share = F.round(F.try_divide(F.col("nulls") * 100.0, F.lit(rows)), 2)
    return out.select("column", "type", "non_null", "nulls", share.alias("null_pct"), "unique")


def _moments(c, tag):
    v = number(c)
    return [
        F.count(v).alias(f"count{tag}"), F.avg(v).alias(f"mean{tag}"), F.stddev(v).alias(f"std{tag}"),
        F.min(v).alias(f"min{tag}"), F.max(v).alias(f"max{tag}"), skew(v).alias(f"skew{tag}"), kurt(v).alias(f"kurtosis{tag}"),
    ]


def numeric_summary(df: DataFrame, columns=None):
    """One row per numeric column: describe plus skew, kurtosis, median, missing, missing_pct."""
    cols = numeric_or(df, columns)
    aggs = [F.count("*").alias("_rows")]
    for i, c in enumerate(cols):
        aggs += _moments(c, f"_{i}")
    if is_compact(df.select(*cols)):
        # Compact input: the exact percentiles join the same single pass.
        quantile_aggs = [
            F.percentile(number(c), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{i}") for i, c in enumerate(cols)
        ]
        wide = df.agg(*aggs, *quantile_aggs)
    else:
        q = exact_quantiles(df, cols, [0.25, 0.5, 0.75]).toDF(*[f"q_{i}" for i in range(len(cols))])
        wide = df.agg(*aggs).withColumn("_one", F.lit(1)).join(q.withColumn("_one", F.lit(1)), "_one")
    rows = []
    for i, c in enumerate(cols):
        missing = F.col("_rows") - F.col(f"count_{i}")
        rows.append(
            F.struct(
                F.lit(c).alias("column"), F.col(f"count_{i}").alias("count"),
                *[F.col(f"{s}_{i}").alias(s) for s in ("mean", "std", "min")],
                F.get(F.col(f"q_{i}"), 0).alias("q1"), F.get(F.col(f"q_{i}"), 1).alias("median"), F.get(F.col(f"q_{i}"), 2).alias("q3"),
                *[F.col(f"{s}_{i}").alias(s) for s in ("max", "skew", "kurtosis")],
                missing.alias("missing"), (missing * 100.0 / F.col("_rows")).alias("missing_pct"),
            )
        )
    return wide.select(F.inline(F.array(*rows)))


def value_counts(df: DataFrame, column):
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))


def value_shares(df: DataFrame, column, k=None, decimals=2):
    """Counts and percentage of the non-missing rows, most frequent first."""
    counts = value_counts(df, column)
    total = counts.agg(F.sum("count")).first()[0] or 0
    out = counts.withColumn("percentage", F.round(F.col("count") * 100.0 / F.lit(total), decimals))
    return out.orderBy(F.desc("count"), column).limit(k) if k else out


def frequency_with_other(df: DataFrame, column, max_categories=20):
    """Frequency table with everything below the top ``max_categories - 1`` folded into 'Other'."""
    counts = value_counts(df, column)
    ends = counts.agg(F.count("*").alias("k"), F.sum("count").alias("n")).first()
    n = df.count()
    pct = lambda c: F.round(c * 100.0 / F.lit(n), 2)
    named = counts.select(F.col(column).cast("string").alias("category"), "count")
    if ends["k"] <= max_categories:
        return named.withColumn("percentage", pct(F.col("count")))
    top = named.orderBy(F.desc("count"), "category").limit(max_categories - 1)
    rest = top.agg(F.sum("count").alias("t")).select(
        F.lit("Other").alias("category"), (F.lit(ends["n"]) - F.col("t")).alias("count")
    )
    return top.unionByName(rest).withColumn("percentage", pct(F.col("count")))


def column_modes(df: DataFrame, columns):
    """Most frequent value per column (ties: smallest), counted by value before anything is compared.

    The value is returned as text and, for numeric columns, ranked as a number.
    """
    parts = []
    numeric = [c for c in columns if c in numeric_columns(df)]
    other = [c for c in columns if c not in numeric]
    if numeric:
        counts = melt(df, numeric).groupBy("_column", "_value").agg(F.count("*").alias("n"))
        best = counts.groupBy("_column").agg(F.min_by(F.struct("_value", "n"), F.struct(-F.col("n"), F.col("_value"))).alias("b"))
        parts.append(best.select(F.col("_column").alias("column"), F.col("b._value").cast("string").alias("mode"), F.col("b.n").alias("mode_count")))
    if other:
        counts = melt(df, other, cast="string").groupBy("_column", "_value").agg(F.count("*").alias("n"))
        best = counts.groupBy("_column").agg(F.min_by(F.struct("_value", "n"), F.struct(-F.col("n"), F.col("_value"))).alias("b"))
        parts.append(best.select(F.col("_column").alias("column"), F.col("b._value").alias("mode"), F.col("b.n").alias("mode_count")))
    return reduce(DataFrame.unionByName, parts)


def categorical_summary(df: DataFrame, columns=None):
    """Distinct values, nulls, null % and mode with its count and share, per categorical column."""
    cols = list(columns or string_columns(df))
    info = column_info(df.select(*cols)).select("column", F.col("unique").alias("unique_values"), F.col("nulls").alias("null_count"),
                                                F.col("null_pct").alias("null_percentage"), "non_null")
    modes = column_modes(df, cols)
    out = info.join(modes, "column", "left")
    rows = F.col("non_null") + F.col("null_count")
    return out.withColumn("mode_pct", F.round(F.col("mode_count") * 100.0 / rows, 2)).drop("non_null")


def missing_by_column(df: DataFrame):
    rows = F.col("_rows")
    counted = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(f"_{i}") for i, c in enumerate(df.columns)])
    items = [
        F.struct(
            F.lit(c).alias("column"), (rows - F.col(f"_{i}")).alias("missing_count"),
            F.round((rows - F.col(f"_{i}")) * 100.0 / rows, 2).alias("missing_percentage"),
        )
        for i, c in enumerate(df.columns)
    ]
    return counted.select(F.inline(F.array(*items)))


def missing_per_row(df: DataFrame):
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in df.columns])


def missing_by_row(df: DataFrame):
    """Rows by number of missing columns, in the bands 0, 1, 2-5, 6-10, 11-20, >20."""
    m = missing_per_row(df)
    band = (
        F.when(m == 0, "0").when(m == 1, "1").when(m <= 5, "2-5").when(m <= 10, "6-10").when(m <= 20, "11-20").otherwise(">20")
    )
    bands = df.groupBy(band.alias("missing_columns")).agg(F.count("*").alias("rows"))
    total = Window.partitionBy()  # at most six rows
    return bands.withColumn("percentage", F.round(F.col("rows") * 100.0 / F.sum("rows").over(total), 2))


def null_pattern(df: DataFrame):
    """Distinct patterns of missing columns ('1' = missing) with their row counts."""
    mask = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in df.columns])
    return df.groupBy(mask.alias("pattern")).agg(F.count("*").alias("rows"))


def describe_table(df: DataFrame, numeric=None, categorical=None):
    """Numeric and categorical description in one table, rounded to two decimals."""
    num = numeric_or(df, numeric)
    cat = list(categorical if categorical is not None else string_columns(df))
    s = numeric_summary(df, num)
    u = df.sparkSession.createDataFrame(list(distinct_counts(df, num).items()), "column string, unique long")
    r = lambda c: F.round(c, 2).alias(c) if isinstance(c, str) else F.round(c, 2)
    left = s.join(u, "column").select(
        "column", "count", *[r(c) for c in ("mean", "std", "min", "q1", "median", "q3", "max", "skew", "kurtosis")],
        r(F.col("q3") - F.col("q1")).alias("iqr"), "missing", r("missing_pct"), "unique",
        F.lit(None).cast("string").alias("top"), F.lit(None).cast("long").alias("freq"),
    )
    if not cat:
        return left
    n = df.count()
    right = categorical_summary(df, cat).select(
        "column", (F.lit(n) - F.col("null_count")).alias("count"),
        *[F.lit(None).cast("double").alias(x) for x in ("mean", "std", "min", "q1", "median", "q3", "max", "skew", "kurtosis", "iqr")],
        F.col("null_count").alias("missing"), F.round(F.col("null_count") * 100.0 / F.lit(n), 2).alias("missing_pct"),
        F.col("unique_values").alias("unique"), F.col("mode").alias("top"), F.col("mode_count").alias("freq"),
    )
    return left.unionByName(right)


def bin_index(c, lo, width, bins):
    """Equal-width bin number; the last bin is closed on the right."""
    if width == 0:
        return F.when(c.isNotNull(), F.lit(0))
    return F.when(c.isNotNull(), F.least(F.floor((c - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1)))


def value_range(df: DataFrame, columns):
    row = df.agg(*[f(number(c)).alias(f"{f.__name__}_{i}") for i, c in enumerate(columns) for f in (F.min, F.max)]).first()
    return {c: (row[f"min_{i}"], row[f"max_{i}"]) for i, c in enumerate(columns)}


def histogram(df: DataFrame, column, bins=30):
    """bin, left edge, right edge, count; empty bins are listed with zero."""
    lo, hi = value_range(df, [column])[column]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, left_edge double, right_edge double, count long")
    if lo == hi:
        # A constant column gets the unit-wide range around its value.
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    counts = df.select(bin_index(number(column), lo, width, bins).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("left_edge"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("right_edge"), F.coalesce("n", F.lit(0)).alias("count"),
    )


def column_distribution(df: DataFrame, column, bins=30):
    """{'statistics': one-row table, 'table': histogram or frequency table} of one column."""
    if column in numeric_columns(df):
        return {"statistics": numeric_summary(df, [column]), "table": histogram(df, column, bins)}
    return {"statistics": categorical_summary(df, [column]), "table": value_shares(df, column)}


def group_summary(df: DataFrame, column, group_by):
    """count, mean, std, min, max, quartiles, skew, kurtosis per group; NULL groups are dropped."""
    groups = [group_by] if isinstance(group_by, str) else list(group_by)
    df = df.where(reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in groups]))
    probs = [0.25, 0.5, 0.75]
    if is_compact(df.select(*groups, column)):
        q = F.percentile(number(column), F.array(*[F.lit(p) for p in probs])).alias("_q")
        wide = df.groupBy(*groups).agg(*_moments(column, ""), q)
    else:
        quart = exact_quantiles(df, [column], probs, groups).withColumnRenamed(column, "_q")
        wide = df.groupBy(*groups).agg(*_moments(column, "")).join(quart, groups, "left")
    return wide.select(
        *groups, "count", "mean", "std", "min", "max",
        F.get("_q", 0).alias("q1"), F.get("_q", 1).alias("median"), F.get("_q", 2).alias("q3"), "skew", "kurtosis",
    )


_AGGS = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "std": F.stddev}


def aggregate_by(df: DataFrame, x, y, how="mean", k=None):
    """One aggregate of ``y`` per ``x``; with ``k`` the largest groups first."""
    out = df.where(F.col(x).isNotNull()).groupBy(x).agg(_AGGS[how](y).alias("value"))
    return out.orderBy(F.desc("value"), x).limit(k) if k else out


def line_by(df: DataFrame, x, y, how="mean"):
    return aggregate_by(df, x, y, how).orderBy(x)


def distinct_values(df: DataFrame, column, cap=1000):
    """Sorted values of a pivot column; more than ``cap`` is an error, not a silent cut."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(cap + 1).collect()]
    if len(values) > cap:
        raise ValueError(f"{column} has more than {cap} values; raise the cap to spread it")
    return values


def crosstab(df: DataFrame, row, column, normalize=False, cap=1000):
    """Counts of row x column values, optionally as shares of each row."""
    df = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    values = distinct_values(df, column, cap)
    table = df.groupBy(row).pivot(column, values).count().na.fill(0)
    if not normalize:
        return table
    total = reduce(lambda a, b: a + b, [F.col(f"`{v}`") for v in values])
    return table.select(row, *[(F.col(f"`{v}`") / total).alias(str(v)) for v in values])


def pivot_mean(df: DataFrame, row, column, value, cap=1000):
    values = distinct_values(df, column, cap)
    return df.where(F.col(row).isNotNull()).groupBy(row).pivot(column, values).agg(F.avg(value))


_PERIODS = {"D": ("day", "interval 1 day"), "W": ("week", "interval 7 days"), "M": ("month", "interval 1 month"),
            "Q": ("quarter", "interval 3 months"), "Y": ("year", "interval 1 year")}


def period_label(start, freq):
    """Date by which a period is labelled: its day, its Sunday, or its last day."""
    start = start.cast("date")
    if freq == "D":
        return start
    if freq == "W":
        return F.date_add(start, 6)
    months = {"M": 0, "Q": 2, "Y": 11}[freq]
    return F.last_day(F.add_months(start, months))


def resample(df: DataFrame, time_column, value, freq="D", how="mean"):
    """Aggregate per calendar period; periods without rows are listed too."""
    unit, step = _PERIODS[freq]
    start = F.date_trunc(unit, F.col(time_column)).cast("date").alias("start")
    grouped = df.where(F.col(time_column).isNotNull()).groupBy(start).agg(_AGGS[how](value).alias("value"))
    ends = grouped.agg(F.min("start").alias("a"), F.max("start").alias("b"))
    calendar = ends.select(F.explode(F.sequence("a", "b", F.expr(step))).alias("start"))
    out = calendar.join(grouped, "start", "left")
    if how in ("sum", "count"):
        out = out.na.fill(0, ["value"])
    return out.select(period_label(F.col("start"), freq).alias("period"), "value")


def class_balance(df: DataFrame, target):
    """Class counts, shares and the table-wide imbalance ratio (max / min)."""
    counts = keep(value_counts(df, target))
    ends = counts.agg(F.sum("count").alias("n"), F.max("count").alias("hi"), F.min("count").alias("lo")).first()
    if not ends["n"]:
        return counts
    ratio = ends["hi"] / ends["lo"]
    return counts.select(
        target, "count", F.round(F.col("count") * 100.0 / F.lit(ends["n"]), 2).alias("percentage"),
        F.lit(round(ratio, 6)).alias("imbalance_ratio"), F.lit(ratio > 10).alias("imbalanced"),
        F.lit(ends["lo"] / ends["hi"] < 0.2).alias("minority_below_20pct"),
    )


def residual_statistics(df: DataFrame, actual, predicted):
    """Mean, median, std, min, max, skew and kurtosis of residual, absolute and squared error."""
    r = number(actual) - number(predicted)
    long = df.select(r.alias("residual"), F.abs(r).alias("absolute_error"), (r * r).alias("squared_error"))
    s = numeric_summary(long)
    return s.select(F.col("column").alias("series"), "count", "mean", "median", "std", "min", "max", "skew", "kurtosis")


def cluster_profile(df: DataFrame, cluster, features):
    """Size, share and per-feature mean and std of every cluster."""
    aggs = [F.count("*").alias("size")]
    for f in features:
        aggs += [F.avg(f).alias(f"{f}_mean"), F.stddev(f).alias(f"{f}_std")]
    out = df.groupBy(cluster).agg(*aggs)
    n = df.count()
    return out.withColumn("percentage", F.round(F.col("size") * 100.0 / F.lit(n), 2))
