"""Outliers: detection flags, removal, capping, replacement, summary."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.columns import numeric_or, replace_columns
from millrace.plans.quantiles import column_quantiles, number
from millrace.plans.spec import fit, step


def outlier_bounds(df: DataFrame, columns=None, method="zscore", threshold=None, lower=0.01, upper=0.99, sample_std=False):
    """column -> (low, high); values outside are outliers. One job for all columns.

    zscore uses the population deviation to detect and the sample deviation to cap.
    """
    cols = numeric_or(df, columns)
    if method == "zscore":
        t = 3.0 if threshold is None else threshold
        std = F.stddev if sample_std else F.stddev_pop
        row = df.agg(*[f(number(c)).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", std))]).first()
        out = {}
        for i, c in enumerate(cols):
            m, s = row[f"m{i}"], row[f"s{i}"]
            out[c] = (m - t * s, m + t * s) if m is not None and s else (None, None)
        return out
    if method == "iqr":
        t = 1.5 if threshold is None else threshold
        q = column_quantiles(df, cols, [0.25, 0.75])
        return {c: (a - t * (b - a), b + t * (b - a)) if a is not None else (None, None) for c, (a, b) in q.items()}
    if method in ("quantile", "percentile"):
        return {c: tuple(q) for c, q in column_quantiles(df, cols, [lower, upper]).items()}
    raise ValueError(f"unknown outlier method {method}")


def _outside(c, bounds):
    lo, hi = bounds
    if lo is None:
        return F.lit(False)
    v = number(c)
    return F.coalesce((v < F.lit(lo)) | (v > F.lit(hi)), F.lit(False))


def _fit_bounds(df, columns, **params):
    return {"bounds": outlier_bounds(df, columns, **params)}


@step("flag_outliers", _fit_bounds)
def flag_outliers(df, learned):
    return df.withColumns({f"{c}_outlier": _outside(c, b) for c, b in learned["bounds"].items()})


@step("remove_outliers", _fit_bounds)
def remove_outliers(df, learned):
    return df.where(~reduce(lambda a, b: a | b, [_outside(c, b) for c, b in learned["bounds"].items()]))


def _fit_cap(df, columns, method="iqr", **params):
    return {"bounds": outlier_bounds(df, columns, method=method, sample_std=True, **params)}


@step("cap_outliers", _fit_cap)
def cap_outliers(df, learned):
    new = {}
    for c, (lo, hi) in learned["bounds"].items():
        if lo is not None:
            v = number(c)
            new[c] = F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(hi)), F.lit(lo)))
    return replace_columns(df, new)


def _fit_replace(stat):
    def fitter(df, columns, **params):
        bounds = outlier_bounds(df, columns, **params)
        if stat == "mean":
            row = df.agg(*[F.avg(number(c)).alias(c) for c in bounds]).first()
            values = {c: row[c] for c in bounds}
        else:
            values = {c: q[0] for c, q in column_quantiles(df, list(bounds), [0.5]).items()}
        return {"bounds": bounds, "values": values}

    return fitter


def _replace(df, learned):
    new = {
        c: F.when(_outside(c, b), F.lit(learned["values"][c])).otherwise(number(c)) for c, b in learned["bounds"].items()
    }
    return replace_columns(df, new)


step("replace_outliers_mean", _fit_replace("mean"))(_replace)
step("replace_outliers_median", _fit_replace("median"))(_replace)


def detect_outliers(df: DataFrame, columns=None, method="zscore", **params):
    """Append one boolean ``<column>_outlier`` per column; tree and neighbour methods one ``outlier``."""
    if method == "isolation_forest":
        from millrace.operators.forest import isolation_forest

        return isolation_forest(df, numeric_or(df, columns), **params)
    if method == "lof":
        from millrace.operators.knn import local_outlier_factor

        return local_outlier_factor(df, numeric_or(df, columns), **params)
    return fit("flag_outliers", df, columns, method=method, **params).transform(df)


def outlier_summary(df: DataFrame, columns=None, method="zscore", threshold=3.0):
    """count, percentage of non-missing values, min and max of the outliers per column."""
    bounds = outlier_bounds(df, columns, method, threshold)
    aggs = []
    for i, (c, b) in enumerate(bounds.items()):
        hit = F.when(_outside(c, b), number(c))
        aggs += [F.count(hit).alias(f"n{i}"), F.count(number(c)).alias(f"t{i}"), F.min(hit).alias(f"a{i}"), F.max(hit).alias(f"b{i}")]
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("count"),
            F.round(F.try_divide(F.col(f"n{i}") * 100.0, F.col(f"t{i}")), 2).alias("percentage"),
            F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max"),
        )
        for i, c in enumerate(bounds)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))
