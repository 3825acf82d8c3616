"""Scalers: one statistics job to fit, a projection to transform."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.columns import numeric_or, replace_columns
from millrace.plans.quantiles import column_quantiles, number
from millrace.plans.spec import fit_transform, step


def _stats(df, cols, *fns):
    row = df.agg(*[f(number(c)).alias(f"{j}_{i}") for i, c in enumerate(cols) for j, f in enumerate(fns)]).first()
    return {c: [row[f"{j}_{i}"] for j in range(len(fns))] for i, c in enumerate(cols)}


def _linear(df, learned):
    """x -> (x - shift) / divisor + offset for every learned column."""
    new = {}
    for c, (shift, divisor, offset) in learned["linear"].items():
        if shift is not None:
            new[c] = (number(c) - F.lit(shift)) / F.lit(divisor) + F.lit(offset)
    return replace_columns(df, new)


def _fit_standard(df, columns, with_mean=True, with_std=True):
    """Population deviation; a constant column is only centred."""
    out = {}
    for c, (m, s) in _stats(df, numeric_or(df, columns), F.avg, F.stddev_pop).items():
        out[c] = (None, 1.0, 0.0) if m is None else (m if with_mean else 0.0, (s or 1.0) if with_std else 1.0, 0.0)
    return {"linear": out}


def _fit_minmax(df, columns, feature_range=(0.0, 1.0)):
    """Constant columns map to the lower end of the range."""
    a, b = map(float, feature_range)
    out = {}
    for c, (lo, hi) in _stats(df, numeric_or(df, columns), F.min, F.max).items():
        out[c] = (None, 1.0, 0.0) if lo is None else (lo, ((hi - lo) or 1.0) / (b - a), a)
    return {"linear": out}


def _fit_robust(df, columns, quantile_range=(25.0, 75.0)):
    lo, hi = quantile_range
    out = {}
    for c, (q1, med, q3) in column_quantiles(df, numeric_or(df, columns), [lo / 100, 0.5, hi / 100]).items():
        out[c] = (None, 1.0, 0.0) if med is None else (med, (q3 - q1) or 1.0, 0.0)
    return {"linear": out}


def _fit_maxabs(df, columns):
    out = {}
    for c, (lo, hi) in _stats(df, numeric_or(df, columns), F.min, F.max).items():
        out[c] = (None, 1.0, 0.0) if lo is None else (0.0, max(abs(lo), abs(hi)) or 1.0, 0.0)
    return {"linear": out}


step("standard", _fit_standard)(_linear)
step("minmax", _fit_minmax)(_linear)
step("robust", _fit_robust)(_linear)
step("maxabs", _fit_maxabs)(_linear)


def _fit_normalize(df, columns, norm="l2"):
    if norm not in ("l1", "l2", "max"):
        raise ValueError(f"unknown norm {norm}")
    return {"columns": numeric_or(df, columns), "norm": norm}


@step("normalize", _fit_normalize)
def normalize(df, learned):
    """Scale every row to unit norm; all-zero rows stay as they are."""
    cols = learned["columns"]
    mags = [F.abs(number(c)) for c in cols]
    if learned["norm"] == "max":
        size = F.greatest(*mags) if len(mags) > 1 else mags[0]
    elif learned["norm"] == "l1":
        size = reduce(lambda a, b: a + b, mags)
    else:
        size = F.sqrt(reduce(lambda a, b: a + b, [m * m for m in mags]))
    return replace_columns(df, {c: F.when(size == 0, number(c)).otherwise(number(c) / size) for c in cols})


def log_of(v, base="e"):
    """Logarithm that is NULL outside its domain."""
    if base == "e":
        return F.ln(v)
    if base == 2:
        return F.log2(v)
    if base == 10:
        return F.log10(v)
    return F.ln(v) / F.ln(F.lit(float(base)))


def _fit_log(df, columns, base="e", epsilon=1e-8):
    return {"columns": numeric_or(df, columns), "base": base, "epsilon": epsilon}


@step("log", _fit_log)
def log_scale(df, learned):
    return replace_columns(df, {c: log_of(number(c) + F.lit(learned["epsilon"]), learned["base"]) for c in learned["columns"]})


def scale_features(df: DataFrame, method, columns=None, **params):
    return fit_transform(method, df, columns, **params)
