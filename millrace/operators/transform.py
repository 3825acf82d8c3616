"""Numeric transforms that add derived columns."""

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.columns import numeric_or, replace_columns
from millrace.operators.scale import log_of
from millrace.plans.ordered import number_rows
from millrace.plans.quantiles import column_quantiles, number
from millrace.plans.spec import fit_transform, step


def _columns_fit(df, columns, **params):
    return {"columns": numeric_or(df, columns), **params}


def _add(df, new):
    """Add many columns in a few projections, so that no single one grows without limit."""
    items = list(new.items())
    for i in range(0, len(items), 100):
        df = df.select("*", *[e.alias(n) for n, e in items[i : i + 100]])
    return df


@step("log_feature", _columns_fit)
def log_feature(df, learned):
    """``log_<column>``; epsilon is added unless invalid values are to be dropped (left NULL)."""
    keep = learned.get("handle_zeros", "epsilon") == "drop"
    eps = 0.0 if keep else learned.get("epsilon", 1e-10)
    return _add(df, {f"log_{c}": log_of(number(c) + F.lit(eps), learned.get("base", "e")) for c in learned["columns"]})


def box_cox(v, lam):
    lam = F.lit(float(lam)) if isinstance(lam, (int, float)) else lam
    return F.when(F.abs(lam) < 1e-12, F.ln(v)).otherwise((F.pow(v, lam) - 1) / lam)


def yeo_johnson(v, lam):
    lam = F.lit(float(lam)) if isinstance(lam, (int, float)) else lam
    return F.when(v >= 0, box_cox(v + 1, lam)).otherwise(-box_cox(1 - v, 2 - lam))


#: Columns whose candidates are tried in one scan.
COLUMNS_A_SCAN = 8


def _powers(v, logs, lam):
    """box_cox of an array whose logarithms are known; NaN where the logarithm has no value."""
    return logs if abs(lam) < 1e-12 else (np.power(v, lam) - 1.0) / lam


def power_moments(df: DataFrame, candidates, family) -> DataFrame:
    """Rows (i, j, mean, var): mean and variance of column i under its candidate j; j = -1 is the logarithm of the slope.

    A task keeps a count, a mean and a sum of squares for every candidate and passes them on once.
    """
    widest = 1 + max(map(len, candidates))

    def partial(batches):
        n, mean, squares = (np.zeros((len(candidates), widest)) for _ in range(3))

        def add(i, j, x):
            if len(x):
                m = x.mean()
                gap, total = m - mean[i, j], n[i, j] + len(x)
                squares[i, j] += np.square(x - m).sum() + gap * gap * n[i, j] * len(x) / total
                mean[i, j] += gap * len(x) / total
                n[i, j] = total

        with np.errstate(all="ignore"):
            for b in batches:
                for i, lams in enumerate(candidates):
                    v = b.column(i).drop_null().to_numpy(zero_copy_only=False)
                    if family == "box-cox":
                        # The logarithm of a number that is not positive is null, not NaN.
                        logs = np.log(np.where(v > 0, v, 1.0))
                        held = (v > 0) | np.isnan(v)
                        logs[np.isnan(v)] = np.nan
                        add(i, 0, logs[held])
                        for j, lam in enumerate(lams, 1):
                            x = _powers(v, logs, lam)
                            add(i, j, x[held] if abs(lam) < 1e-12 else x)
                        continue
                    above = v[v >= 0] + 1.0
                    below = 1.0 - v[~(v >= 0)]
                    up, down = np.log(above), np.log(below)
                    add(i, 0, np.sign(v) * np.log1p(np.abs(v)))
                    for j, lam in enumerate(lams, 1):
                        add(i, j, np.concatenate((_powers(above, up, lam), -_powers(below, down, 2.0 - lam))))
        at = np.argwhere(n > 0)
        yield pa.record_batch({"i": pa.array(at[:, 0], pa.int32()), "j": pa.array(at[:, 1] - 1, pa.int32()),
                               **{k: pa.array(x[at[:, 0], at[:, 1]]) for k, x in (("n", n), ("m", mean), ("q", squares))}})

    parts = df.mapInArrow(partial, "i int, j int, n double, m double, q double")
    own = Window.partitionBy("i", "j")
    parts = parts.withColumn("centre", F.sum(F.col("n") * F.col("m")).over(own) / F.sum("n").over(own))
    spread = F.col("q") + F.col("n") * (F.col("m") - F.col("centre")) * (F.col("m") - F.col("centre"))
    return parts.groupBy("i", "j").agg(F.first("centre").alias("mean"), (F.sum(spread) / F.sum("n")).alias("var"))


def likelihood_lambda(df: DataFrame, columns, family="yeo-johnson", shifts=None, low=-5.0, high=5.0, rounds=3, grid=13):
    """Maximum-likelihood lambda per column.

    Every round takes the variances under a whole grid of candidates in one scan, per Arrow batch and for COLUMNS_A_SCAN
    columns at a time, then narrows the range around the best one. The last step is the vertex of the parabola through
    the three best candidates.
    """
    shifts = shifts or {}
    spans = {c: (low, high) for c in columns}
    best = {}
    df = df.select(*columns)
    for _ in range(rounds):
        found, at = {}, {c: [spans[c][0] + j * (spans[c][1] - spans[c][0]) / (grid - 1) for j in range(grid)] for c in columns}
        for first in range(0, len(columns), COLUMNS_A_SCAN):
            some = columns[first : first + COLUMNS_A_SCAN]
            shifted = df.select(*[(number(c) + F.lit(float(shifts.get(c, 0.0)))).alias(f"_{i}") for i, c in enumerate(some)])
            for r in power_moments(shifted, [at[c] for c in some], family).collect():
                found[f"s{first + r['i']}" if r["j"] < 0 else f"v{first + r['i']}_{r['j']}"] = r["mean"] if r["j"] < 0 else r["var"]
        for i, c in enumerate(columns):
            width = (spans[c][1] - spans[c][0]) / (grid - 1)
            score = {}
            for j, lam in enumerate(at[c]):
                var = found.get(f"v{i}_{j}")
                if var is not None and var > 0 and math.isfinite(var):
                    score[lam] = -0.5 * math.log(var) + (lam - 1) * found[f"s{i}"]
            best[c] = max(score, key=score.get) if score else 1.0
            order = sorted(score)
            top = order.index(best[c]) if score else 0
            if 0 < top < len(order) - 1:
                y0, y1, y2 = (score[order[top + k]] for k in (-1, 0, 1))
                bend = y0 - 2 * y1 + y2
                best[c] += 0.5 * width * (y0 - y2) / bend if bend < 0 else 0.0
            spans[c] = (best[c] - width, best[c] + width)
    return best


def _lambdas(cols, lmbda):
    if isinstance(lmbda, dict):
        return {c: lmbda.get(c) for c in cols}
    if isinstance(lmbda, (list, tuple)):
        return {c: (lmbda[i] if i < len(lmbda) else None) for i, c in enumerate(cols)}
    return {c: lmbda for c in cols}


def _fit_power(family):
    def fitter(df, columns, lmbda=None):
        cols = numeric_or(df, columns)
        shifts = {c: 0.0 for c in cols}
        if family == "box-cox":
            row = df.agg(*[F.min(number(c)).alias(c) for c in cols]).first()
            shifts = {c: abs(row[c]) + 1e-6 if row[c] is not None and row[c] <= 0 else 0.0 for c in cols}
        lams = _lambdas(cols, lmbda)
        open_ = [c for c in cols if lams[c] is None]
        if open_:
            lams.update(likelihood_lambda(df, open_, family, shifts))
        return {"lambdas": lams, "shifts": shifts}

    return fitter


@step("box_cox", _fit_power("box-cox"))
def box_cox_transform(df, learned):
    return _add(df, {f"boxcox_{c}": box_cox(number(c) + F.lit(learned["shifts"][c]), l) for c, l in learned["lambdas"].items()})


@step("yeo_johnson", _fit_power("yeo-johnson"))
def yeo_johnson_transform(df, learned):
    return _add(df, {f"yeojohnson_{c}": yeo_johnson(number(c), l) for c, l in learned["lambdas"].items()})


def _fit_power_scale(df, columns, method="yeo-johnson", lmbda=None):
    cols = numeric_or(df, columns)
    if method == "box-cox":
        row = df.agg(*[F.min(number(c)).alias(c) for c in cols]).first()
        bad = [c for c in cols if row[c] is not None and row[c] <= 0]
        if bad:
            raise ValueError(f"box-cox needs positive values: {bad}")
    lams = _lambdas(cols, lmbda)
    open_ = [c for c in cols if lams[c] is None]
    if open_:
        lams.update(likelihood_lambda(df, open_, method))
    f = box_cox if method == "box-cox" else yeo_johnson
    row = df.agg(*[g(f(number(c), lams[c])).alias(f"{n}{i}") for i, c in enumerate(cols) for n, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {"method": method, "lambdas": lams, "moments": {c: [row[f"m{i}"], row[f"s{i}"] or 1.0] for i, c in enumerate(cols)}}


@step("power_scale", _fit_power_scale)
def power_scale(df, learned):
    """Power transform in place, then zero mean and unit variance."""
    f = box_cox if learned["method"] == "box-cox" else yeo_johnson
    return replace_columns(
        df, {c: (f(number(c), l) - F.lit(learned["moments"][c][0])) / F.lit(learned["moments"][c][1]) for c, l in learned["lambdas"].items()}
    )


@step("signed_power", _columns_fit)
def signed_power(df, learned):
    """sign(x) * |x|^p; p = 0 is the logarithm."""
    p = learned.get("power", 2)
    e = (lambda v: F.ln(v)) if p == 0 else (lambda v: F.signum(v) * F.pow(F.abs(v), F.lit(float(p))))
    return _add(df, {f"power{p}_{c}": e(number(c)) for c in learned["columns"]})


def _fit_quantile(df, columns, n_quantiles=1000, output_distribution="uniform"):
    cols = numeric_or(df, columns)
    n = max(2, min(n_quantiles, df.count()))
    grid = column_quantiles(df, cols, [i / (n - 1) for i in range(n)])
    return {"grid": grid, "output": output_distribution}


# Coefficients of Acklam's rational approximation to the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _horner(coef, x):
    out = F.lit(coef[0])
    for k in coef[1:]:
        out = out * x + F.lit(k)
    return out


def normal_quantile(p):
    """Inverse normal distribution function as a column expression (relative error below 2e-9)."""
    q = p - 0.5
    r = q * q
    mid = _horner(_A, r) * q / _horner((*_B, 1.0), r)
    low = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    tail = _horner(_C, low) / _horner((*_D, 1.0), low)
    return F.when((p >= 0.02425) & (p <= 1 - 0.02425), mid).when(p < 0.5, tail).otherwise(-tail)


@step("quantile_transform", _fit_quantile)
def quantile_transform(df, learned):
    """Map values to their position among the fitted quantiles, uniform or normal.

    Ties in the quantile grid take the mean of their first and last position.
    """
    new = {}
    for c, grid in learned["grid"].items():
        if not grid or grid[0] is None:
            new[f"quantile_{c}"] = F.lit(None).cast("double")
            continue
        n = len(grid)
        points = {}
        for i, g in enumerate(grid):
            first, last = points.get(g, (i, i))
            points[g] = (min(first, i), max(last, i))
        xs = sorted(points)
        ps = [(points[x][0] + points[x][1]) / 2 / (n - 1) for x in xs]
        ps[0], ps[-1] = (0.0, 1.0) if len(xs) > 1 else (ps[0], ps[-1])
        v = number(c)
        gx, gp = _constant_array(xs), _constant_array(ps)
        at = F.col(f"_at_{c}")
        df = df.withColumn(f"_at_{c}", _position(v, gx, len(xs)))
        x0, x1 = F.get(gx, at), F.get(gx, at + 1)
        p0, p1 = F.get(gp, at), F.get(gp, at + 1)
        uniform = (
            F.when(v.isNull(), F.lit(None).cast("double")).when(v <= xs[0], F.lit(ps[0])).when(v >= xs[-1], F.lit(ps[-1]))
            .otherwise(p0 + (p1 - p0) * (v - x0) / (x1 - x0))
        )
        if learned["output"] == "normal":
            uniform = normal_quantile(F.greatest(F.lit(1e-7), F.least(uniform, F.lit(1 - 1e-7))))
        new[f"quantile_{c}"] = uniform
    return _add(df, new).drop(*[f"_at_{c}" for c in learned["grid"]])


def _constant_array(values):
    """Array literal given as one text, which the optimizer folds into a constant."""
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


def _position(v, array, size):
    """Index of the last array element <= v, by halving steps over the array."""
    widths = [2**k for k in range(size.bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.lit(widths), F.lit(0), lambda pos, w: F.when((pos + w < size) & (F.get(array, pos + w) <= v), pos + w).otherwise(pos)
    )


@step("sigmoid", _columns_fit)
def sigmoid(df, learned):
    return _add(df, {f"sigmoid_{c}": 1 / (1 + F.exp(-number(c))) for c in learned["columns"]})


@step("tanh", _columns_fit)
def tanh(df, learned):
    return _add(df, {f"tanh_{c}": F.tanh(number(c)) for c in learned["columns"]})


_MATH = {
    "sqrt": ("_sqrt", lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))),
    "square": ("_squared", lambda v: v * v),
    "cube": ("_cubed", lambda v: v * v * v),
    "exp": ("_exp", F.exp),
    "inverse": ("_inverse", lambda v: F.try_divide(F.lit(1.0), v + F.lit(1e-10))),
    "log": ("_log", lambda v: F.ln(v + F.lit(1e-10))),
}


def _guarded(name, v):
    # greatest() skips NULLs, so a missing value must be kept apart.
    return F.when(v.isNotNull(), _MATH[name][1](v))


@step("math", _columns_fit)
def math_function(df, learned):
    """sqrt, square, cube, exp, inverse or log as ``<column><suffix>``."""
    fns = learned["functions"]
    return _add(df, {c + _MATH[f][0]: _guarded(f, number(c)) for c in learned["columns"] for f in fns})


def add_noise(df: DataFrame, columns, kind="gaussian", scale=0.1, relative=True, seed=42):
    """Add seeded gaussian or uniform noise of ``scale`` (times the column's deviation)."""
    cols = numeric_or(df, columns)
    size = {c: scale for c in cols}
    if relative:
        row = df.agg(*[F.stddev(number(c)).alias(c) for c in cols]).first()
        size = {c: scale * (row[c] or 0.0) for c in cols}
    draw = (lambda i: F.randn(seed + i)) if kind == "gaussian" else (lambda i: F.rand(seed + i) * 2 - 1)
    return replace_columns(df, {c: number(c) + draw(i) * F.lit(size[c]) for i, c in enumerate(cols)})


def spectral_features(df: DataFrame, columns, order_by, n_components=5, method="fft"):
    """First Fourier magnitudes or cosine coefficients of each column in row order, as constant columns.

    Missing values count as zero.
    """
    cols = numeric_or(df, columns)
    numbered = number_rows(df, order_by, name="_t")
    n = df.count()
    t = F.col("_t") - 1
    aggs = []
    for i, c in enumerate(cols):
        v = F.coalesce(number(c), F.lit(0.0))
        for k in range(n_components):
            if method == "fft":
                angle = F.lit(2 * math.pi * k / n) * t
                aggs += [F.sum(v * F.cos(angle)).alias(f"re{i}_{k}"), F.sum(v * F.sin(angle)).alias(f"im{i}_{k}")]
            elif method == "dct":
                angle = F.lit(math.pi * k / (2 * n)) * (2 * t + 1)
                aggs.append(F.sum(v * F.cos(angle)).alias(f"re{i}_{k}"))
            else:
                raise ValueError(f"unknown spectral method {method}")
    row = numbered.agg(*aggs).first()
    new = {}
    for i, c in enumerate(cols):
        for k in range(min(n_components, n)):
            if method == "fft":
                new[f"{c}_fft_mag_{k + 1}"] = F.lit(math.hypot(row[f"re{i}_{k}"], row[f"im{i}_{k}"]))
            else:
                new[f"{c}_dct_{k + 1}"] = F.lit(row[f"re{i}_{k}"] * math.sqrt((1 if k == 0 else 2) / n))
    return _add(df, new)


def transform_features(df: DataFrame, steps):
    """Apply a list of {type, columns, params} in order."""
    for s in steps:
        df = fit_transform(s["type"], df, s.get("columns"), **s.get("params", {}))
    return df
