"""Statistical tests: sufficient statistics in Spark, one closed formula on the driver."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import dist
from millrace.operators.bootstrap import bootstrap_ci  # noqa: F401
from millrace.operators.columns import numeric_or
from millrace.operators.moments import kurt, skew
from millrace.plans import batches
from millrace.plans.lookup import attach
from millrace.plans.ordered import prefix_sum
from millrace.plans.quantiles import column_quantiles, exact_quantiles, number
from millrace.plans.sizing import keep


def _result(df, **values):
    return df.sparkSession.createDataFrame(pd.DataFrame([values]))


def _f_table(groups):
    """F statistic from a table of group (n, m, v) with sample variances."""
    t = groups.where("n > 0").agg(F.sum("n").alias("N"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("M")).first()
    s = groups.where("n > 0").agg(
        F.sum(F.col("n") * (F.col("m") - F.lit(t["M"])) * (F.col("m") - F.lit(t["M"]))).alias("between"),
        F.sum(F.coalesce("v", F.lit(0.0)) * (F.col("n") - 1)).alias("within"),
    ).first()
    d1, d2 = t["k"] - 1, t["N"] - t["k"]
    f = (s["between"] / d1) / (s["within"] / d2) if s["within"] else math.inf
    return f, d1, d2


def _group_moments(df, column, group):
    v = number(column)
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.variance(v).alias("v"))


def anova(df: DataFrame, column, group):
    f, d1, d2 = _f_table(keep(_group_moments(df, column, group)))
    return _result(df, f_statistic=f, p_value=dist.f_sf(f, d1, d2))


def levene(df: DataFrame, column, group):
    """Equality of variances, deviations taken from the group medians."""
    df = df.where(F.col(group).isNotNull() & number(column).isNotNull()).select(group, number(column).alias(column))
    med = exact_quantiles(df, [column], [0.5], [group]).select(group, F.get(column, 0).alias("_med"))
    sized = med.join(df.groupBy(group).agg(F.count("*").alias("_n")), group)
    dev = attach(df, keep(sized), [group], ["_med"], weight="_n").select(group, F.abs(F.col(column) - F.col("_med")).alias("d"))
    f, d1, d2 = _f_table(keep(_group_moments(dev, "d", group)))
    return _result(df, statistic=f, p_value=dist.f_sf(f, d1, d2))


def chi2(df: DataFrame, a, b):
    """Independence of two categorical columns; 2x2 tables get the continuity correction."""
    cells = keep(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("o")), "cells")
    ra = cells.groupBy(a).agg(F.sum("o").alias("ra"))
    rb = cells.groupBy(b).agg(F.sum("o").alias("rb"))
    size = cells.agg(F.sum("o").alias("n")).first()["n"]
    r, c = ra.count(), rb.count()
    dof = (r - 1) * (c - 1)
    joined = cells.join(ra, a).join(rb, b)
    if dof == 1:
        grid = {(x[a], x[b]): x["o"] for x in cells.collect()}
        rows, cols = sorted({k[0] for k in grid}), sorted({k[1] for k in grid})
        o = [[grid.get((i, j), 0) for j in cols] for i in rows]
        stat = 0.0
        for i in range(2):
            for j in range(2):
                e = sum(o[i]) * (o[0][j] + o[1][j]) / size
                stat += max(abs(o[i][j] - e) - min(0.5, abs(o[i][j] - e)), 0) ** 2 / e
    else:
        # Empty cells contribute their expected count, which the sum over observed cells covers.
        stat = size * (joined.agg(F.sum(F.col("o") * F.col("o") / (F.col("ra").cast("double") * F.col("rb")))).first()[0] - 1)
    return _result(df, chi2=float(stat), p_value=dist.chi2_sf(stat, dof) if dof else 1.0, dof=dof)


def t_test(df: DataFrame, column, group, first, second, equal_var=True):
    """Two-sample t-test of the rows of two groups, pooled or with unequal variances."""
    v = number(column)
    row = df.agg(*[
        f(F.when(F.col(group) == g, v)).alias(f"{n}{i}")
        for i, g in enumerate((first, second)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.variance))
    ]).first()
    n0, n1, v0, v1 = row["n0"], row["n1"], row["v0"], row["v1"]
    if equal_var:
        dof = n0 + n1 - 2
        se = math.sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / dof * (1 / n0 + 1 / n1))
    else:
        a, b = v0 / n0, v1 / n1
        se = math.sqrt(a + b)
        dof = (a + b) ** 2 / (a * a / (n0 - 1) + b * b / (n1 - 1))
    t = (row["m0"] - row["m1"]) / se
    return _result(df, t_statistic=t, p_value=dist.t_sf2(t, dof), dof=float(dof))


def paired_t_test(df: DataFrame, a, b):
    d = number(a) - number(b)
    row = df.agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev(d).alias("s")).first()
    t = row["m"] / (row["s"] / math.sqrt(row["n"]))
    return _result(df, t_statistic=t, p_value=dist.t_sf2(t, row["n"] - 1))


def _tie_term():
    t = F.col("t").cast("double")
    return F.sum(t * t * t - t)


def mann_whitney(df: DataFrame, column, group, first, second):
    """Two-sided U test, normal approximation with tie and continuity correction."""
    v = number(column)
    counts = df.where(F.col(group).isin(first, second) & v.isNotNull()).groupBy(v.alias("v")).agg(
        F.count("*").alias("t"), F.count(F.when(F.col(group) == first, 1)).alias("a"))
    ranked = prefix_sum(counts, F.col("t"), ["v"])
    row = ranked.agg(F.sum("t").alias("n"), F.sum("a").alias("n1"), F.sum(F.col("a") * (F.col("_before") + (F.col("t") + 1) / 2)).alias("r1"), _tie_term().alias("ties")).first()
    n, n1 = row["n"], row["n1"]
    n2 = n - n1
    u1 = row["r1"] - n1 * (n1 + 1) / 2
    s = math.sqrt(n1 * n2 / 12 * ((n + 1) - row["ties"] / (n * (n - 1))))
    z = (max(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / s
    return _result(df, u_statistic=float(u1), p_value=min(1.0, 2 * dist.norm_sf(z)))


def wilcoxon(df: DataFrame, a, b):
    """Signed-rank test of paired columns; zero differences are dropped."""
    d = number(a) - number(b)
    counts = df.select(d.alias("d")).where("d is not null and d != 0").groupBy(F.abs("d").alias("m")).agg(
        F.count("*").alias("t"), F.count(F.when(F.col("d") > 0, 1)).alias("pos"))
    ranked = prefix_sum(counts, F.col("t"), ["m"])
    rank = F.col("_before") + (F.col("t") + 1) / 2
    row = ranked.agg(F.sum("t").alias("n"), F.sum(F.col("pos") * rank).alias("plus"), F.sum(F.col("t") * rank).alias("both"), _tie_term().alias("ties")).first()
    n = row["n"]
    stat = min(row["plus"], row["both"] - row["plus"])
    se = math.sqrt((n * (n + 1) * (2 * n + 1) - row["ties"] / 2) / 24)
    z = (stat - n * (n + 1) / 4) / se
    return _result(df, w_statistic=float(stat), p_value=min(1.0, 2 * dist.norm_sf(abs(z))))


def kruskal(df: DataFrame, column, group):
    """Rank test of several groups with tie correction."""
    v = number(column)
    cells = df.where(F.col(group).isNotNull() & v.isNotNull()).groupBy(v.alias("v"), F.col(group).alias("g")).agg(F.count("*").alias("c"))
    cells = keep(cells, "cells")
    ranks = prefix_sum(cells.groupBy("v").agg(F.sum("c").alias("t")), F.col("t"), ["v"]).select("v", "t", (F.col("_before") + (F.col("t") + 1) / 2).alias("r"))
    ranks = keep(ranks, "ranks")
    sums = attach(cells, ranks, ["v"], ["r"], weight="t").groupBy("g").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("r")).alias("s"))
    row = sums.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q")).first()
    ties = ranks.agg(_tie_term()).first()[0]
    n = row["n"]
    h = (12 / (n * (n + 1)) * row["q"] - 3 * (n + 1)) / (1 - ties / (float(n) ** 3 - n))
    return _result(df, h_statistic=h, p_value=dist.chi2_sf(h, row["k"] - 1))


def normality(df: DataFrame, columns=None, alpha=0.05):
    """D'Agostino K-squared and Kolmogorov-Smirnov (against N(0, 1)) per column."""
    from pyspark.ml.stat import KolmogorovSmirnovTest

    cols = numeric_or(df, columns)
    row = df.agg(*[f(number(c)).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("n", F.count), ("s", F.skewness), ("k", F.kurtosis))]).first()
    rows = []
    for i, c in enumerate(cols):
        k2 = dagostino(row[f"n{i}"], row[f"s{i}"], row[f"k{i}"])
        ks = KolmogorovSmirnovTest.test(df.select(number(c).alias("v")).na.drop(), "v", "norm", 0.0, 1.0).first()
        for test, stat, p in (("dagostino", k2, dist.chi2_sf(k2, 2)), ("kolmogorov_smirnov", ks["statistic"], ks["pValue"])):
            rows.append({"column": c, "test": test, "statistic": float(stat), "p_value": float(p), "is_normal": bool(p > alpha)})
    return df.sparkSession.createDataFrame(pd.DataFrame(rows))


def dagostino(n, g1, g2):
    """K-squared from the population skewness and excess kurtosis of n values."""
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b2 - 1)) - 1
    delta, alpha = 1 / math.sqrt(0.5 * math.log(w2)), math.sqrt(2 / (w2 - 1))
    z1 = delta * math.asinh(y / alpha)
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (g2 + 3 - mean) / math.sqrt(var)
    sb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / sb * (2 / sb + math.sqrt(1 + 4 / sb**2))
    denom = 1 + x * math.sqrt(2 / (a - 4))
    z2 = (1 - 2 / (9 * a) - math.copysign(abs((1 - 2 / a) / denom) ** (1 / 3), denom)) / math.sqrt(2 / (9 * a))
    return z1 * z1 + z2 * z2


def vif(df: DataFrame, columns=None):
    """Variance inflation of every column given the others, without an intercept."""
    cols = numeric_or(df, columns)
    classes, scatter = batches.class_statistics(df, cols, full=True)
    n, mean = batches.overall(classes, len(cols))
    gram, k = scatter + n * np.outer(mean, mean), len(cols)
    inv = np.linalg.inv(gram)
    return df.sparkSession.createDataFrame(pd.DataFrame({"column": cols, "vif": [float(gram[i, i] * inv[i, i]) for i in range(k)]}))


def quantile_bins(df: DataFrame, columns, bins=10):
    """Column expressions that bin values by their quantile edges (equal values share a bin)."""
    q = column_quantiles(df, columns, [i / bins for i in range(1, bins)])
    out = {}
    for c in columns:
        v, index = number(c), F.lit(0)
        for e in sorted({x for x in q[c] if x is not None}):
            index = index + F.when(v > F.lit(e), 1).otherwise(0)
        out[c] = F.when(v.isNotNull(), index)
    return out


def mutual_information(df: DataFrame, columns, target, bins=10, task="classification"):
    """Mutual information (nats) of quantile-binned columns with the target, in one aggregate."""
    cols = list(columns)
    binned = quantile_bins(df, cols + ([target] if task == "regression" else []), bins)
    y = binned[target] if task == "regression" else F.col(target)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), binned[c].alias("x")) for c in cols])
    long = df.select(y.cast("string").alias("y"), F.explode(pairs).alias("p")).select("p.column", "p.x", "y").na.drop()
    cells = keep(long.groupBy("column", "x", "y").agg(F.count("*").alias("n")), "cells")
    px = cells.groupBy("column", "x").agg(F.sum("n").alias("nx"))
    py = cells.groupBy("column", "y").agg(F.sum("n").alias("ny"))
    t = cells.groupBy("column").agg(F.sum("n").alias("t"))
    j = cells.join(px, ["column", "x"]).join(py, ["column", "y"]).join(t, "column")
    n, tt = F.col("n").cast("double"), F.col("t")
    return j.groupBy("column").agg(F.greatest(F.lit(0.0), F.sum(n / tt * F.ln(n * tt / (F.col("nx").cast("double") * F.col("ny"))))).alias("score"))
