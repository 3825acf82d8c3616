"""Correlations: pearson, spearman, kendall; strong pairs; correlation with a target."""

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.columns import numeric_or
from millrace.plans.lookup import attach
from millrace.plans.ordered import number_rows, prefix_sum
from millrace.plans.quantiles import number
from millrace.plans.sizing import keep

_PAIRS_PER_JOB = 200


def average_ranks(df: DataFrame, column):
    """One row per distinct value: its count and the mean rank of its copies."""
    counts = df.select(number(column).alias("_value")).na.drop().groupBy("_value").agg(F.count("*").alias("_n"))
    return prefix_sum(counts, F.col("_n"), ["_value"]).select("_value", "_n", (F.col("_before") + (F.col("_n") + 1) / 2).alias("_rank"))


def _pearson(df, pairs):
    parts = []
    for i in range(0, len(pairs), _PAIRS_PER_JOB):
        some = pairs[i : i + _PAIRS_PER_JOB]
        wide = df.agg(*[F.corr(number(a), number(b)).alias(f"_{j}") for j, (a, b) in enumerate(some)])
        rows = [F.struct(F.lit(a).alias("column_1"), F.lit(b).alias("column_2"), F.col(f"_{j}").alias("correlation")) for j, (a, b) in enumerate(some)]
        parts.append(wide.select(F.inline(F.array(*rows))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grid_counts(df: DataFrame, a, b):
    """Counts of the distinct complete (x, y) pairs."""
    return df.select(number(a).alias("x"), number(b).alias("y")).na.drop().groupBy("x", "y").agg(F.count("*").alias("n"))


def _spearman_pair(df, a, b):
    grid = grid_counts(df, a, b)
    for side in ("x", "y"):
        totals = grid.groupBy(side).agg(F.sum("n").alias("w"))
        # Ranks less their mean: exact halves, while sums of plain ranks' squares pass 64 bits from some 2 million rows on.
        ranks = prefix_sum(totals, F.col("w"), [side]).select(side, "w", (F.col("_before") + (F.col("w") - F.col("_total")) / 2).alias(f"r{side}"))
        grid = attach(grid, keep(ranks, "ranks"), [side], [f"r{side}"], weight="w")
    w, x, y = F.col("n"), F.col("rx"), F.col("ry")
    return grid.agg(F.try_divide(F.sum(w * x * y), F.sqrt(F.sum(w * x * x)) * F.sqrt(F.sum(w * y * y))).alias("correlation"))


def _kendall_pair(df, a, b):
    """Tau-b without comparing all pairs.

    Concordant pairs are counted bit by bit of the dense x rank: at every bit, rows that share the
    higher bits are split into a lower and an upper half, and a prefix sum over y counts for each
    upper row the lower rows with a smaller y.
    """
    grid = keep(grid_counts(df, a, b), "grid")
    xs = number_rows(grid.groupBy("x").agg(F.sum("n").alias("w")), ["x"], name="rx").withColumn("rx", F.col("rx") - 1)
    xs = keep(xs, "xranks")
    top = xs.agg(F.max("rx")).first()[0]
    ranked = attach(grid, xs, ["x"], ["rx"], weight="w")
    bits = max(1, int(top or 0).bit_length())
    level = ranked.select("y", "n", "rx", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    shifted = F.expr("shiftright(rx, bit)")
    halves = level.select("y", "n", "bit", F.shiftright(shifted, 1).alias("block"), (shifted % 2).alias("upper"))
    by_y = halves.groupBy("bit", "block", "y").agg(
        F.coalesce(F.sum(F.when(F.col("upper") == 0, F.col("n"))), F.lit(0)).alias("low"),
        F.coalesce(F.sum(F.when(F.col("upper") == 1, F.col("n"))), F.lit(0)).alias("high"),
    )
    concordant = prefix_sum(by_y, F.col("low"), ["y"], ["bit", "block"]).agg(F.sum(F.col("high").cast("double") * F.col("_before")).alias("c")).first()["c"]
    ties = lambda t, w: t.agg(F.sum(F.col(w).cast("double") * (F.col(w) - 1) / 2)).first()[0] or 0.0
    n = grid.agg(F.sum("n")).first()[0] or 0
    all_pairs = n * (n - 1) / 2
    tx, txy = ties(xs, "w"), ties(grid, "n")
    ty = ties(grid.groupBy("y").agg(F.sum("n").alias("w")), "w")
    discordant = all_pairs - (concordant or 0.0) - tx - ty + txy
    scale = ((all_pairs - tx) * (all_pairs - ty)) ** 0.5
    return ((concordant or 0.0) - discordant) / scale if scale else None


def _rank_pairs(df, pairs, method):
    spark = df.sparkSession
    out = None
    for a, b in pairs:
        if method == "spearman":
            one = _spearman_pair(df, a, b)
        else:
            tau = _kendall_pair(df, a, b)
            one = spark.range(1).select(F.lit(tau).cast("double").alias("correlation"))
        one = one.select(F.lit(a).alias("column_1"), F.lit(b).alias("column_2"), "correlation")
        out = one if out is None else out.unionByName(one)
    return out


def correlations(df: DataFrame, columns=None, method="pearson"):
    """Long table (column_1, column_2, correlation) of the pairwise complete correlations."""
    pairs = list(combinations(numeric_or(df, columns), 2))
    if method == "pearson":
        return _pearson(df, pairs)
    if method in ("spearman", "kendall"):
        return _rank_pairs(df, pairs, method)
    if method == "all":
        parts = [correlations(df, columns, m).withColumn("method", F.lit(m)) for m in ("pearson", "spearman", "kendall")]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])
    raise ValueError(f"unknown correlation {method}")


def strong_pairs(df: DataFrame, columns=None, method="pearson", threshold=0.7):
    return correlations(df, columns, method).where(F.abs("correlation") >= threshold).orderBy(F.desc("correlation"))


def target_correlations(df: DataFrame, target, columns=None, method="pearson"):
    """(column, correlation) with the target, highest first."""
    cols = [c for c in numeric_or(df, columns) if c != target]
    pairs = [(c, target) for c in cols]
    table = _pearson(df, pairs) if method == "pearson" else _rank_pairs(df, pairs, method)
    return table.select(F.col("column_1").alias("column"), "correlation").orderBy(F.desc("correlation"), "column")


def trend_line(df: DataFrame, x, y):
    """Slope, intercept and r-squared of the least-squares line."""
    a, b = number(y), number(x)
    return df.agg(F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2"))
