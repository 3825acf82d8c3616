"""Chart-ready tables: the aggregation behind a plot, never the picture."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.corr import correlations
from millrace.operators.profile import bin_index, value_range
from millrace.operators.transform import normal_quantile
from millrace.plans.lookup import attach
from millrace.plans.ordered import prefix_sum
from millrace.plans.quantiles import exact_quantiles, number
from millrace.plans.sizing import keep


def ecdf(df: DataFrame, column):
    """Share of values <= each distinct value."""
    counts = df.select(number(column).alias("value")).na.drop().groupBy("value").agg(F.count("*").alias("n"))
    return prefix_sum(counts, F.col("n"), ["value"]).select("value", ((F.col("_before") + F.col("n")) / F.col("_total")).alias("share"))


#: Bandwidths beyond which a kernel is nothing in double precision beside its peak (e^-40), and group grids a task holds.
KERNEL_REACH, HELD_GRIDS = 9.0, 4096


def _kernel_sums(code, v, h, lo, step, points, groups):
    """Sums over the values of exp(-z*z/2) at the grid points within KERNEL_REACH bandwidths, (groups, points)."""
    out = np.zeros(groups * points)
    near, reach = np.rint((v - lo) / step).astype(np.int64), np.minimum(np.ceil(KERNEL_REACH * h / step) + 1, points).astype(np.int64)
    for width in np.unique(reach):
        some = np.flatnonzero(reach == width)
        offsets = np.arange(-width, width + 1) if 2 * width + 1 < points else None
        for s in range(0, len(some), 4096):
            at = some[s : s + 4096]
            grid = np.arange(points)[None, :] if offsets is None else near[at][:, None] + offsets[None, :]
            grid = np.broadcast_to(grid, (len(at), grid.shape[1]))
            z = (lo + grid * step - v[at][:, None]) / h[at][:, None]
            inside = (grid >= 0) & (grid < points)
            out += np.bincount((code[at][:, None] * points + grid)[inside], weights=np.exp(-0.5 * z * z)[inside], minlength=len(out))
    return out.reshape(groups, points)


def density(df: DataFrame, column, points=200, group_by=()):
    """Gaussian kernel density on a grid, Scott bandwidth, from every value.

    A task adds up, for every group it meets, what its values give to the grid points within reach of their
    kernels; only these sums are shuffled. Groups without spread, or of one value, have no density (NULL).
    """
    groups = list(group_by)
    lo, hi = value_range(df, [column])[column]
    v = number(column)
    stats = keep(df.where(v.isNotNull()).groupBy(*groups).agg(F.count(v).alias("_N"), F.stddev(v).alias("_sd")), "stats")
    h = F.col("_sd") * F.pow(F.col("_N").cast("double"), F.lit(-0.2))
    # A group goes by a number, whatever the types of its keys.
    stats = keep(stats.withColumns({"_g": F.monotonically_increasing_id(), "_h": h}), "stats")
    held = df.where(v.isNotNull()).select(*groups, v.alias("_v"))
    held = attach(held, stats, groups, ["_g", "_h"], weight="_N") if groups else held.crossJoin(F.broadcast(stats.select("_g", "_h")))
    spark = df.sparkSession
    if lo is None:
        return stats.select(*groups, F.lit(0).alias("point"), F.lit(0.0).alias("x"), F.lit(0.0).alias("density")).limit(0)
    step = (hi - lo) / (points - 1) or 1.0

    def run(batches):
        names, sums = {}, []

        def passed_on():
            code = np.repeat(np.array(list(names), np.int64), points)
            out = pa.record_batch({"_g": pa.array(code), "point": pa.array(np.tile(np.arange(points, dtype=np.int32), len(names))), "s": pa.array(np.concatenate(sums))})
            names.clear()
            sums.clear()
            return out

        for b in batches:
            g, value, width = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            present, code = np.unique(g, return_inverse=True)
            for start in range(0, len(present), HELD_GRIDS):
                here = (code >= start) & (code < start + HELD_GRIDS)
                some = present[start : start + HELD_GRIDS]
                got = _kernel_sums(code[here] - start, value[here], width[here], lo, step, points, len(some))
                for name, row in zip(some.tolist(), got, strict=True):
                    if name not in names:
                        names[name] = len(sums)
                        sums.append(np.zeros(points))
                    sums[names[name]] += row
                if len(names) > HELD_GRIDS:
                    yield passed_on()
        if names:
            yield passed_on()

    some = held.where(F.col("_h") > 0).select("_g", "_v", "_h").mapInArrow(run, "_g long, point int, s double")
    grid = spark.range(points).select(F.col("id").cast("int").alias("point"))
    sums = stats.crossJoin(F.broadcast(grid)).join(some.groupBy("_g", "point").agg(F.sum("s").alias("_s")), ["_g", "point"], "left")
    value = F.when(F.col("_h") > 0, F.coalesce("_s", F.lit(0.0)) / (F.col("_N") * F.col("_h") * math.sqrt(2 * math.pi)))
    return sums.select(*groups, "point", (F.lit(lo) + F.col("point") * F.lit(step)).alias("x"), value.alias("density"))


def box_plot(df: DataFrame, column, group_by=None, whisker=1.5):
    """Quartiles, whiskers at the most extreme points inside the fences, and the outlier count."""
    groups = [group_by] if isinstance(group_by, str) else list(group_by or [])
    one = df if groups else df.withColumn("_all", F.lit(1))
    keys = groups or ["_all"]
    one = one.where(number(column).isNotNull() & ~F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))).select(*keys, number(column).alias(column))
    q = exact_quantiles(one, [column], [0.25, 0.5, 0.75], keys).select(
        *keys, *[F.get(column, i).alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    q = keep(q.join(one.groupBy(*keys).agg(F.count("*").alias("_n")), keys), "quartiles")
    v = F.col(column)
    lo, hi = F.col("q1") - whisker * (F.col("q3") - F.col("q1")), F.col("q3") + whisker * (F.col("q3") - F.col("q1"))
    inside = F.when((v >= lo) & (v <= hi), v)
    out = attach(one, q, keys, ["q1", "median", "q3"], weight="_n").groupBy(*keys).agg(
        F.count("*").alias("count"), F.min(inside).alias("low_whisker"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"), F.max(inside).alias("high_whisker"), F.count(F.when((v < lo) | (v > hi), 1)).alias("outliers"))
    return out if groups else out.drop("_all")


def count_plot(df: DataFrame, x, hue=None):
    keys = [x] + ([hue] if hue else [])
    return df.na.drop(subset=keys).groupBy(*keys).agg(F.count("*").alias("count"))


def bar_means(df: DataFrame, x, y, hue=None):
    keys = [x] + ([hue] if hue else [])
    return df.na.drop(subset=keys).groupBy(*keys).agg(F.avg(number(y)).alias("mean"), F.count(number(y)).alias("count"))


def correlation_cells(df: DataFrame, columns=None, method="pearson"):
    """Lower triangle of the correlation matrix in long form."""
    return correlations(df, columns, method).select(F.col("column_2").alias("row"), F.col("column_1").alias("column"), "correlation")


def qq_points(df: DataFrame, column):
    """Distinct values with the normal quantile of their middle rank (Filliben plotting positions)."""
    counts = df.select(number(column).alias("value")).na.drop().groupBy("value").agg(F.count("*").alias("n"))
    ranked = prefix_sum(counts, F.col("n"), ["value"])
    total, rank = F.col("_total"), F.col("_before") + (F.col("n") + 1) / 2
    last = F.pow(F.lit(0.5), 1.0 / total)
    p = F.when(rank == total, last).when(rank == 1, 1 - last).otherwise((rank - 0.3175) / (total + 0.365))
    return ranked.select("value", "n", p.alias("p")).select("value", "n", normal_quantile(F.col("p")).alias("theoretical"))


def qq_fit(points: DataFrame):
    """Slope, intercept and r of the weighted line through Q-Q points."""
    w, x, y = F.col("n"), F.col("theoretical"), F.col("value")
    row = points.agg(F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"), F.sum(w * x * y).alias("xy"))
    sxx = F.col("xx") - F.col("x") * F.col("x") / F.col("w")
    syy = F.col("yy") - F.col("y") * F.col("y") / F.col("w")
    sxy = F.col("xy") - F.col("x") * F.col("y") / F.col("w")
    return row.select((sxy / sxx).alias("slope"), ((F.col("y") - sxy / sxx * F.col("x")) / F.col("w")).alias("intercept"), (sxy / F.sqrt(sxx * syy)).alias("r"))


def violin(df: DataFrame, column, group_by, points=200):
    """Density per group and the box plot numbers of the same groups."""
    groups = [group_by] if isinstance(group_by, str) else list(group_by)
    return density(df, column, points, group_by=groups), box_plot(df, column, groups)


def melt_series(df: DataFrame, ids, values, variable="variable", value="value"):
    return df.unpivot(list(ids), list(values), variable, value)


def residual_scatter(df: DataFrame, actual, predicted):
    """Summary of the residual-against-prediction scatter: spread, mean and its trend line."""
    r, p = number(actual) - number(predicted), number(predicted)
    return df.agg(
        F.count(r).alias("count"), F.avg(r).alias("mean_residual"), F.stddev(r).alias("std_residual"), F.corr(r, p).alias("correlation"),
        F.regr_slope(r, p).alias("slope"), F.regr_intercept(r, p).alias("intercept"))


def pie_shares(df: DataFrame, column, value=None):
    known = df.where(F.col(column).isNotNull())
    parts = known.groupBy(column).agg((F.sum(number(value)) if value else F.count("*").cast("double")).alias("total"))
    everything = parts.agg(F.sum("total")).first()[0]
    return parts.withColumn("share", F.col("total") / F.lit(everything))


def scatter_bins(df: DataFrame, x, y, bins=20):
    """Counts on a bins x bins grid of two columns (occupied cells only)."""
    ranges = value_range(df.na.drop(subset=[x, y]), [x, y])
    cell = lambda c: bin_index(number(c), ranges[c][0], (ranges[c][1] - ranges[c][0]) / bins, bins)
    both = df.where(number(x).isNotNull() & number(y).isNotNull())
    return both.groupBy(cell(x).alias("x_bin"), cell(y).alias("y_bin")).agg(F.count("*").alias("count"), F.avg(number(x)).alias("x_mean"), F.avg(number(y)).alias("y_mean"))
