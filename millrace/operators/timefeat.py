"""Row-ordered features: rolling windows, lags, differences, trend, autocorrelation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.ordered import with_frames
from millrace.plans.quantiles import number

_ROLL = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev, "var": F.variance}
_ROLL_POP = {
    **_ROLL, "std": F.stddev_pop, "var": F.var_pop, "skew": F.skewness, "kurt": F.kurtosis,
    "median": lambda v: F.percentile(v, F.lit(0.5)),
}


def rolling_features(df: DataFrame, columns, order_by, windows=(1, 3, 7, 14, 30), functions=("mean", "std", "min", "max"),
                     partition_by=(), population=False):
    """``<column>_<w>_<function>`` over the last w rows (fewer at the start).

    ``population`` gives the moments with divisor n, and sum, median, count, skew and kurt, under
    ``<column>_window_<w>_<function>``.
    """
    table = _ROLL_POP if population else _ROLL
    name = (lambda c, w, f: f"{c}_window_{w}_{f}") if population else (lambda c, w, f: f"{c}_{w}_{f}")

    def build(d, base):
        new = []
        for w in windows:
            frame = base.rowsBetween(-(w - 1), 0)
            new += [table[f](number(c)).over(frame).alias(name(c, w, f)) for c in columns for f in functions]
        return d.select("*", *new)

    return with_frames(df, build, order_by, partition_by, before=max(windows) - 1)


def lag_features(df: DataFrame, columns, order_by, lags=(1, 2, 3, 7), partition_by=()):
    build = lambda d, w: d.select("*", *[F.lag(c, k).over(w).alias(f"{c}_lag_{k}") for k in lags for c in columns])
    return with_frames(df, build, order_by, partition_by, before=max(lags))


def diff_features(df: DataFrame, columns, order_by, diffs=(1, 2, 3, 7), partition_by=()):
    """Difference and relative change against the row ``k`` places earlier in the same group."""

    def build(d, w):
        new = []
        for k in diffs:
            for c in columns:
                earlier = F.lag(number(c), k).over(w)
                new += [
                    (number(c) - earlier).alias(f"{c}_diff_{k}"),
                    (F.try_divide(number(c), earlier) - 1).alias(f"{c}_pct_change_{k}"),
                ]
        return d.select("*", *new)

    return with_frames(df, build, order_by, partition_by, before=max(diffs))


def trend(df: DataFrame, column, order_by, window=7, partition_by=(), name="trend"):
    """Rolling mean over full windows only."""

    def build(d, w):
        frame = w.rowsBetween(-(window - 1), 0)
        full = F.count(number(column)).over(frame) == window
        return d.withColumn(name, F.when(full, F.avg(number(column)).over(frame)))

    return with_frames(df, build, order_by, partition_by, before=window - 1)


def autocorrelation(df: DataFrame, column, order_by, max_lag=None):
    """Rows (lag, autocorrelation) of a series for lags 1..max_lag (default min(50, n/5))."""
    base = df.agg(F.count(number(column)).alias("n"), F.avg(number(column)).alias("m")).first()
    n = base["n"]
    top = min(50, n // 5) if max_lag is None else max_lag
    dev = df.where(number(column).isNotNull()).withColumn("_dev", number(column) - F.lit(base["m"]))
    build = lambda d, w: d.select("*", *[F.lag("_dev", k).over(w).alias(f"l{k}") for k in range(1, top + 1)])
    needed = dev.select("_dev", *dict.fromkeys(c.lstrip("-") for c in order_by))
    lagged = with_frames(needed, build, order_by, before=top)
    row = lagged.agg(F.sum(F.col("_dev") * F.col("_dev")).alias("d"), *[F.sum(F.col("_dev") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, top + 1)])
    items = [F.struct(F.lit(k).alias("lag"), (F.col(f"s{k}") / F.col("d")).alias("autocorrelation")) for k in range(1, top + 1)]
    return row.select(F.inline(F.array(*items)))
