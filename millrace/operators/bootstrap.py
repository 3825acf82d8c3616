"""Bootstrap intervals from Poisson weights that are drawn per Arrow batch.

Every row gets a weight of its own in every replicate, a Poisson number with mean 1 from a hash of its key. A
task draws the weights of a few thousand rows as one matrix, multiplies the values with it and passes on sums
per replicate. Quantiles need more than sums: almost all replicates have theirs within a few standard errors of
the sample's, so only the values in that bracket are told apart, in at most CELLS cells, and a replicate keeps
its weight below the bracket and in each cell. With up to CELLS distinct values in the bracket this is exact.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.batches import FAN
from millrace.plans.quantiles import column_quantiles, number
from millrace.plans.sizing import freeze

#: Rows whose weights are held at once, cells of a bracket, and its reach in standard errors.
ROWS, CELLS, REACH = 2048, 512, 7.0
SUMS = ("count", "sum", "square", "denominator")


def _poisson_table():
    """The Poisson number with mean 1 of every 16-bit uniform; mean and spread are 1 to four digits."""
    cumulative, p, out = 0.0, math.exp(-1), np.zeros(65536, np.uint8)
    for k in range(1, 10):
        cumulative += p
        out[round(cumulative * 65536) :] = k
        p /= k
    return out


_POISSON = _poisson_table()


def weights(keys, replicates, seed):
    """Weights (rows, replicates) of hashed keys; four replicates share one 64-bit mix."""
    words = -(-replicates // 4)
    lane = (np.arange(words, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 20) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = keys.view(np.uint64)[:, None] + lane[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return _POISSON[x.view(np.uint16).reshape(len(keys), 4 * words)[:, :replicates]]


def _brackets(df, column, probs, n):
    """For each probability the sorted cell bounds around its quantile; a cell ends at (and holds) its bound."""
    out = {}
    for p in probs:
        reach = REACH * math.sqrt(p * (1 - p) / n) + 2.0 / n
        ends = column_quantiles(df, [column], [max(0.0, p - reach), min(1.0, p + reach)])[column]
        inside = df.where(number(column).between(*ends)).select(number(column).alias("v"))
        some = sorted(r["v"] for r in inside.distinct().limit(CELLS + 1).collect())
        if len(some) > CELLS:
            some = column_quantiles(inside, ["v"], [i / CELLS for i in range(CELLS + 1)])["v"]
        out[p] = np.unique(some)
    return out


def _quantile(p, below, cells, middle, total):
    """Interpolated quantile of every replicate from its weights below the bracket and per cell (the last one: above it)."""
    reached = below[:, None] + np.cumsum(cells, axis=1)
    at = (total - 1) * p

    def value(place):
        return middle[np.minimum((reached <= place[:, None]).sum(axis=1), len(middle) - 1)]

    low = np.floor(at)
    lo, hi = value(low), value(np.minimum(low + 1, total - 1))
    return lo + (hi - lo) * (at - low)


def bootstrap_table(df: DataFrame, column, key, n_bootstrap=1000, seed=42, denominator=None, quantiles=()):
    """The sums and quantiles of every replicate: {"count" | "sum" | "square" | "denominator" | probability: array}."""
    keys = [key] if isinstance(key, str) else list(key)
    n = df.agg(F.count(number(column))).first()[0]
    probs = sorted({float(p) for p in quantiles}) if n else []
    brackets = _brackets(df, column, probs, n) if probs else {}
    d = F.coalesce(number(denominator), F.lit(0.0)) if denominator else F.lit(1.0)
    rows = df.where(number(column).isNotNull()).select(F.xxhash64(F.lit(seed), *keys).alias("b"), number(column).alias("v"), d.alias("d"))
    sizes = [len(brackets[p]) + 2 for p in probs]
    height = len(SUMS) + sum(sizes)

    def run(batches):
        total, spread = None, [np.zeros((2, size)) for size in sizes]
        for batch in batches:
            b, v, d = (batch.column(i).to_numpy() for i in range(3))
            total = np.zeros((height, n_bootstrap)) if total is None else total
            for s in range(0, len(b), ROWS):
                some = v[s : s + ROWS]
                w = weights(b[s : s + ROWS], n_bootstrap, seed)
                as_float = w.astype(float)
                total[: len(SUMS)] += np.stack((np.ones(len(some)), some, some * some, d[s : s + ROWS])) @ as_float
                at = len(SUMS)
                for p, held, size in zip(probs, spread, sizes, strict=True):
                    # Cell 0 lies below the first bound, cell i ends at bound i - 1, the last one lies beyond.
                    bounds = brackets[p]
                    cell = np.where(some < bounds[0], 0, np.searchsorted(bounds, some) + 1)
                    order = np.argsort(cell, kind="stable")
                    present, first = np.unique(cell[order], return_index=True)
                    total[at + present] += np.add.reduceat(as_float[order], first, axis=0)
                    held += np.stack((np.bincount(cell, minlength=size), np.bincount(cell, weights=some, minlength=size)))
                    at += size
        if total is not None:
            yield pa.record_batch({"node": pa.array([TaskContext.get().partitionId()]), "total": pa.array([total.tobytes()], pa.binary()),
                                   "spread": pa.array([np.concatenate([np.zeros((2, 0)), *spread], axis=1).tobytes()], pa.binary())})

    def add(part):
        both = (sum(np.frombuffer(x, float) for x in part.column(name).to_pylist()).tobytes() for name in ("total", "spread"))
        return pa.table([part.column("node")[:1], *[pa.array([x], pa.binary()) for x in both]], names=["node", "total", "spread"])

    schema = "node long, total binary, spread binary"
    parts = freeze(rows.mapInArrow(run, schema), "replicates")
    top = parts.agg(F.max("node")).first()[0]
    if top is None:
        return {name: np.zeros(n_bootstrap) for name in SUMS} | {float(p): np.full(n_bootstrap, np.nan) for p in quantiles}
    while top:
        top //= FAN
        parts = parts.withColumn("node", F.floor(F.col("node") / FAN)).groupBy("node").applyInArrow(add, schema)
    last = parts.first()
    total = np.frombuffer(last["total"], float).reshape(height, n_bootstrap)
    spread = np.frombuffer(last["spread"], float).reshape(2, -1)
    out, at = dict(zip(SUMS, total, strict=False)), len(SUMS)
    for p, size in zip(probs, sizes, strict=True):
        seen, value = spread[:, at - len(SUMS) : at - len(SUMS) + size]
        # A cell of one distinct value stands for exactly that value.
        middle = np.where(seen > 0, value / np.maximum(seen, 1), 0.0)
        exact = np.r_[-np.inf, brackets[p], np.inf]
        middle = exact if _distinct(brackets[p], middle) else np.where(np.isfinite(exact), middle, exact)
        out[p] = _quantile(p, total[at], total[at + 1 : at + size].T, middle[1:], total[0])
        at += size
    return out


def _distinct(bounds, middle):
    """Whether every cell holds its bound alone."""
    inner = middle[1:-1]
    return bool(np.allclose(inner, bounds, rtol=1e-12, atol=0))


def _statistic(name, s):
    if callable(name):
        return name(s)
    if name == "median":
        return s[0.5]
    if not isinstance(name, str):
        return s[float(name)]
    with np.errstate(all="ignore"):
        return {"mean": lambda: s["sum"] / s["count"], "sum": lambda: s["sum"], "ratio": lambda: s["sum"] / s["denominator"],
                "std": lambda: np.sqrt((s["square"] - s["sum"] ** 2 / s["count"]) / (s["count"] - 1))}[name]()


def bootstrap_ci(df: DataFrame, column, key, statistic="mean", n_bootstrap=1000, ci=0.95, seed=42, denominator=None, quantiles=()):
    """(lower, upper, center, replicates): percentile interval of a statistic under Poisson resampling.

    ``statistic``: mean, sum, std, ratio, median, a probability (that quantile), or a function of the replicates'
    table: arrays named sum, square, denominator and count, and one per probability in ``quantiles``. Rows of
    one key share their weights. Replicates without a value (all weights 0)
    do not count in the interval; without rows there are no replicates.
    """
    wanted = list(quantiles) + ([0.5] if statistic == "median" else [] if callable(statistic) or isinstance(statistic, str) else [statistic])
    with np.errstate(all="ignore"):
        values = np.asarray(_statistic(statistic, bootstrap_table(df, column, key, n_bootstrap, seed, denominator, wanted)) if df.limit(1).count() else [], float)
    values = values[np.isfinite(values)]
    tail = (1 - ci) / 2
    lower, upper, center = (*np.quantile(values, [tail, 1 - tail]), values.mean()) if len(values) else (None, None, None)
    return df.sparkSession.createDataFrame(
        [(None if lower is None else float(lower), None if upper is None else float(upper), None if center is None else float(center), n_bootstrap if len(values) else 0)],
        "lower double, upper double, center double, replicates long")
