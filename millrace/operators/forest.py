"""Isolation forest: small hash-sampled trees, grown per group, applied in batches."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.batches import rows_of
from millrace.plans.quantiles import column_quantiles, number
from millrace.plans.sizing import freeze

SAMPLE = 256
#: Rows that are led through the trees together.
CHUNK = 8192


def expected_depth(n):
    """Mean path length of an unsuccessful search in a binary tree of n items."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow(x, rng, limit):
    """Random splits down to ``limit``: rows (feature, threshold, left, right, depth value)."""
    nodes = []

    def split(rows, depth):
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + expected_depth(len(rows))])
        if depth >= limit or len(rows) <= 1:
            return at
        lo, hi = x[rows].min(0), x[rows].max(0)
        open_ = np.flatnonzero(hi > lo)
        if not len(open_):
            return at
        f = int(rng.choice(open_))
        t = float(rng.uniform(lo[f], hi[f]))
        below = x[rows, f] < t
        left, right = split(rows[below], depth + 1), split(rows[~below], depth + 1)
        nodes[at][:4] = [f, t, left, right]
        return at

    split(np.arange(len(x)), 0)
    return nodes


def complete(nodes, levels):
    """A tree as arrays (feature, threshold, depth value) of a complete one: node i has the children 2i + 1 and 2i + 2.

    A leaf above the last level is continued by nodes that all have its value, so no child has to be looked up.
    """
    size = 2 ** (levels + 1) - 1
    feature, threshold, depth = np.zeros(size, np.intp), np.full(size, np.inf), np.zeros(size)

    def fill(at, node, level):
        f, t, left, right, depth[at] = nodes[node]
        if f >= 0:
            feature[at], threshold[at] = int(f), t
        if level < levels:
            fill(2 * at + 1, int(left) if f >= 0 else node, level + 1)
            fill(2 * at + 2, int(right) if f >= 0 else node, level + 1)

    fill(0, 0, 0)
    return feature, threshold, depth


def path_lengths(trees, levels, x):
    """Sum over complete trees of the depth values that the rows of a matrix reach; CHUNK rows pass a tree at a time."""
    total = np.empty(len(x))
    for s in range(0, len(x), CHUNK):
        part = np.ascontiguousarray(x[s : s + CHUNK].T)
        n, flat = part.shape[1], part.ravel()
        rows, held = np.arange(n), np.empty((len(trees), n))
        at, place, value, cut = np.empty(n, np.intp), np.empty(n, np.intp), np.empty(n), np.empty(n)
        for k, (feature, threshold, depth) in enumerate(trees):
            begin = feature * n
            at[:] = 0
            for _ in range(levels):
                np.take(begin, at, out=place, mode="clip")
                place += rows
                np.take(flat, place, out=value, mode="clip")
                np.take(threshold, at, out=cut, mode="clip")
                at *= 2
                at += 2
                at -= value < cut
            np.take(depth, at, out=held[k], mode="clip")
        total[s : s + n] = np.ascontiguousarray(held.T).sum(1)
    return total


def isolation_forest(df: DataFrame, columns, contamination="auto", n_trees=100, seed=42, name="outlier", score="anomaly_score"):
    """Anomaly score in (0, 1) and a flag: above 0.5, or the top ``contamination`` share. NULLs count as the mean."""
    cols = list(columns)
    means = df.agg(F.count("*").alias("_n"), *[F.avg(number(c)).alias(c) for c in cols]).first()
    n = means["_n"]
    filled = df.select(*[F.coalesce(number(c), F.lit(means[c])).alias(c) for c in cols])
    unit = lambda *k: F.pmod(F.xxhash64(*k), F.lit(2**40)) / F.lit(float(2**40))
    # The row id only keeps copies of a row apart; any id gives a valid random sample.
    # A bounded candidate sample, then about twice SAMPLE rows per tree, then exactly SAMPLE.
    pool = min(float(n), 8.0 * SAMPLE * n_trees)
    base = filled.withColumn("_copy", F.monotonically_increasing_id()).where(unit(F.lit(seed), F.col("_copy"), *cols) < F.lit(min(1.0, pool / max(n, 1))))
    trees = base.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))).withColumn("u", unit(F.lit(seed + 1), F.col("tree"), F.col("_copy"), *cols))
    trees = trees.where(F.col("u") < F.lit(min(1.0, 2.0 * SAMPLE / max(pool, 1.0))))
    picked = trees.withColumn("_r", F.row_number().over(Window.partitionBy("tree").orderBy("u", *cols))).where(F.col("_r") <= SAMPLE)

    def fit(pdf):
        x = pdf.sort_values("_r")[cols].to_numpy(float)
        tree = int(pdf["tree"].iloc[0])
        nodes = grow(x, np.random.default_rng(seed * 1_000_003 + tree), max(1, math.ceil(math.log2(max(2, len(x))))))
        return pd.DataFrame([[tree, len(x), i, *node] for i, node in enumerate(nodes)], columns=["tree", "size", "node", "f", "t", "l", "r", "d"])

    grown = picked.select("tree", "_r", *cols).groupBy("tree").applyInPandas(fit, "tree int, size int, node int, f int, t double, l int, r int, d double").toPandas()
    forest = [g.sort_values("node")[["f", "t", "l", "r", "d"]].to_numpy(float) for _, g in grown.groupby("tree")]
    typical = expected_depth(int(grown.groupby("tree")["size"].first().mean())) or 1.0
    levels = int(math.ceil(math.log2(SAMPLE)))
    shared = df.sparkSession.sparkContext.broadcast([complete(t, levels) for t in forest])
    schema = T.StructType([*df.schema.fields, T.StructField(score, T.DoubleType())])
    centre = [float("nan") if means[c] is None else means[c] for c in cols]
    rows = df.select("*", F.array(*[F.coalesce(number(c), F.lit(m)) for c, m in zip(cols, centre)]).alias("_x"))

    def apply(batches):
        trees = shared.value
        for b in batches:
            total = path_lengths(trees, levels, rows_of(b.column(b.num_columns - 1), len(cols)))
            yield pa.record_batch([*b.columns[:-1], pa.array(2.0 ** (-total / len(trees) / typical))], names=schema.names)

    scored = rows.mapInArrow(apply, schema)
    if contamination == "auto":
        cut = 0.5
    else:
        # The scores are read twice, for the cut and for the flags.
        scored = freeze(scored, "scores")
        cut = column_quantiles(scored, [score], [1 - contamination])[score][0]
    return scored.withColumn(name, F.col(score) > F.lit(cut))
