"""Cross-validation, learning curves and parameter search on exact folds."""

import json
import math
import random
from concurrent.futures import ThreadPoolExecutor
from itertools import product
from statistics import fmean, pstdev

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.models import evaluate, kind_of, train_model
from millrace.operators.split import assign_folds, fold_parts, time_series_folds
from millrace.plans.quota import order_hash, training_cuts

_SCORES = {"classifier": ("accuracy", "precision", "recall", "f1"), "regressor": ("r2", "mse", "rmse", "mae", "median_ae", "explained_variance")}


def _folded(df, target, features, key, folds, stratify, time_order, seed):
    """The rows with their fold, keys included."""
    keys = [key] if isinstance(key, str) else list(key)
    narrow = df.select(*dict.fromkeys([*keys, *(c.lstrip("-") for c in time_order or ()), target, *features]))
    if time_order:
        return time_series_folds(narrow, time_order, folds, "fold")
    return assign_folds(narrow, keys, folds, target if stratify else None, seed)


def _run(jobs, parallelism):
    with ThreadPoolExecutor(parallelism) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(j)) for j in jobs]]


def fold_table(df, target, features, key, folds=5, stratify=False, time_order=None, seed=42):
    """Target, features and fold of every row, for the ``table`` of fold_scores and cross_validate."""
    return _folded(df, target, list(features), key, folds, stratify, time_order, seed).select(*dict.fromkeys([target, *features]), "fold")


def _one_fold(table, i, target, features, algorithm, params, time_series, with_train=True, names=None):
    train, test = fold_parts(table, i, "fold", time_series)
    model = train_model(train, target, features, algorithm, **params)
    names = names or _SCORES[model.kind]
    part = lambda d: {n: evaluate_row[n] for evaluate_row in [evaluate(model, d, names).first().asDict()] for n in names}
    return {"test": part(test), "train": part(train) if with_train else {}}


def fold_scores(df, target, features, algorithm, key, folds=5, stratify=False, time_order=None, seed=42, parallelism=4, params=None, with_train=True, names=None, table=None):
    """Scores of every fold, fitted concurrently on one cached table: all, or those in ``names``.

    ``table`` is a stored fold_table of the caller, where several sets of features share the folds.
    """
    own = fold_table(df, target, features, key, folds, stratify, time_order, seed).persist() if table is None else None
    try:
        held = table if own is None else own
        jobs = [lambda i=i: _one_fold(held, i, target, list(features), algorithm, params or {}, bool(time_order), with_train, names) for i in range(folds)]
        return _run(jobs, parallelism)
    finally:
        if own is not None:
            own.unpersist()


def cross_validation_table(df: DataFrame, target, features, algorithm, key, folds=5, **kw):
    """Rows (metric, train/test mean, std, min, max)."""
    results = fold_scores(df, target, features, algorithm, key, folds, **kw)
    rows = []
    for m in _SCORES[kind_of(algorithm)]:
        row = {"metric": m}
        for side in ("train", "test"):
            v = [float(r[side][m]) for r in results]
            row.update({f"{side}_mean": fmean(v), f"{side}_std": pstdev(v), f"{side}_min": min(v), f"{side}_max": max(v)})
        rows.append(row)
    return df.sparkSession.createDataFrame(pd.DataFrame(rows))


def cross_validate(df: DataFrame, target, features, algorithm, key, folds=5, metric=None, **kw):
    """{'mean_test', 'std_test', 'scores'} of one metric (default accuracy or r2)."""
    metric = metric or _SCORES[kind_of(algorithm)][0]
    v = [float(r["test"][metric]) for r in fold_scores(df, target, features, algorithm, key, folds, with_train=False, names=(metric,), **kw)]
    sign = -1 if metric in ("mse", "rmse", "mae", "median_ae") else 1
    return {"mean_test": sign * fmean(v), "std_test": pstdev(v), "scores": v}


def learning_curve(df: DataFrame, target, features, algorithm, key, sizes=(0.1, 0.325, 0.55, 0.775, 1.0), folds=3, metric=None, seed=42, params=None, parallelism=4):
    """Rows (fraction, n_train, train and test mean and std) for growing shares of the training rows."""
    keys = [key] if isinstance(key, str) else list(key)
    metric = metric or _SCORES[kind_of(algorithm)][0]
    table = _folded(df, target, list(features), key, folds, False, None, seed).withColumn("_order", order_hash(keys, seed + 1))
    table = table.select(*dict.fromkeys([target, *features]), "fold", "_order").persist()

    def job(i, share):
        train, test = fold_parts(table, i)
        some = train.where(F.col("_order") <= F.lit(cuts.get((i, float(share)))).cast("long")).drop("_order")
        model = train_model(some, target, list(features), algorithm, **(params or {}))
        score = lambda part: float(evaluate(model, part, (metric,)).first()[metric])
        return share, model.metadata["n"], score(some), score(test)

    try:
        cuts = training_cuts(table, sizes)
        done = _run([lambda i=i, s=s: job(i, s) for s in sizes for i in range(folds)], parallelism)
    finally:
        table.unpersist()
    rows = []
    for s in sizes:
        part = [d for d in done if d[0] == s]
        tr, te = [d[2] for d in part], [d[3] for d in part]
        rows.append({"fraction": float(s), "n_train": int(fmean(d[1] for d in part)), "train_mean": fmean(tr), "train_std": pstdev(tr), "test_mean": fmean(te), "test_std": pstdev(te)})
    return df.sparkSession.createDataFrame(pd.DataFrame(rows))


def _search(df, target, features, algorithm, key, candidates, folds, metric, stratify, seed, parallelism):
    metric = metric or _SCORES[kind_of(algorithm)][0]
    table = fold_table(df, target, features, key, folds, stratify, None, seed).persist()
    try:
        jobs = [
            lambda p=p, i=i: _one_fold(table, i, target, list(features), algorithm, p, False, False, (metric,))["test"][metric] for p in candidates for i in range(folds)
        ]
        flat = [float(v) for v in _run(jobs, parallelism)]
    finally:
        table.unpersist()
    sign = -1 if metric in ("mse", "rmse", "mae", "median_ae") else 1
    rows = []
    for j, p in enumerate(candidates):
        v = flat[j * folds : (j + 1) * folds]
        rows.append({"params": json.dumps(p, sort_keys=True), "mean_score": fmean(v), "std_score": pstdev(v), "_o": -sign * fmean(v)})
    rows.sort(key=lambda r: r["_o"])
    for rank, r in enumerate(rows, 1):
        r["rank"] = rank
        del r["_o"]
    return rows


def grid_search(df: DataFrame, target, features, algorithm, key, grid, folds=5, metric=None, stratify=False, seed=42, parallelism=4):
    """Table (params, mean_score, std_score, rank) over all combinations of ``grid``."""
    candidates = [dict(zip(grid, v)) for v in product(*grid.values())]
    rows = _search(df, target, features, algorithm, key, candidates, folds, metric, stratify, seed, parallelism)
    return df.sparkSession.createDataFrame(pd.DataFrame(rows))


def draw_candidates(space, n_iter, seed=42):
    """``n_iter`` different seeded draws, or all there are: lists are choices, (low, high) tuples are ranges of their own type."""
    rng, out, size = random.Random(seed), [], 1
    ints = {name: isinstance(v, tuple) and all(isinstance(x, int) for x in v) for name, v in space.items()}
    for name, v in space.items():
        distinct = v[1] - v[0] + 1 if ints[name] else v[0] == v[1] or math.inf if isinstance(v, tuple) else sum(x not in v[:i] for i, x in enumerate(v))
        size *= distinct
    if 2 * n_iter > size:  # drawing would meet the same ones again and again
        every = [list(range(v[0], v[1] + 1)) if ints[n] else v[:1] if isinstance(v, tuple) else [x for i, x in enumerate(v) if x not in v[:i]] for n, v in space.items()]
        held = [dict(zip(space, p)) for p in product(*every)]
        return rng.sample(held, min(n_iter, len(held)))
    while len(out) < n_iter:
        p = {}
        for name, values in space.items():
            if isinstance(values, tuple):
                lo, hi = values
                p[name] = rng.randint(lo, hi) if ints[name] else rng.uniform(lo, hi)
            else:
                p[name] = rng.choice(values)
        if p not in out:
            out.append(p)
    return out


def random_search(df: DataFrame, target, features, algorithm, key, space, n_iter=10, folds=5, metric=None, stratify=False, seed=42, parallelism=4):
    rows = _search(df, target, features, algorithm, key, draw_candidates(space, n_iter, seed), folds, metric, stratify, seed, parallelism)
    return df.sparkSession.createDataFrame(pd.DataFrame(rows))


def nested_cross_validation(df: DataFrame, target, features, algorithm, key, grid, outer=3, inner=3, metric=None, seed=42, parallelism=4):
    """Rows (fold, best_params, inner_score, outer_score): search inside every outer training part."""
    metric = metric or _SCORES[kind_of(algorithm)][0]
    candidates = [dict(zip(grid, v)) for v in product(*grid.values())]
    table = _folded(df, target, list(features), key, outer, False, None, seed).withColumnRenamed("fold", "_outer").persist()
    rows = []
    try:
        for i in range(outer):
            train, test = fold_parts(table, i, "_outer")
            best = _search(train, target, features, algorithm, key, candidates, inner, metric, False, seed + 1, parallelism)[0]
            model = train_model(train, target, list(features), algorithm, **json.loads(best["params"]))
            rows.append({"fold": i, "best_params": best["params"], "inner_score": best["mean_score"], "outer_score": float(evaluate(model, test).first()[metric])})
    finally:
        table.unpersist()
    return df.sparkSession.createDataFrame(pd.DataFrame(rows))


def save_results(results: DataFrame, path):
    results.write.mode("overwrite").parquet(path)
