"""Feature selection by variance, correlation, information, test scores, models and elimination."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.columns import numeric_columns, numeric_or
from millrace.operators.corr import correlations, target_correlations
from millrace.operators.hypothesis import mutual_information
from millrace.plans.quantiles import number
from millrace.plans.sizing import freeze


def task_of(df: DataFrame, target):
    """A numeric target with more than ten distinct values is a regression target."""
    if target not in numeric_columns(df):
        return "classification"
    return "regression" if df.select(target).distinct().limit(11).count() > 10 else "classification"


def feature_list(df, columns, target=None):
    return [c for c in numeric_or(df, columns) if c != target]


def select_by_variance(df: DataFrame, columns=None, threshold=0.0):
    cols = feature_list(df, columns)
    row = df.agg(*[F.var_pop(number(c)).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if not (row[c] or 0.0) > threshold])


def correlation_drops(pairs, to_target=None, low=(), strict_compat=False):
    """Columns to drop, given (a, b, |r|) pairs: strongest pair first, the weaker partner goes.

    A pair that already lost a member costs nothing more, unless ``strict_compat`` asks that it
    loses the other one too.
    """
    gone = set(low)
    for a, b, _ in sorted((p for p in pairs if not {p[0], p[1]} & set(low)), key=lambda p: -p[2]):
        lost = {a, b} & gone
        if lost:
            if strict_compat:
                gone |= {a, b}
        elif to_target and to_target[a] < to_target[b]:
            gone.add(a)
        else:
            gone.add(b)
    return gone


def select_by_correlation(df: DataFrame, columns=None, target=None, threshold=0.8, target_threshold=None, method="pearson", strict_compat=False):
    cols = feature_list(df, columns, target)
    pairs = [(r["column_1"], r["column_2"], abs(r["correlation"])) for r in correlations(df, cols, method).where(F.abs("correlation") > threshold).collect()]
    to_target, low = None, ()
    if target:
        to_target = {r["column"]: abs(r["correlation"] or 0.0) for r in target_correlations(df, target, cols, method).collect()}
        if target_threshold is not None:
            low = [c for c in cols if to_target[c] < target_threshold]
    return df.drop(*correlation_drops(pairs, to_target, low, strict_compat))


def _keep_best(df, cols, scores, k):
    best = sorted(cols, key=lambda c: (-(scores.get(c) if scores.get(c) is not None else float("-inf")), cols.index(c)))[:k]
    return df.drop(*[c for c in cols if c not in best])


def select_by_information(df: DataFrame, target, columns=None, k=10, percentile=None, task="auto"):
    cols = feature_list(df, columns, target)
    task = task_of(df, target) if task == "auto" else task
    scores = {r["column"]: r["score"] for r in mutual_information(df, cols, target, task=task).collect()}
    n = max(1, int(len(cols) * percentile / 100)) if percentile is not None else min(k, len(cols))
    return _keep_best(df, cols, scores, n)


def feature_scores(df: DataFrame, target, columns=None, score="auto", task="auto"):
    """Table (column, score): chi2, f_classif or f_regression of every feature, each in one pass."""
    cols = feature_list(df, columns, target)
    task = task_of(df, target) if task == "auto" else task
    if score == "auto":
        if task == "regression":
            score = "f_regression"
        else:
            row = df.agg(F.least(*[F.min(c) for c in cols]) if len(cols) > 1 else F.min(cols[0])).first()
            score = "f_classif" if row[0] is not None and row[0] < 0 else "chi2"
    if score == "f_regression":
        aggs = []
        for i, c in enumerate(cols):
            both = number(c).isNotNull() & F.col(target).isNotNull()
            aggs += [F.corr(number(c), number(target)).alias(f"r{i}"), F.count(F.when(both, 1)).alias(f"n{i}")]
        r2 = lambda i: F.col(f"r{i}") * F.col(f"r{i}")
        rows = [F.struct(F.lit(c).alias("column"), F.try_divide(r2(i) * (F.col(f"n{i}") - 2), 1 - r2(i)).alias("score")) for i, c in enumerate(cols)]
        return df.agg(*aggs).select(F.inline(F.array(*rows)))
    aggs = [F.count("*").alias("_n")]
    for i, c in enumerate(cols):
        aggs += [F.sum(number(c)).alias(f"s{i}"), F.count(number(c)).alias(f"c{i}"), F.variance(number(c)).alias(f"v{i}")]
    groups = df.where(F.col(target).isNotNull()).groupBy(target).agg(*aggs)
    if score == "chi2":
        total = groups.agg(F.sum("_n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(cols))]).first()
        terms = []
        for i, c in enumerate(cols):
            expected = F.col("_n") / F.lit(total["n"]) * F.lit(float(total[f"s{i}"]))
            terms.append(F.sum(F.try_divide((F.col(f"s{i}") - expected) * (F.col(f"s{i}") - expected), expected)).alias(f"x{i}"))
        rows = [F.struct(F.lit(c).alias("column"), F.col(f"x{i}").alias("score")) for i, c in enumerate(cols)]
        return groups.agg(*terms).select(F.inline(F.array(*rows)))
    if score != "f_classif":
        raise ValueError(f"unknown score {score}")
    terms = []
    for i in range(len(cols)):
        n, s, v = F.col(f"c{i}"), F.col(f"s{i}"), F.coalesce(F.col(f"v{i}"), F.lit(0.0))
        between = F.sum(s * s / n) - F.sum(s) * F.sum(s) / F.sum(n)
        within = F.sum(v * (n - 1))
        terms.append(F.try_divide(between / (F.count(n) - 1), within / (F.sum(n) - F.count(n))).alias(f"x{i}"))
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"x{i}").alias("score")) for i, c in enumerate(cols)]
    return groups.agg(*terms).select(F.inline(F.array(*rows)))


def select_best_k(df: DataFrame, target, columns=None, k=10, score="auto", task="auto"):
    cols = feature_list(df, columns, target)
    scores = {r["column"]: r["score"] for r in feature_scores(df, target, cols, score, task).collect()}
    return _keep_best(df, cols, scores, min(k, len(cols)))


def select_by_model(df: DataFrame, target, columns=None, task="auto", threshold=None, max_features=None, num_trees=100, seed=42):
    """Columns whose forest importance reaches the threshold (default: the mean importance)."""
    table = forest_importance(df, target, columns, task, num_trees, seed)
    cols = feature_list(df, columns, target)
    cut = threshold if threshold is not None else sum(table.values()) / len(table)
    chosen = [c for c in cols if table[c] >= cut] if max_features is None or threshold is not None else cols
    if max_features is not None:
        chosen = sorted(chosen, key=lambda c: -table[c])[:max_features]
    return df.drop(*[c for c in cols if c not in chosen])


def forest_importance(df, target, columns=None, task="auto", num_trees=100, seed=42):
    from millrace.operators.models import train_model

    cols = feature_list(df, columns, target)
    task = task_of(df, target) if task == "auto" else task
    fitted = train_model(df, target, cols, f"random_forest_{'classifier' if task == 'classification' else 'regressor'}", seed=seed, numTrees=num_trees)
    return dict(fitted.metadata["feature_importance"])


def importance_cut(importances, threshold=None, cumulative=0.95):
    """(column, importance, cumulative share, kept) in falling order of importance."""
    total = sum(importances.values()) or 1.0
    rows, run = [], 0.0
    for c, v in sorted(importances.items(), key=lambda x: -x[1]):
        keep_it = v >= threshold if threshold is not None else run < cumulative
        run += v / total
        rows.append((c, float(v), run, bool(keep_it)))
    return rows


def eliminate_recursively(df: DataFrame, target, columns=None, n_features=None, step=1, task="auto", strength=1.0):
    """Refit and drop the features with the smallest coefficients until ``n_features`` are left.

    Returns (reduced table, {column: rank}); kept features have rank 1.
    """
    from millrace.operators.models import assemble, linear_estimator

    cols = feature_list(df, columns, target)
    task = task_of(df, target) if task == "auto" else task
    n_features = max(1, len(cols) // 2) if n_features is None else min(n_features, len(cols))
    left, removed = list(cols), []
    narrow = df.select(*cols, target).na.drop().persist()
    try:
        while len(left) > n_features:
            weights = linear_estimator(task, narrow, target, strength)(assemble(narrow, left, "features"))
            drop = min(step, len(left) - n_features)
            worst = sorted(left, key=lambda c: weights[left.index(c)])[:drop]
            removed.append(worst)
            left = [c for c in left if c not in worst]
    finally:
        narrow.unpersist()
    ranks = {c: 1 for c in left}
    for r, group in enumerate(reversed(removed), start=2):
        ranks.update({c: r for c in group})
    return df.drop(*[c for c in cols if c not in left]), ranks


def select_sequentially(df: DataFrame, target, key, columns=None, n_features=2, algorithm="linear_regression", folds=3, metric=None):
    """Add, one by one, the feature that most improves the cross-validated score."""
    from millrace.operators.search import cross_validate, fold_table

    cols = feature_list(df, columns, target)
    # The folds follow from the key alone, so all sets of features share them.
    chosen, table = [], freeze(fold_table(df, target, cols, key, folds), "folds")
    while len(chosen) < min(n_features, len(cols)):
        scores = {c: cross_validate(df, target, chosen + [c], algorithm, key, folds, metric=metric, table=table)["mean_test"] for c in cols if c not in chosen}
        chosen.append(max(scores, key=scores.get))
    return df.drop(*[c for c in cols if c not in chosen])


def select_features(df: DataFrame, method, target=None, columns=None, **params):
    table = {
        "variance": lambda: select_by_variance(df, columns, **params),
        "correlation": lambda: select_by_correlation(df, columns, target, **params),
        "mutual_info": lambda: select_by_information(df, target, columns, **params),
        "k_best": lambda: select_best_k(df, target, columns, **params),
        "model": lambda: select_by_model(df, target, columns, **params),
        "rfe": lambda: eliminate_recursively(df, target, columns, **params)[0],
        "sequential": lambda: select_sequentially(df, target, columns=columns, **params),
    }
    if method not in table:
        raise ValueError(f"unknown selection {method}")
    return table[method]()
