"""Train/test split and fold assignment with exact sizes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.ordered import prefix_sum
from millrace.plans.quota import flag_quota, hash_position


def _keys(key):
    return [key] if isinstance(key, str) else list(key)


def mark_test(df: DataFrame, key, test_size=0.2, stratify=None, seed=42, name="is_test"):
    """Flag exactly ceil(test_size * n) rows as test rows, overall or within every stratum."""
    strata = _keys(stratify) if stratify else []
    return flag_quota(df, _keys(key), F.ceil(F.round(F.col("_rows") * F.lit(float(test_size)), 9)), strata, seed, name)


def split_data(df: DataFrame, key, test_size=0.2, stratify=None, seed=42):
    marked = mark_test(df, key, test_size, stratify, seed)
    return marked.where("not is_test").drop("is_test"), marked.where("is_test").drop("is_test")


def assign_folds(df: DataFrame, key, k=5, stratify=None, seed=42, name="fold"):
    """Fold number 0..k-1; fold sizes (per class when stratified) differ by at most one row."""
    strata = _keys(stratify) if stratify else []
    out = hash_position(df, _keys(key), strata, seed)
    return out.withColumn(name, F.pmod("_position", F.lit(k)).cast("int")).drop("_position")


def time_series_folds(df: DataFrame, order_by, k=5, name="segment"):
    """Segment 0..k in time order. Fold i trains on segments <= i and tests on segment i + 1.

    The test segments have floor(n / (k + 1)) rows each; the first segment takes the remainder.
    """
    out = prefix_sum(df, F.lit(1), order_by)
    size = F.floor(F.col("_total") / (k + 1))
    first = F.col("_total") - size * k
    seg = F.when(F.col("_before") < first, 0).otherwise(1 + F.floor((F.col("_before") - first) / size))
    return out.withColumn(name, seg.cast("int")).drop("_before", "_total")


def fold_parts(df: DataFrame, i, name="fold", time_series=False):
    if time_series:
        return df.where(F.col(name) <= i), df.where(F.col(name) == i + 1)
    return df.where(F.col(name) != i), df.where(F.col(name) == i)
