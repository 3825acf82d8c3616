"""Filters, top-N categories, sampling, concatenation, batching."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.profile import value_counts
from millrace.plans.lookup import attach
from millrace.plans.ordered import columns as sort_columns
from millrace.plans.ordered import number_rows
from millrace.plans.quota import flag_quota
from millrace.plans.sizing import keep


def apply_filters(df: DataFrame, ranges=None, categories=None, dates=None):
    """Inclusive numeric ranges, category lists and inclusive date ranges, all of which must hold."""
    tests = [F.col(c).between(lo, hi) for c, (lo, hi) in (ranges or {}).items()]
    tests += [F.col(c).isin(list(v)) for c, v in (categories or {}).items()]
    tests += [
        (F.col(c) >= F.lit(str(lo)).cast("date")) & (F.col(c) < F.date_add(F.lit(str(hi)).cast("date"), 1))
        for c, (lo, hi) in (dates or {}).items()
    ]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def keep_top_categories(df: DataFrame, column, n=10):
    """Rows whose category is among the ``n`` most frequent (ties: smaller value first)."""
    top = value_counts(df, column).orderBy(F.desc("count"), column).limit(n).select(column)
    return df.join(F.broadcast(top), column, "left_semi")  # n rows


def head(df: DataFrame, n, order_by):
    return df.orderBy(*sort_columns(order_by)).limit(n)


def largest(df: DataFrame, n, column, ties=()):
    return df.orderBy(F.desc(column), *sort_columns(ties)).limit(n)


def sample_rows(df: DataFrame, n, key, seed=42):
    """Exactly ``n`` rows (or all, if fewer), chosen by a seeded hash of the key columns."""
    keys = [key] if isinstance(key, str) else list(key)
    return flag_quota(df, keys, F.least(F.lit(n), F.col("_rows")), seed=seed).where("_picked").drop("_picked")


def sample_fraction(df: DataFrame, fraction, seed=42):
    return df.sample(fraction=fraction, seed=seed)


def sample_stratified(df: DataFrame, n, key, strata, seed=42):
    """Exactly ``n`` rows, shared over the strata by largest remainder."""
    keys = [key] if isinstance(key, str) else list(key)
    groups = [strata] if isinstance(strata, str) else list(strata)
    sizes = df.groupBy(*groups).agg(F.count("*").alias("_size"))
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    share = sizes.withColumn("_exact", F.col("_size") * F.lit(min(n, total) / total if total else 0.0))
    share = keep(share.withColumn("_base", F.floor("_exact")))
    left = min(n, total) - (share.agg(F.sum("_base")).first()[0] or 0)
    extra = share.orderBy((F.col("_base") - F.col("_exact")), *groups).limit(int(left)).select(*groups).withColumn("_extra", F.lit(1))
    quota = attach(share, keep(extra), groups, ["_extra"]).select(*groups, (F.col("_base") + F.coalesce("_extra", F.lit(0))).alias("_quota"))
    return flag_quota(df, keys, keep(quota), groups, seed).where("_picked").drop("_picked")


def concat_tables(*tables):
    """Stack tables by column name; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def in_batches(df: DataFrame, size, order_by, name="batch"):
    """Number consecutive batches of ``size`` rows from 0."""
    out = number_rows(df, order_by, name="_row")
    return out.withColumn(name, F.floor((F.col("_row") - 1) / size)).drop("_row")


def drop_duplicates(df: DataFrame, subset=None):
    return df.dropDuplicates(list(subset) if subset else df.columns)
