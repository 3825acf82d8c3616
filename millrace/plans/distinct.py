"""Distinct counts without one copy of the table per column.

A single pass keeps a mergeable sketch per column. Where the number itself matters, columns with few values
are counted by sets of bounded size in one more pass, and each other column by a distinct of that column alone,
which reads and shuffles nothing else.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**SKETCH registers: estimates are within 2 per cent but for one in thousands. Sets hold up to FEW values.
SKETCH, ERROR, FEW = 14, 0.04, 512


def sketched(column):
    """Aggregate: the estimated number of distinct values, NULLs apart."""
    c = F.col(column)
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), F.lit(SKETCH))), F.lit(0))


def exact_counts(df: DataFrame, estimates: dict):
    """{column: distinct values} of the columns of ``estimates``, exactly."""
    few = [c for c, n in estimates.items() if n <= FEW]
    many = [c for c in estimates if c not in few]
    out = {}
    if few:
        # As text, zero has one sign after the sum and NaN equals itself.
        real = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
        row = df.agg(*[F.size(F.collect_set((F.col(c) + F.lit(0)).cast("string") if c in real else F.col(c))).alias(f"d{i}") for i, c in enumerate(few)]).first()
        out.update({c: row[f"d{i}"] for i, c in enumerate(few)})
    if many:
        one = lambda c: df.select(c).na.drop().distinct().agg(F.count("*").alias("n")).select(F.lit(c).alias("column"), "n")
        out.update({r["column"]: r["n"] for r in reduce(DataFrame.union, [one(c) for c in many]).collect()})
    return {c: out[c] for c in estimates}


def distinct_counts(df: DataFrame, columns):
    """{column: distinct values}, exactly."""
    cols = list(columns)
    if not cols:
        return {}
    row = df.agg(*[sketched(c).alias(f"e{i}") for i, c in enumerate(cols)]).first()
    return exact_counts(df, {c: row[f"e{i}"] for i, c in enumerate(cols)})


def settled_counts(df: DataFrame, estimates: dict, limits):
    """The estimates, made exact for the columns that lie so near to a limit that a rule could go either way."""
    near = {c: n for c, n in estimates.items() if any(abs(n - limit) <= ERROR * limit + 2 for limit in limits)}
    return {**estimates, **(exact_counts(df, near) if near else {})}
