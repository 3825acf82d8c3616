"""Column choice by type."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame):
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame):
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame):
    return [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def columns_of_type(df: DataFrame, kind):
    """Names of the numeric / categorical / datetime / boolean columns."""
    pick = {
        "numeric": numeric_columns,
        "categorical": string_columns,
        "datetime": datetime_columns,
        "boolean": lambda d: [f.name for f in d.schema if isinstance(f.dataType, T.BooleanType)],
    }
    return pick[kind](df)


def numeric_or(df: DataFrame, columns):
    """Given columns (all must be numeric) or every numeric column."""
    known = numeric_columns(df)
    if columns is None:
        return known
    bad = [c for c in columns if c not in known]
    if bad:
        raise ValueError(f"not numeric: {bad}")
    return list(columns)


def nan_to_null(df: DataFrame):
    """Missing data is one notion: NaN in float columns becomes NULL."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def replace_columns(df: DataFrame, new: dict):
    """One projection that replaces columns in place and appends new ones."""
    out = [new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns]
    return df.select(*out, *[e.alias(c) for c, e in new.items() if c not in df.columns])
