"""Missing values: dropping and filling."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.columns import datetime_columns, numeric_columns, numeric_or, replace_columns
from millrace.operators.profile import column_modes, null_counts
from millrace.plans.ordered import carry_neighbours
from millrace.plans.quantiles import column_quantiles, number
from millrace.plans.spec import fit_transform, step


def with_nulls(df, columns):
    """Columns of the list that hold a missing value (the others keep their type)."""
    _, nulls = null_counts(df.select(*columns))
    return [c for c in columns if nulls[c]]


@step("remove_rows")
def remove_rows(df: DataFrame, learned):
    """Keep rows with at least int(threshold * k) of the k columns present; without threshold, all."""
    cols = learned.get("columns") or df.columns
    threshold = learned.get("threshold")
    need = len(cols) if threshold is None else int(threshold * len(cols))
    return df.na.drop(thresh=need, subset=cols)


def _fit_remove_columns(df, columns, threshold=0.5):
    rows, nulls = null_counts(df)
    return {"drop": [c for c in (columns or df.columns) if rows and nulls[c] / rows > threshold]}


@step("remove_columns", _fit_remove_columns)
def remove_columns(df, learned):
    return df.drop(*learned["drop"])


def _fill(df, learned):
    values = learned["values"]
    return replace_columns(df, {c: F.coalesce(number(c), F.lit(float(v))) for c, v in values.items() if v is not None})


def _fit_mean(df, columns):
    cols = numeric_or(df, columns)
    row = df.agg(*[F.avg(number(c)).alias(c) for c in cols]).first()
    return {"values": {c: row[c] for c in cols}}


def _fit_median(df, columns):
    cols = numeric_or(df, columns)
    return {"values": {c: q[0] for c, q in column_quantiles(df, cols, [0.5]).items()}}


step("fill_mean", _fit_mean)(_fill)
step("fill_median", _fit_median)(_fill)


def _fit_mode(df, columns):
    cols = list(columns or df.columns)
    return {"values": {r["column"]: r["mode"] for r in column_modes(df, cols).collect()}}


@step("fill_mode", _fit_mode)
def fill_mode(df, learned):
    types = dict((f.name, f.dataType) for f in df.schema)
    new = {}
    for c, v in learned["values"].items():
        lit = F.lit(v).cast("double").cast(types[c]) if isinstance(types[c], T.NumericType) else F.lit(v).cast(types[c])
        new[c] = F.coalesce(F.col(c), lit)
    return replace_columns(df, new)


@step("fill_constant")
def fill_constant(df, learned):
    """Fill with one value; columns whose type does not fit the value are an error.

    Integer columns become double when the value is no integer.
    """
    value = learned["value"]
    cols = learned.get("columns") or df.columns
    numeric = numeric_columns(df)
    if not isinstance(value, str):
        bad = [c for c in cols if c not in numeric and not isinstance(df.schema[c].dataType, T.BooleanType)]
        if bad:
            raise ValueError(f"{value!r} does not fit {bad}")
    elif any(c in numeric for c in cols):
        raise ValueError(f"{value!r} does not fit numeric columns")
    if isinstance(value, float) and not value.is_integer():
        whole = [c for c in cols if isinstance(df.schema[c].dataType, T.IntegralType)]
        df = replace_columns(df, {c: F.col(c).cast("double") for c in whole})
    return df.na.fill(value, subset=list(cols))


def fill_interpolation(df: DataFrame, columns, order_by, partition_by=(), method="linear", time_column=None):
    """Interpolate between the nearest known values in row order; edges take the nearest known value.

    method: linear (by row position), time (by ``time_column``), nearest, zero (last known value).
    Each column is then forward- and backward-filled, so only all-missing columns stay NULL.
    """
    cols = list(columns)
    work = df
    for c in cols:
        if c in numeric_columns(df):
            work = work.withColumn(c, number(c))
    if method == "time":
        stamp = F.col(time_column)
        seconds = F.unix_micros(stamp.cast("timestamp")).cast("double")
        work = work.withColumns({f"_k_{c}": F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("y"), seconds.alias("x"))) for c in cols})
        around = carry_neighbours(work, [f"_k_{c}" for c in cols], order_by, partition_by)
    else:
        around = carry_neighbours(work, cols, order_by, partition_by)
    new = {}
    for c in cols:
        if method == "time":
            lo, hi = F.col(f"_prev__k_{c}"), F.col(f"_next__k_{c}")
            prev, nxt, x0, x1, x = lo["y"], hi["y"], lo["x"], hi["x"], seconds
        else:
            prev, nxt = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
            x0, x1, x = F.col(f"_prevpos_{c}"), F.col(f"_nextpos_{c}"), F.col("_pos")
        if method in ("linear", "time"):
            inner = F.when(x1 == x0, prev).otherwise(prev + (nxt - prev) * (x - x0) / (x1 - x0))
        elif method == "nearest":
            inner = F.when(nxt.isNull() | (x - x0 <= x1 - x), prev).otherwise(nxt)
        elif method == "zero":
            inner = prev
        else:
            raise ValueError(f"unknown interpolation {method}")
        new[c] = F.coalesce(F.col(c), inner, prev, nxt)
    out = replace_columns(around, new)
    return out.select(*df.columns)


def fill_forward_backward(df: DataFrame, columns, order_by, partition_by=()):
    """Last known value, else next known value, for columns of any type."""
    around = carry_neighbours(df, list(columns), order_by, partition_by)
    return replace_columns(
        around, {c: F.coalesce(F.col(c), F.col(f"_prev_{c}"), F.col(f"_next_{c}")) for c in columns}
    ).select(*df.columns)


def fill_regression(df: DataFrame, column, features):
    """Fill ``column`` with a linear regression on ``features`` fitted on the complete rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    assembler = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep")
    complete = assembler.transform(df.na.drop(subset=[column, *features]).withColumn("_y", F.col(column).cast("double")))
    model = LinearRegression(featuresCol="_x", labelCol="_y").fit(complete)
    guess = F.lit(float(model.intercept))
    for f, w in zip(features, model.coefficients):
        guess = guess + F.col(f) * F.lit(float(w))
    return replace_columns(df, {column: F.coalesce(number(column), guess)})


def handle_missing_values(df: DataFrame, method, columns=None, **params):
    """Dispatch by method name."""
    if method == "fill_interpolation":
        numeric = [c for c in (columns or numeric_columns(df)) if c in numeric_columns(df)]
        kind = params.pop("interpolation", params.pop("method", "linear"))
        out = fill_interpolation(df, numeric, method=kind, **params)
        others = [c for c in df.columns if c not in numeric]
        keys = {c.lstrip("-") for c in params.get("order_by", []) if isinstance(c, str)} | set(params.get("partition_by", ()))
        tail = [c for c in others if c not in keys]
        return fill_forward_backward(out, tail, params["order_by"], params.get("partition_by", ())) if tail else out
    if method == "fill_knn":
        from millrace.operators.knn import fill_knn

        return fill_knn(df, numeric_or(df, columns), **params)
    if method == "fill_regression":
        return fill_regression(df, columns[0], **params)
    return fit_transform(method, df, columns, **params)
