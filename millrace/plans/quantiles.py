"""Exact quantiles (linear interpolation) per column and group."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.lookup import attach
from millrace.plans.ordered import prefix_sum
from millrace.plans.sizing import estimated_bytes, is_small, keep

COMPACT_BYTES = 32 * 1024 * 1024
SKETCH_ACCURACY = 10_000
MAX_BRACKETS = 20


def is_compact(df: DataFrame):
    """The exact percentile aggregate suits inputs of up to COMPACT_BYTES."""
    return is_small(df, COMPACT_BYTES) and estimated_bytes(df) <= COMPACT_BYTES


def number(c):
    """Column as double with NaN treated as missing."""
    value = F.col(c).cast("double")
    return F.when(~F.isnan(value), value)


def melt(df: DataFrame, cols, group_by=(), cast="double"):
    """Long form (group..., _column, _value) of several columns, missing values dropped."""
    get = number if cast == "double" else (lambda c: F.col(c).cast(cast))
    pairs = F.array(*[F.struct(F.lit(c).alias("_column"), get(c).alias("_value")) for c in cols])
    long = df.select(*group_by, F.explode(pairs).alias("_pair")).select(*group_by, "_pair._column", "_pair._value")
    return long.where(F.col("_value").isNotNull())


def exact_quantiles(df: DataFrame, cols, probs, group_by=()):
    """One row per group with, for every column, an array of its quantiles at ``probs``.

    The compact plan uses the exact percentile aggregate, whose state grows with the number of
    distinct values of a group. Larger inputs are bracketed by a sketch first; many quantiles at
    once are read off the prefix-summed counts of all distinct values.
    """
    groups, probs = list(group_by), [float(p) for p in probs]
    if is_compact(df.select(*groups, *cols)):
        aggs = [F.percentile(number(c), F.array(*[F.lit(p) for p in probs])).alias(c) for c in cols]
        return df.groupBy(*groups).agg(*aggs)
    picked = _bracketed(df, cols, probs, groups) if len(cols) * len(probs) <= MAX_BRACKETS else None
    if picked is None:
        picked = _counted(df, cols, probs, groups)
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")
    slot = lambda j, i: F.col("_slot") == j * len(probs) + i
    aggs = [F.array(*[F.max(F.when(slot(j, i), value)) for i in range(len(probs))]).alias(c) for j, c in enumerate(cols)]
    return picked.groupBy(*groups).agg(*aggs)


def _pick(ranked, groups, at, before):
    """The two values around position ``at`` of each slot, from values with the count before them."""
    lo, hi = F.floor("_at"), F.ceil("_at")
    holds = lambda k: (F.col("_from") <= k) & (k < F.col("_from") + F.col("_n"))
    hit = ranked.withColumns({"_at": at, "_from": before}).where(holds(lo) | holds(hi))
    return hit.groupBy(*groups, "_slot").agg(
        F.max(F.when(holds(lo), F.col("_value"))).alias("_lo"), F.max(F.when(holds(hi), F.col("_value"))).alias("_hi"),
        F.max(F.col("_at") - lo).alias("_frac"))


def _counted(df, cols, probs, groups):
    """Counts per distinct value, prefix-summed by range; only the rows with a wanted rank are kept."""
    counts = melt(df, cols, groups).groupBy(*groups, "_column", "_value").agg(F.count("*").alias("_n"))
    ranked = prefix_sum(counts, F.col("_n"), ["_value"], [*groups, "_column"])
    first = F.lit(0)
    for j, c in enumerate(cols):
        first = F.when(F.col("_column") == c, F.lit(j * len(probs))).otherwise(first)
    targets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(probs)])
    long = ranked.select("*", F.explode(targets).alias("_t")).withColumn("_slot", first + F.col("_t.i"))
    return _pick(long, groups, (F.col("_total") - 1) * F.col("_t.p"), F.col("_before"))


def _bracketed(df, cols, probs, groups):
    """Quantiles from the few values between sketch bounds, or None if a bound missed its rank.

    Pass 1 sketches every quantile from both sides. Pass 2 counts the rows below each bracket and
    the values inside, about 4 / SKETCH_ACCURACY of the rows, so nothing else is shuffled.
    """
    pad = 2.0 / SKETCH_ACCURACY
    around = F.array(*[F.lit(min(1.0, max(0.0, p + side))) for p in probs for side in (-pad, pad)])
    names = [f"_v{j}" for j in range(len(cols))]
    data = df.select(*groups, *[number(c).alias(v) for c, v in zip(cols, names)])
    sketch = data.groupBy(*groups).agg(
        F.count("*").alias("_rows"),
        *[F.percentile_approx(v, around, F.lit(SKETCH_ACCURACY)).alias(f"_b{j}") for j, v in enumerate(names)],
        *[F.count(v).alias(f"_c{j}") for j, v in enumerate(names)])
    sketch = keep(sketch, "brackets")
    extra = [f"_{k}{j}" for j in range(len(cols)) for k in ("b", "c")]
    if groups:
        data = attach(data, sketch, groups, extra, weight="_rows")
    else:
        row = sketch.first()
        if any(row[f"_b{j}"] is None for j in range(len(cols))):
            return None
        data = data.withColumns({f"_b{j}": F.array(*[F.lit(float(x)) for x in row[f"_b{j}"]]) for j in range(len(cols))})
        data = data.withColumns({f"_c{j}": F.lit(row[f"_c{j}"]) for j in range(len(cols))})
    slots = [(j, i, j * len(probs) + i) for j in range(len(cols)) for i in range(len(probs))]
    low = lambda j, i: F.get(F.col(f"_b{j}"), F.lit(2 * i))
    high = lambda j, i: F.get(F.col(f"_b{j}"), F.lit(2 * i + 1))
    below = data.groupBy(*groups).agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(names[j]) < low(j, i)).alias(f"_u{s}") for j, i, s in slots],
        *[((F.max(f"_c{j}") - 1) * F.lit(probs[i])).alias(f"_a{s}") for j, i, s in slots])
    below = keep(below, "below")
    inside = data.select(*groups, F.explode(F.array_compact(F.array(*[
        F.when(F.col(names[j]).between(low(j, i), high(j, i)), F.struct(F.lit(s).alias("_slot"), F.col(names[j]).alias("_value"))) for j, i, s in slots]))).alias("_x"))
    counts = inside.groupBy(*groups, "_x._slot", "_x._value").agg(F.count("*").alias("_n"))
    ranked = prefix_sum(counts, F.col("_n"), ["_value"], [*groups, "_slot"])
    sides = [f"_{k}{s}" for _, _, s in slots for k in ("u", "a")]
    if groups:
        ranked = attach(ranked, below, groups, sides)
    else:
        row = below.first()
        ranked = ranked.withColumns({c: F.lit(row[c]) for c in sides})
    chosen = lambda k: F.coalesce(*[F.when(F.col("_slot") == s, F.col(f"_{k}{s}")) for _, _, s in slots])
    picked = keep(_pick(ranked, groups, chosen("a"), chosen("u") + F.col("_before")), "picked")
    known = sum(F.when(F.col(f"_c{j}") > 0, 1).otherwise(0) for j in range(len(cols)))
    wanted = (sketch.agg(F.sum(known)).first()[0] or 0) * len(probs)
    found = picked.where(F.col("_lo").isNotNull() & F.col("_hi").isNotNull()).count()
    return picked if found == wanted else None


def column_quantiles(df: DataFrame, cols, probs):
    """Driver-side dict column -> list of quantiles (one job, one row collected)."""
    rows = exact_quantiles(df, cols, probs).collect()
    row = rows[0] if rows else {c: None for c in cols}
    return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in cols}
