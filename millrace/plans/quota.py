"""Exact row quotas in a seeded hash order, without sorting the table.

The 64-bit hash of the key columns is histogrammed by its top bits; only the one bucket in which
the quota runs out is ranked. The result is a plain filter ``hash <= threshold`` per stratum.
Key columns must identify a row: rows with equal keys have equal hashes and stay together.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.sizing import keep

BUCKET_BITS = 16


def order_hash(keys, seed=0):
    return F.xxhash64(F.lit(int(seed)), *[F.col(k) for k in keys])


def bucket_of(hash_col, bits=BUCKET_BITS):
    return F.shiftright(hash_col, 64 - bits)


def quota_thresholds(df: DataFrame, keys, quota, strata=(), seed=0):
    """Rows (strata..., _cut): the largest hash inside the quota of each stratum.

    ``quota`` is a Column over ``_rows`` (rows of the stratum) and ``_all`` (rows of the table) or a
    DataFrame with the strata columns and ``_quota``.
    """
    from millrace.plans.ordered import same_keys

    strata = list(strata)
    hashed = df.select(*strata, order_hash(keys, seed).alias("_h")).withColumn("_b", bucket_of(F.col("_h")))
    counts = hashed.groupBy(*strata, "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*strata)
    cum = counts.select(
        "*",
        F.sum("_c").over(w.orderBy("_b")).alias("_cum"),
        F.sum("_c").over(w).alias("_rows"),
    )
    if isinstance(quota, DataFrame):
        own = [F.col(f"l.`{c}`") for c in cum.columns]
        cum = cum.alias("l").join(quota.alias("q"), same_keys("l", "q", strata), "left").select(*own, "_quota") if strata else cum.withColumn("_quota", F.lit(quota.first()["_quota"]))
    else:
        cum = cum.withColumn("_quota", quota.cast("long"))
    edge = cum.where((F.col("_cum") >= F.col("_quota")) & (F.col("_cum") - F.col("_c") < F.col("_quota"))).select(
        *strata, "_b", (F.col("_quota") - F.col("_cum") + F.col("_c")).alias("_left")
    )
    on = [*strata, "_b"]
    joined = hashed.alias("l").join(edge.alias("e"), same_keys("l", "e", on)).select(*[F.col(f"l.`{c}`") for c in on], "_h", "_left")
    ranked = joined.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy("_h")))
    return ranked.where(F.col("_r") <= F.col("_left")).groupBy(*strata).agg(F.max("_h").alias("_cut"))


def training_cuts(df: DataFrame, shares, fold="fold", order="_order"):
    """{(fold, share): cut}: of the rows outside a fold, those with ``order`` up to the cut are its first
    ceil(share * rows) rows in the order of that hash. Two passes over the rows for all folds and shares."""
    bucket = bucket_of(F.col(order))
    counts = keep(df.groupBy(fold, bucket.alias("_b")).agg(F.count("*").alias("_c")), "counts").alias("c")
    folds = counts.select(F.col(fold).alias("_out")).distinct()
    others = counts.join(F.broadcast(folds), F.col("_out") != F.col(f"c.`{fold}`")).groupBy("_out", "_b").agg(F.sum("_c").alias("_c"))
    w = Window.partitionBy("_out")
    cum = others.select("*", F.sum("_c").over(w.orderBy("_b")).alias("_cum"), F.sum("_c").over(w).alias("_rows"))
    cum = cum.withColumn("_share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("_quota", F.ceil(F.col("_rows") * F.col("_share")))
    edge = cum.where((F.col("_cum") >= F.col("_quota")) & (F.col("_cum") - F.col("_c") < F.col("_quota")))
    # One bucket per fold and share.
    edge = keep(edge.select("_out", "_share", "_b", (F.col("_quota") - F.col("_cum") + F.col("_c")).alias("_left")), "edges")
    inside = df.select(fold, F.col(order).alias("_h"), bucket.alias("_in")).join(F.broadcast(edge), (F.col("_in") == F.col("_b")) & (F.col(fold) != F.col("_out")))
    ranked = inside.withColumn("_r", F.row_number().over(Window.partitionBy("_out", "_share").orderBy("_h")))
    cuts = ranked.where(F.col("_r") <= F.col("_left")).groupBy("_out", "_share").agg(F.max("_h").alias("_cut")).collect()
    return {(r["_out"], r["_share"]): r["_cut"] for r in cuts}


def flag_quota(df: DataFrame, keys, quota, strata=(), seed=0, name="_picked"):
    """Add a boolean column: row lies inside its stratum's quota."""
    from millrace.plans.lookup import attach

    cuts = quota_thresholds(df, keys, quota, strata, seed)
    if not strata:
        row = cuts.first()
        cut = F.lit(row["_cut"]) if row else F.lit(None).cast("long")
        return df.withColumn(name, F.coalesce(order_hash(keys, seed) <= cut, F.lit(False)))
    out = attach(df, keep(cuts, "cuts"), strata, ["_cut"])
    return out.withColumn(name, F.coalesce(order_hash(keys, seed) <= F.col("_cut"), F.lit(False))).drop("_cut")


def hash_position(df: DataFrame, keys, strata=(), seed=0, name="_position"):
    """0-based position of each row in hash order within its stratum, ranked bucket by bucket."""
    from millrace.plans.ordered import same_keys

    strata = list(strata)
    hashed = df.withColumn("_h", order_hash(keys, seed)).withColumn("_b", bucket_of(F.col("_h")))
    counts = hashed.groupBy(*strata, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    on = [*strata, "_b"]
    ranked = hashed.withColumn("_r", F.row_number().over(Window.partitionBy(*on).orderBy("_h", *keys)) - 1)
    kept = [F.col(f"l.`{c}`") for c in df.columns]
    return (
        ranked.alias("l")
        .join(offsets.alias("o"), same_keys("l", "o", on), "left")
        .select(*kept, (F.col("_r") + F.col("_off")).cast("long").alias(name))
    )
