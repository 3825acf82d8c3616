"""Joining fitted lookup tables back to the data."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.ordered import same_keys
from millrace.plans.sizing import is_local

SALTS = 64
HOT_SHARE = 1000


def attach(df: DataFrame, table: DataFrame, keys, names, weight=None, how="left"):
    """Left join ``names`` of ``table`` (one row per key, NULL keys match) onto ``df``.

    A local table is broadcast. A large one is shuffled; keys whose ``weight`` (row count) exceeds
    1/1000 of all rows are spread over salts so that no task receives a whole hot key.
    """
    keys, names = list(keys), list(names)
    left, right = df, table.select(*keys, *names, *([weight] if weight and weight not in names + keys else []))
    on = keys
    if is_local(table):
        right = F.broadcast(right)
    elif weight:
        total = table.agg(F.sum(weight)).first()[0] or 0
        hash_ = F.xxhash64(*keys)
        hot = [r[0] for r in table.where(F.col(weight) > total / HOT_SHARE).select(hash_).collect()]
        if hot:
            left = df.withColumn(
                "_salt", F.when(hash_.isin(hot), F.pmod(F.xxhash64(*df.columns, F.lit(7)), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
            )
            right = right.withColumn(
                "_salt",
                F.explode(
                    F.when(hash_.isin(hot), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(
                        F.array(F.lit(0).cast("long"))
                    )
                ),
            )
            on = [*keys, "_salt"]
    kept = [F.col(f"l.`{c}`") for c in df.columns]
    return left.alias("l").join(right.alias("r"), same_keys("l", "r", on), how).select(*kept, *[F.col(f"r.`{n}`") for n in names])
