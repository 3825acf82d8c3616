"""Row numbers, prefix sums and bounded window frames that never funnel into one task.

Plain ``Window.orderBy`` without partition columns moves every row to one task, and with them a
hot group does the same. Above the size limit the helpers here sort by range partitioning, keep
each slice's position in a durable table and add the preceding slices' totals.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.sizing import freeze, is_small, slices

BLOCK_ROWS = 250_000


def columns(items):
    """Turn names ("x", "-x" for descending) and Column objects into sort columns."""
    out = []
    for item in items:
        if isinstance(item, str):
            out.append(F.col(item[1:]).desc() if item.startswith("-") else F.col(item))
        else:
            out.append(item)
    return out


def same_keys(left, right, keys):
    """Null-safe equality of several key columns of two aliased tables."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys])


def prefix_sum(df: DataFrame, weight, order_by, partition_by=(), before="_before", total="_total"):
    """Add the sum of ``weight`` over all earlier rows and over the whole group.

    Rows that tie on ``order_by`` need a further sort column to be told apart.
    """
    parts, order = list(partition_by), columns(order_by)
    df = df.withColumn("_weight", weight.cast("long"))
    if is_small(df):
        w = Window.partitionBy(*parts)
        return (
            df.withColumn(
                before,
                F.coalesce(
                    F.sum("_weight").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
                ),
            )
            .withColumn(total, F.sum("_weight").over(w))
            .drop("_weight")
        )
    n = slices(df)
    ranged = df.repartitionByRange(n, *[F.col(p) for p in parts], *order)
    ranged = freeze(ranged.withColumn("_slice", F.spark_partition_id()), "ranged")
    group = Window.partitionBy(*parts)
    sums = (
        ranged.groupBy(*parts, "_slice")
        .agg(F.sum("_weight").alias("_slice_sum"))
        .withColumn(
            "_offset",
            F.coalesce(
                F.sum("_slice_sum").over(group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .withColumn(total, F.sum("_slice_sum").over(group))
        .drop("_slice_sum")
    )
    keys = [*parts, "_slice"]
    if not parts:
        sums = F.broadcast(sums)
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = ranged.repartition(n, *keys).withColumn(before, F.coalesce(F.sum("_weight").over(local), F.lit(0)))
    kept = [F.col(f"l.`{c}`") for c in df.columns if c != "_weight"]
    return (
        numbered.alias("l")
        .join(sums.alias("s"), same_keys("l", "s", keys), "left")
        .select(*kept, (F.col(before) + F.col("s._offset")).alias(before), F.col(f"s.{total}"))
    )


def number_rows(df: DataFrame, order_by, partition_by=(), name="row_number"):
    """1-based position of each row within its group."""
    parts = list(partition_by)
    if is_small(df):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*parts).orderBy(*columns(order_by))).cast("long"))
    out = prefix_sum(df, F.lit(1), order_by, parts, "_position", "_rows")
    return out.withColumn(name, F.col("_position") + 1).drop("_position", "_rows")


def with_frames(df: DataFrame, build, order_by, partition_by=(), before=0, after=0):
    """Apply ``build(df, window)`` whose frames reach at most ``before``/``after`` rows away.

    Large inputs are cut into blocks of consecutive rows; each block also receives copies of the
    neighbouring rows that its frames can reach, so every frame is complete inside its block.
    """
    parts = list(partition_by)
    if is_small(df):
        return build(df, Window.partitionBy(*parts).orderBy(*columns(order_by)))
    size = max(int(df.sparkSession.conf.get("millrace.blockRows", str(BLOCK_ROWS))), 2 * max(before, after), 1)
    tasks = slices(df)
    numbered = number_rows(df, order_by, parts, "_pos").withColumn("_home", F.floor((F.col("_pos") - 1) / size))
    inside = (F.col("_pos") - 1) % size
    targets = F.array_compact(
        F.array(
            F.col("_home"),
            F.when(inside >= size - before, F.col("_home") + 1),
            F.when(inside < after, F.col("_home") - 1),
        )
    )
    copied = numbered.withColumn("_block", F.explode(targets)).repartition(tasks, *parts, "_block")
    built = build(copied, Window.partitionBy(*parts, "_block").orderBy("_pos"))
    return built.where(F.col("_block") == F.col("_home")).drop("_block", "_home", "_pos")


def carry_neighbours(df: DataFrame, names, order_by, partition_by=()):
    """Nearest known value and its position before and after each row, for several columns.

    Adds ``_pos`` and, per column c, ``_prev_c``, ``_prevpos_c``, ``_next_c``, ``_nextpos_c``.
    """
    parts = list(partition_by)
    small = is_small(df)
    tasks = 0 if small else slices(df)
    df = number_rows(df, order_by, parts, "_pos")
    size = int(df.sparkSession.conf.get("millrace.blockRows", str(BLOCK_ROWS)))
    keys = parts
    if not small:
        df = freeze(df.withColumn("_block", F.floor((F.col("_pos") - 1) / size)), "numbered")
        keys = [*parts, "_block"]
    # The frame after a row is taken in falling order: a frame that shrinks from the front would be
    # evaluated anew for every row.
    w = Window.partitionBy(*keys)
    back, ahead = (w.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("_pos"), F.desc("_pos")))

    def known(c):
        return F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("_pos").alias("p")))

    out = (df if small else df.repartition(tasks, *keys)).select(
        "*",
        *[F.last(known(c), ignorenulls=True).over(back).alias(f"_p_{c}") for c in names],
        *[F.last(known(c), ignorenulls=True).over(ahead).alias(f"_n_{c}") for c in names],
    )
    if not small:
        edge_aggs = []
        for c in names:
            edge_aggs += [
                F.max_by(known(c), F.when(F.col(c).isNotNull(), F.col("_pos"))).alias(f"_l_{c}"),
                F.min_by(known(c), F.when(F.col(c).isNotNull(), F.col("_pos"))).alias(f"_f_{c}"),
            ]
        edges = df.groupBy(*keys).agg(*edge_aggs)
        earlier, later = (Window.partitionBy(*parts).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_block"), F.desc("_block")))
        edges = edges.select(
            *keys,
            *[F.last(f"_l_{c}", ignorenulls=True).over(earlier).alias(f"_cp_{c}") for c in names],
            *[F.last(f"_f_{c}", ignorenulls=True).over(later).alias(f"_cn_{c}") for c in names],
        )
        if not parts:
            edges = F.broadcast(edges)
        plain = [c for c in out.columns if not c.startswith(("_p_", "_n_"))]
        out = (
            out.alias("l")
            .join(edges.alias("e"), same_keys("l", "e", keys), "left")
            .select(
                *[F.col(f"l.`{c}`") for c in plain],
                *[F.coalesce(F.col(f"_p_{c}"), F.col(f"_cp_{c}")).alias(f"_p_{c}") for c in names],
                *[F.coalesce(F.col(f"_n_{c}"), F.col(f"_cn_{c}")).alias(f"_n_{c}") for c in names],
            )
            .drop("_block")
        )
    spread = []
    for c in names:
        spread += [
            F.col(f"_p_{c}.v").alias(f"_prev_{c}"),
            F.col(f"_p_{c}.p").alias(f"_prevpos_{c}"),
            F.col(f"_n_{c}.v").alias(f"_next_{c}"),
            F.col(f"_n_{c}.p").alias(f"_nextpos_{c}"),
        ]
    plain = [c for c in out.columns if not c.startswith(("_p_", "_n_"))]
    return out.select(*plain, *spread)
