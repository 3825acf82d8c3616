"""Matrix statistics of wide tables: partial results per Arrow batch, merged in a tree.

A task keeps counts, means and centred cross products, and passes on one row per class and one matrix,
however many rows and columns it reads. Partial results merge pairwise without loss (the scatter around a
common mean is the sum of both scatters and the scatter of the means), so no plan holds one expression per
pair of columns and no task holds a class.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.quantiles import number
from millrace.plans.sizing import freeze

#: Partial rows that one task merges.
FAN = 64
#: Bytes of class means that a task holds before it passes them on, and of centres that are sent to tasks at once.
HELD_BYTES = 16 << 20


def ddl(df: DataFrame):
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def rows_of(column, width):
    """An Arrow column of lists of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), width)


def lists(matrix):
    width = matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, width, dtype=np.int32)), pa.array(matrix.ravel()))


def vectors(df: DataFrame, cols, *more):
    """Complete rows as (_x array<double>, more...)."""
    return df.select(F.array(*[number(c) for c in cols]).alias("_x"), *more).where(~F.exists("_x", lambda v: v.isNull()))


class _Classes:
    """Counts, means and squared distances to the mean of the classes a task has met."""

    def __init__(self, width, full):
        self.width, self.scatter = width, np.zeros((width, width)) if full else None
        self.clear()

    def clear(self):
        self.at, self.n, self.within, self.mean = {}, np.zeros(0), np.zeros(0), np.zeros((0, self.width))

    def add(self, names, code, x):
        order = np.argsort(code, kind="stable")
        present, start, n = np.unique(code[order], return_index=True, return_counts=True)
        x = x[order]
        mean = np.add.reduceat(x, start, axis=0) / n[:, None]
        rest = x - np.repeat(mean, n, axis=0)
        within = np.add.reduceat(np.einsum("ij,ij->i", rest, rest), start)
        for c in present:
            if names[c] not in self.at:
                self.at[names[c]] = len(self.at)
        grown = len(self.at) - len(self.n)
        if grown:
            self.n, self.within = (np.concatenate((v, np.zeros(grown))) for v in (self.n, self.within))
            self.mean = np.concatenate((self.mean, np.zeros((grown, self.width))))
        row = np.array([self.at[names[c]] for c in present])
        gap, share = mean - self.mean[row], self.n[row] * n / (self.n[row] + n)
        self.within[row] += within + share * np.einsum("ij,ij->i", gap, gap)
        self.mean[row] += gap * (n / (self.n[row] + n))[:, None]
        self.n[row] += n
        if self.scatter is not None:
            self.scatter += rest.T @ rest + (gap * share[:, None]).T @ gap

    def batch(self, node, kind):
        return pa.record_batch({
            "node": pa.array(np.full(len(self.n), node)), "g": pa.array(list(self.at), kind), "n": pa.array(self.n.astype(np.int64)),
            "within": pa.array(self.within), "mean": lists(self.mean), "scatter": pa.nulls(len(self.n), pa.binary())})


def _summed(rows: DataFrame, width):
    """Sum of the matrices in rows (node, scatter), FAN at a time until few enough reach the driver."""
    def add(part):
        total = sum(np.frombuffer(b, float) for b in part.column("scatter").to_pylist())
        return pa.table({"node": part.column("node")[:1], "scatter": pa.array([total.tobytes()], pa.binary())})

    while True:
        rows = freeze(rows, "scatter")
        if (rows.agg(F.max("node")).first()[0] or 0) < FAN:
            break
        rows = rows.withColumn("node", F.floor(F.col("node") / FAN)).groupBy("node").applyInArrow(add, "node long, scatter binary")
    found = [np.frombuffer(r["scatter"], float) for r in rows.groupBy("node").applyInArrow(add, "node long, scatter binary").select("scatter").collect()]
    return sum(found, np.zeros(width * width)).reshape(width, width)


def class_statistics(df: DataFrame, cols, group=None, full=False):
    """(table, scatter): per class (g, n, within, mean) of the complete rows, within being the sum of squared
    distances to the class mean; with ``full`` also the pooled scatter matrix around the class means."""
    return vector_statistics(vectors(df, cols, (F.col(group) if group else F.lit(0)).alias("g")), len(cols), full)


def vector_statistics(rows: DataFrame, width, full=False):
    """class_statistics of complete rows (_x array<double>, g).

    Rows that are arrays already need this form: taken apart into a column per value and put together again,
    they make the optimizer derive constraints whose number doubles with every column.
    """
    kind = rows.schema["g"].dataType.simpleString()
    schema = f"node long, g {kind}, n long, within double, mean array<double>, scatter binary"

    def partial(batches):
        node, held, g_type = TaskContext.get().partitionId(), _Classes(width, full), None
        for b in batches:
            if not b.num_rows:
                continue
            g_type = b.column(1).type
            coded = b.column(1).dictionary_encode()
            names = [*coded.dictionary.to_pylist(), None]
            code = coded.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)
            held.add(names, code, rows_of(b.column(0), width))
            if held.mean.nbytes > HELD_BYTES:
                yield held.batch(node, g_type)
                held.clear()
        if len(held.n):
            yield held.batch(node, g_type)
        if full and g_type is not None:
            yield pa.record_batch({"node": pa.array([node]), "g": pa.nulls(1, g_type), "n": pa.nulls(1, pa.int64()), "within": pa.nulls(1, pa.float64()),
                                   "mean": pa.nulls(1, pa.list_(pa.float64())), "scatter": pa.array([held.scatter.tobytes()], pa.binary())})

    def merge(part):
        n, within, mean = part.column("n").to_numpy().astype(float), part.column("within").to_numpy(), rows_of(part.column("mean"), width)
        centre = n @ mean / n.sum()
        within = within.sum() + (n * ((mean - centre) ** 2).sum(1)).sum()
        return pa.table({"node": part.column("node")[:1], "g": part.column("g")[:1], "n": pa.array([int(n.sum())]), "within": pa.array([within]), "mean": lists(centre[None, :])})

    parts = freeze(rows.select("_x", "g").mapInArrow(partial, schema), "partial")
    merged = "node long, g {}, n long, within double, mean array<double>".format(kind)
    classes, top = parts.where("n is not null").drop("scatter"), parts.agg(F.max("node")).first()[0] or 0
    while top >= FAN:
        top //= FAN
        classes = classes.withColumn("node", F.floor(F.col("node") / FAN)).groupBy("g", "node").applyInArrow(merge, merged)
    classes = freeze(classes.groupBy("g").applyInArrow(merge, merged).drop("node"), "classes")
    if not full:
        return classes, None

    # What the classes of single tasks lack: how far their means lie from the mean of the class.
    met = parts.where("n is not null").alias("p").join(classes.alias("c"), F.col("p.g").eqNullSafe(F.col("c.g")))
    moved = _outer(met.select(F.col("p.mean").alias("mean"), F.col("c.mean").alias("centre"), F.col("p.n").alias("n")), width)
    return classes, _summed(parts.where("n is null").select("node", "scatter").union(moved), width)


def _outer(rows: DataFrame, width):
    """One row (node, scatter) per task: the sum of n times the outer products of mean - centre."""
    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                gap = rows_of(b.column("mean"), width) - rows_of(b.column("centre"), width)
                some = (gap * b.column("n").to_numpy()[:, None]).T @ gap
                total = some if total is None else total + some
        if total is not None:
            yield pa.record_batch({"node": pa.array([TaskContext.get().partitionId()]), "scatter": pa.array([total.tobytes()], pa.binary())})

    return rows.mapInArrow(run, "node long, scatter binary")


def overall(classes: DataFrame, width):
    """(rows, mean of all rows) of a class table."""
    n = classes.agg(F.sum("n")).first()[0] or 0
    at = classes.select("n", F.posexplode("mean").alias("i", "v")).groupBy("i").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("m"))
    mean = np.zeros(width)
    for r in at.collect():
        mean[r["i"]] = r["m"]
    return n, mean


def between_scatter(classes: DataFrame, mean):
    """Scatter of the class means around a point, weighted by the rows of the classes."""
    point = F.array(*[F.lit(float(v)) for v in mean])
    return _summed(_outer(classes.select("mean", point.alias("centre"), "n"), len(mean)), len(mean))


def projected(df: DataFrame, cols, mean, weights, names):
    """Append the columns (x - mean) @ weights, NULL for incomplete rows, one matrix product per Arrow batch."""
    x = F.array(*[number(c) for c in cols])
    rows = df.withColumn("_x", F.when(~F.exists(x, lambda v: v.isNull()), x))
    out = df.withColumns({n: F.lit(None).cast("double") for n in names})
    sent, columns = df.sparkSession.sparkContext.broadcast((mean, weights)), out.columns

    def run(batches):
        mean, weights = sent.value
        for b in batches:
            valid = b.column("_x").is_valid()
            z = np.full((b.num_rows, weights.shape[1]), np.nan)
            z[valid.to_numpy(zero_copy_only=False)] = (rows_of(b.column("_x").filter(valid), len(cols)) - mean) @ weights
            kept = [c for i, c in enumerate(b.columns) if b.schema.names[i] != "_x"]
            new = [pa.array(z[:, i], from_pandas=True) for i in range(z.shape[1])]
            yield pa.record_batch([*kept, *new], names=columns)

    return rows.mapInArrow(run, out.schema)


def centre_blocks(classes: DataFrame, width, names):
    """Lists of rows of a class table, each of about HELD_BYTES of means; one reaches the driver at a time."""
    count = classes.count()
    blocks = max(1, -(-count * (width + 4) * 8 // HELD_BYTES))
    for i in range(blocks):
        yield classes.where(F.pmod(F.xxhash64("g"), F.lit(blocks)) == i).select(*names).collect()


def against_centres(df: DataFrame, group, classes: DataFrame, width):
    """Add to rows with _x the columns _own and _other, the mean squared distance to the other rows of the own
    class and to the rows of the nearest other class, and _gap, the distance to the own centre.

    The centres come in blocks of bounded size; every block is one narrow pass that keeps the least value.
    """
    out = df.withColumns({n: F.lit(None).cast("double") for n in ("_own", "_other", "_gap")})
    schema = ddl(out)
    for rows in centre_blocks(classes, width, ["g", "n", "within", "mean"]):
        if not rows:
            continue
        names = {r["g"]: i for i, r in enumerate(rows)}
        n, within, mean = np.array([r["n"] for r in rows], float), np.array([r["within"] for r in rows]), np.array([r["mean"] for r in rows])
        sent = df.sparkSession.sparkContext.broadcast((names, n, within / n, mean, mean.mean(0)))

        def run(batches, sent=sent):
            names, n, spread, mean, origin = sent.value
            moved = mean - origin
            for b in batches:
                x, g = b.column("_x"), b.column(group).to_pylist()
                known = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
                own = np.array([names.get(v, -1) for v in g], int)[known]
                full = rows_of(x.filter(x.is_valid()), width)
                held = {c: b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("_own", "_other", "_gap")}
                step = max(1, HELD_BYTES // (8 * len(n)))
                for s in range(0, len(known), step):
                    at, mine, some = known[s : s + step], own[s : s + step], full[s : s + step]
                    rest = some - origin
                    d2 = np.maximum((rest * rest).sum(1)[:, None] + (moved * moved).sum(1)[None, :] - 2.0 * rest @ moved.T, 0.0) + spread[None, :]
                    here = np.flatnonzero(mine >= 0)
                    gap = some[here] - mean[mine[here]]
                    gap2 = (gap * gap).sum(1)
                    held["_gap"][at[here]] = np.sqrt(gap2)
                    size = n[mine[here]]
                    held["_own"][at[here]] = np.where(size > 1, (gap2 + spread[mine[here]]) * size / np.maximum(size - 1, 1), np.nan)
                    d2[here, mine[here]] = np.inf
                    least = d2.min(1)
                    held["_other"][at] = np.fmin(held["_other"][at], np.where(np.isfinite(least), least, np.nan))
                done = [b.column(c) if c not in held else pa.array(held[c], from_pandas=True) for c in b.schema.names]
                yield pa.record_batch(done, names=b.schema.names)

        out = out.mapInArrow(run, schema)
    return out
