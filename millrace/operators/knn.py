"""Exact nearest neighbours as bounded blocks, and the operators built on them.

Points are made distinct first (copies become a weight), assigned to their nearest pivot, and
compared only with the cells that the triangle inequality cannot rule out. A cell is cut into
chunks of a fixed expected size; each (query chunk, point chunk) block is one NumPy distance matrix
in a task that passes on at most k rows per query.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.lookup import attach
from millrace.plans.ordered import number_rows, prefix_sum
from millrace.plans.quantiles import number
from millrace.plans.sizing import freeze, keep

CHUNK = 2048
MAX_PIVOTS = 4096


def distances(a, b, metric="euclidean"):
    if metric == "euclidean":
        d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
        out = np.sqrt(np.maximum(d2, 0.0))
        # The expanded form loses digits near zero: recompute the close pairs directly.
        scale = np.sqrt((a * a).sum(1))[:, None] + np.sqrt((b * b).sum(1))[None, :]
        i, j = np.nonzero(out <= 1e-3 * scale)
        for s in range(0, len(i), 1_000_000):
            p, q = i[s : s + 1_000_000], j[s : s + 1_000_000]
            out[p, q] = np.sqrt(((a[p] - b[q]) ** 2).sum(1))
        return out
    out = np.empty((len(a), len(b)))
    for s in range(0, len(a), 64):
        diff = np.abs(a[s : s + 64, None, :] - b[None, :, :])
        out[s : s + 64] = diff.sum(2) if metric == "manhattan" else diff.max(2)
    return out


def _pivots(points):
    """Hash-sampled distinct vectors per space, about half the square root of its size.

    A space that fits one chunk has a single pivot. At most MAX_PIVOTS vectors reach the driver.
    """
    out = {}
    for r in points.groupBy("space").agg(F.count("*").alias("n")).collect():
        size = 1 if r["n"] <= CHUNK else min(MAX_PIVOTS, int(r["n"] ** 0.5 / 2))
        some = points.where(F.col("space") == r["space"]).select("vec").distinct().orderBy(F.xxhash64("vec"), "vec")
        out[r["space"]] = np.array([v[0] for v in some.limit(size).collect()], float)
    return out


def _assign(df, pivots, metric):
    """Add the nearest pivot's cell and the distance to it."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for pdf in batches:
            cell, dist = np.zeros(len(pdf), int), np.zeros(len(pdf))
            for s, at in pdf.groupby("space").indices.items():
                d = distances(np.stack(pdf["vec"].to_numpy()[at]).astype(float), shared.value[s], metric)
                cell[at], dist[at] = d.argmin(1), d.min(1)
            yield pdf.assign(cell=cell, to_pivot=dist)

    return df.mapInPandas(run, _ddl(df) + ", cell int, to_pivot double")


def _ddl(df):
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _blocks(queries, points, counts, qcounts, block, schema):
    """Cogroup query chunks with point chunks of the same (space, cell) and run ``block`` on each."""
    chunk = max(16, int(queries.sparkSession.conf.get("millrace.knnChunk", str(CHUNK))))
    pieces = counts.withColumn("pp", F.ceil(F.col("n") / chunk).cast("int")).join(
        qcounts.withColumn("qp", F.ceil(F.col("m") / chunk).cast("int")), ["space", "cell"]).select("space", "cell", "pp", "qp")
    pieces = keep(pieces, "pieces")
    spread = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    place = lambda key, k: F.pmod(F.xxhash64(key, F.lit(11)), F.col(k)).cast("int")
    q = attach(queries, pieces, ["space", "cell"], ["pp", "qp"]).where("pp is not null").withColumn("qc", place("qid", "qp")).withColumn("pc", spread("pp")).drop("pp", "qp")
    p = attach(points, pieces, ["space", "cell"], ["pp", "qp"]).where("qp is not null").withColumn("pc", place("pid", "pp")).withColumn("qc", spread("qp")).drop("pp", "qp")
    keys = ["space", "cell", "pc", "qc"]
    return q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(block, schema)


def _top(pairs, k):
    """Nearest points of each query until their weights reach k; the last weight is clipped."""
    w = Window.partitionBy("qid").orderBy("distance", "pid")
    cum = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = pairs.withColumn("_before", F.coalesce(cum, F.lit(0))).where(F.col("_before") < k)
    return out.select("qid", "pid", "distance", F.least(F.col("n"), F.lit(k) - F.col("_before")).alias("n"))


def nearest(queries: DataFrame, points: DataFrame, k, metric="euclidean"):
    """(qid, pid, distance, n): the k nearest points of every query, counting each point n times.

    queries: qid long, space int, vec array<double>, scale double, self long (a point's own id, of
    which one copy is not its own neighbour, else NULL). points: pid long, space int, vec, n long.
    ``scale`` multiplies the distances of a query; a query may appear in several spaces.
    """
    pivots = _pivots(points)
    spaces = list(pivots)
    pts = freeze(_assign(points, pivots, metric), "points")
    cells = pts.groupBy("space", "cell").agg(F.count("*").alias("n"), F.max("to_pivot").alias("radius"))
    cells = keep(cells, "cells")
    table = {}
    for r in cells.collect():  # one row per pivot
        table.setdefault(r["space"], {})[r["cell"]] = r["radius"]
    qs = queries.where(F.col("space").isin(spaces))
    home = freeze(_assign(qs, pivots, metric), "queries")
    kk = int(k)

    def block(key, q, p):
        empty = pd.DataFrame({"qid": [], "space": [], "pid": [], "distance": [], "n": []})
        if not len(q) or not len(p):
            return empty
        p = p.sort_values("pid")
        d = distances(np.stack(q["vec"].to_numpy()).astype(float), np.stack(p["vec"].to_numpy()).astype(float), metric)
        ids, weights = p["pid"].to_numpy(), p["n"].to_numpy()
        own = q["self"].fillna(-1).to_numpy().astype("int64")
        take = min(kk + 1, len(p))
        near = np.argpartition(d, take - 1, axis=1)[:, :take] if take < len(p) else np.tile(np.arange(len(p)), (len(q), 1))
        # Ties at the cut are resolved by id, so points at the cut distance all stay candidates.
        cut = np.take_along_axis(d, near, 1).max(1)
        i, j = np.nonzero(d <= cut[:, None])
        n = weights[j] - (ids[j] == own[i])
        ok = n > 0
        i, j, n = i[ok], j[ok], n[ok]
        scale = q["scale"].to_numpy()[i]
        out = pd.DataFrame({"qid": q["qid"].to_numpy()[i], "space": int(key[0]), "pid": ids[j], "distance": d[i, j] * scale, "n": n})
        out = out.sort_values(["qid", "distance", "pid"])
        before = out.groupby("qid")["n"].cumsum() - out["n"]
        return out[before < kk]

    schema = "qid long, space int, pid long, distance double, n long"
    # Step 1: a query's own cell gives an upper bound of its k-th distance.
    qcount = home.groupBy("space", "cell").agg(F.count("*").alias("m"))
    first = freeze(_blocks(home, pts, cells.select("space", "cell", "n"), qcount, block, schema), "near")
    if all(len(v) == 1 for v in pivots.values()):
        return _top(first, kk)
    bound = _top(first, kk).groupBy("qid").agg(F.max("distance").alias("bound"), F.sum("n").alias("got"))
    bound = bound.select("qid", F.when(F.col("got") >= kk, F.col("bound")).alias("bound"))
    # Step 2: visit the other cells whose ball may hold something closer.
    asked = home.join(bound, "qid", "left")
    shared = home.sparkSession.sparkContext.broadcast((pivots, table))
    cols = home.columns

    def visits(batches):
        pivots, table = shared.value
        for pdf in batches:
            out = []
            for s, at in pdf.groupby("space").indices.items():
                part = pdf.iloc[at]
                vec = np.stack(part["vec"].to_numpy()).astype(float)
                d = distances(vec, pivots[s], metric)
                radius = np.full(len(pivots[s]), -np.inf)
                for c, r in table[s].items():
                    radius[c] = r
                limit = (part["bound"].fillna(np.inf) / part["scale"]).to_numpy()
                hit = (d - radius[None, :]) <= limit[:, None] * (1 + 1e-9) + 1e-12
                hit &= np.isfinite(radius)[None, :]
                hit[np.arange(len(part)), part["cell"].to_numpy()] = False
                i, j = np.nonzero(hit)
                out.append(part.iloc[i][cols].assign(cell=j.astype("int32")))
            yield pd.concat(out) if out else pdf.iloc[:0][cols]

    more = freeze(asked.mapInPandas(visits, _ddl(home)), "visits")
    mcount = more.groupBy("space", "cell").agg(F.count("*").alias("m"))
    second = _blocks(more, pts, cells.select("space", "cell", "n"), mcount, block, schema)
    return _top(first.unionByName(second), kk)


def distinct_points(df: DataFrame, cols, payload=()):
    """Distinct complete vectors with their count, a stable 64-bit id and the payload columns."""
    full = df.select(*[number(c).alias(c) for c in cols], *payload).na.drop(subset=list(cols))
    groups = full.groupBy(*cols, *payload).agg(F.count("*").alias("n"))
    ided = number_rows(groups, [*cols, *payload], name="pid")
    return ided.withColumn("vec", F.array(*cols)).withColumn("space", F.lit(0))


def local_outlier_factor(df: DataFrame, columns, n_neighbors=20, contamination="auto", name="outlier", scores="lof"):
    """Local outlier factor of every row and a flag: above 1.5, or the top ``contamination`` share."""
    cols = list(columns)
    pts = freeze(distinct_points(df, cols), "distinct")
    queries = pts.select(F.col("pid").alias("qid"), "space", "vec", F.lit(1.0).alias("scale"), F.col("pid").alias("self"))
    near = freeze(nearest(queries, pts.select("pid", "space", "vec", "n"), n_neighbors), "neighbours")
    kd = near.groupBy(F.col("qid").alias("pid")).agg(F.max("distance").alias("kd"))
    weight = F.col("n")
    reach = near.join(kd, "pid").withColumn("reach", F.greatest("kd", "distance"))
    lrd = freeze(reach.groupBy("qid").agg((1.0 / (F.sum(F.col("reach") * weight) / F.sum(weight) + 1e-10)).alias("lrd")), "density")
    other = lrd.select(F.col("qid").alias("pid"), F.col("lrd").alias("other"))
    lof = near.join(other, "pid").groupBy("qid").agg((F.sum(F.col("other") * weight) / F.sum(weight)).alias("mean_other"))
    lof = lof.join(lrd, "qid").select(F.col("qid").alias("pid"), (F.col("mean_other") / F.col("lrd")).alias(scores))
    table = freeze(pts.join(lof, "pid", "left").select(*cols, "n", scores), "lof")
    if contamination == "auto":
        cut = 1.5
    else:
        ranked = prefix_sum(table.where(F.col(scores).isNotNull()).groupBy(scores).agg(F.sum("n").alias("m")), F.col("m"), [scores])
        # The interpolated quantile of the scores of all rows.
        at = (F.col("_total") - 1) * (1 - contamination)
        covers = lambda place: (F.col("_before") <= place) & (place < F.col("_before") + F.col("m"))
        next_ = F.least(F.floor(at) + 1, F.col("_total") - 1)
        lo, hi, part = ranked.agg(F.min(F.when(covers(F.floor(at)), F.col(scores))), F.min(F.when(covers(next_), F.col(scores))), F.max(at - F.floor(at))).first()
        cut = None if lo is None else lo + (hi - lo) * part
    keyed = df.withColumns({f"_k_{c}": number(c) for c in cols})
    small = table.select(*[F.col(c).alias(f"_k_{c}") for c in cols], "n", scores)
    out = attach(keyed, keep(small, "lof"), [f"_k_{c}" for c in cols], [scores], weight="n").drop(*[f"_k_{c}" for c in cols])
    return out.withColumn(name, F.coalesce(F.col(scores) > F.lit(cut), F.lit(False)))


def knn_classify(train: DataFrame, test: DataFrame, target, features, key, k=5, weights="uniform", metric="euclidean"):
    """(key, Predicted_Class): majority of the k nearest training rows, ties to the smaller label."""
    cols = list(features)
    pts = freeze(distinct_points(train.withColumn("_label", F.col(target).cast("string")), cols, ["_label"]), "train")
    asked = test.select(key, *[number(c).alias(c) for c in cols]).na.drop(subset=cols)
    uniq = freeze(distinct_points(asked, cols), "asked")
    queries = uniq.select(F.col("pid").alias("qid"), "space", "vec", F.lit(1.0).alias("scale"), F.lit(None).cast("long").alias("self"))
    near = nearest(queries, pts.select("pid", "space", "vec", "n"), k, metric)
    vote = F.col("n") if weights == "uniform" else F.col("n") / F.greatest("distance", F.lit(1e-12))
    votes = near.join(pts.select("pid", "_label"), "pid").groupBy("qid", "_label").agg(F.sum(vote.cast("double")).alias("v"))
    best = votes.groupBy("qid").agg(F.min_by("_label", F.struct(-F.col("v"), F.col("_label"))).alias("Predicted_Class"))
    labelled = freeze(uniq.join(best.withColumnRenamed("qid", "pid"), "pid").select(*cols, "n", "Predicted_Class"), "votes")
    return attach(asked, keep(labelled, "votes"), cols, ["Predicted_Class"], weight="n").select(key, "Predicted_Class")


def fill_knn(df: DataFrame, columns, n_neighbors=5):
    """Fill each missing value with the mean of that column over the nearest rows that have it.

    Distances use the coordinates both rows have, scaled up by all / shared. Every pair of a
    query's and a donor's missing pattern is a space of its own; rows without a usable donor take
    the column mean.
    """
    cols = list(columns)
    base = df.select(*[number(c).alias(c) for c in cols]).groupBy(*cols).agg(F.count("*").alias("n"))
    mask = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in cols])
    rows = freeze(number_rows(base, cols, name="pid").withColumn("mask", mask), "patterns")
    masks = [r[0] for r in rows.select("mask").distinct().collect()]
    means = df.agg(*[F.avg(number(c)).alias(c) for c in cols]).first()
    new = {}
    filled = rows
    for t, c in enumerate(cols):
        spaces, i = [], 0
        for a in masks:
            if a[t] == "1":
                continue
            for b in masks:
                both = [j for j in range(len(cols)) if a[j] == b[j] == "1"]
                if b[t] == "1" and both:
                    spaces.append((i, a, b, both))
                    i += 1
        if not spaces:
            new[c] = F.coalesce(F.col(c), F.lit(means[c]))
            continue
        def side(which):
            out = None
            for s, a, b, both in spaces:
                some = rows.where(F.col("mask") == (a if which == "q" else b)).select("pid", F.lit(s).alias("space"), F.array(*[cols[j] for j in both]).alias("vec"),
                                  F.lit((len(cols) / len(both)) ** 0.5).alias("scale"), F.col("n"), F.col(c).alias("v"))
                out = some if out is None else out.unionByName(some)
            return out
        queries = side("q").select(F.col("pid").alias("qid"), "space", "vec", "scale", F.lit(None).cast("long").alias("self"))
        donors = side("p").select("pid", "space", "vec", "n")
        near = nearest(queries, donors, n_neighbors)
        got = near.join(rows.select("pid", F.col(c).alias("v")), "pid").groupBy("qid").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias(f"_f_{c}"))
        filled = filled.join(got.withColumnRenamed("qid", "pid"), "pid", "left")
        new[c] = F.coalesce(F.col(c), F.col(f"_f_{c}"), F.lit(means[c]))
    table = freeze(filled.select(*[F.col(c).alias(f"_k_{c}") for c in cols], "n", *[e.alias(f"_v_{c}") for c, e in new.items()]).where(
        F.greatest(*[F.col(f"_k_{c}").isNull() for c in cols], F.lit(False))), "filled")
    keyed = df.withColumns({f"_k_{c}": number(c) for c in cols})
    out = attach(keyed, keep(table, "filled"), [f"_k_{c}" for c in cols], [f"_v_{c}" for c in cols], weight="n")
    return out.select(*[F.coalesce(F.col(f"_k_{c}"), F.col(f"_v_{c}")).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])
