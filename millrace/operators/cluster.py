"""Density clustering (DBSCAN) and cluster labels as features."""

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.columns import numeric_or
from millrace.operators.knn import CHUNK, distances, distinct_points
from millrace.plans.lookup import attach
from millrace.plans.ordered import number_rows
from millrace.plans.quantiles import number
from millrace.plans.sizing import freeze, keep

GRID_DIMENSIONS = 3


def _grid(df, cols, eps):
    """Cells of side eps over the (up to three) columns with the widest range."""
    row = df.agg(*[(F.max(c) - F.min(c)).alias(c) for c in cols]).first()
    wide = sorted(cols, key=lambda c: -(row[c] or 0.0))[:GRID_DIMENSIONS]
    index = [F.floor(F.col(c) / F.lit(eps)).cast("long") for c in wide]
    own = F.array(*index)
    around = F.array(*[F.array(*[i + F.lit(int(o)) for i, o in zip(index, off)]) for off in product((-1, 0, 1), repeat=len(wide))])
    return own, around


def _eps_blocks(queries, points, block, schema, chunk):
    """Compare queries with the points of their own and adjacent cells, chunk by chunk."""
    counts = points.groupBy("cell").agg(F.ceil(F.count("*") / chunk).cast("int").alias("pp"))
    qcounts = queries.groupBy("cell").agg(F.ceil(F.count("*") / chunk).cast("int").alias("qp"))
    pieces = keep(counts.join(qcounts, "cell"), "pieces")
    spread = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    place = lambda k: F.pmod(F.xxhash64("pid", F.lit(5)), F.col(k)).cast("int")
    q = attach(queries, pieces, ["cell"], ["pp", "qp"]).where("pp is not null").withColumn("qc", place("qp")).withColumn("pc", spread("pp")).drop("pp", "qp")
    p = attach(points, pieces, ["cell"], ["pp", "qp"]).where("qp is not null").withColumn("pc", place("pp")).withColumn("qc", spread("qp")).drop("pp", "qp")
    keys = ["cell", "pc", "qc"]
    text = lambda d: d.withColumn("cell", F.concat_ws(",", "cell"))
    p = text(p)
    return text(q).groupBy(*keys).cogroup(p.toDF(*p.columns).groupBy(*keys)).applyInPandas(block, schema)


def connected_components(nodes: DataFrame, edges: DataFrame):
    """(node, component): the smallest node that is reachable, by label spreading and jumping."""
    both = freeze(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = freeze(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hop = labels.join(seen, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        # A label is itself a node: take over the label that node has reached.
        roots = hop.select(F.col("node").alias("label"), F.col("label").alias("root"))
        after = freeze(hop.join(roots, "label", "left").select("node", "old", F.least("label", "root").alias("label")), "labels")
        if after.where("old != label").limit(1).count() == 0:
            return after.select("node", F.col("label").alias("component"))
        labels = after.select("node", "label")


def dbscan(df: DataFrame, columns, eps=0.5, min_samples=5, name="cluster"):
    """Cluster number per row, -1 for noise.

    Copies are merged into weights. Points of one micro-cell (diagonal eps) are mutual neighbours,
    so links are found between micro-cells only and no list of point pairs is built. Clusters are
    numbered by their smallest point; a border point joins the first cluster with a core point in
    reach.
    """
    cols = numeric_or(df, columns)
    eps = float(eps)
    pts = freeze(distinct_points(df, cols), "distinct")
    own, around = _grid(pts, cols, eps)
    side = eps / len(cols) ** 0.5
    micro = F.concat_ws(",", *[F.floor(F.col(c) / F.lit(side)).cast("string") for c in cols])
    base = freeze(pts.select("pid", "vec", "n", own.alias("cell"), around.alias("cells"), micro.alias("micro")), "gridded")
    chunk = max(16, int(df.sparkSession.conf.get("millrace.knnChunk", str(CHUNK))))
    near = lambda d: d.select("*", F.explode("cells").alias("c")).drop("cell", "cells").withColumnRenamed("c", "cell")

    def matrix(q, p):
        return distances(np.stack(q["vec"].to_numpy()).astype(float), np.stack(p["vec"].to_numpy()).astype(float)) <= eps * (1 + 1e-12)

    def count(q, p):
        if not len(q) or not len(p):
            return pd.DataFrame({"pid": [], "m": []})
        return pd.DataFrame({"pid": q["pid"].to_numpy(), "m": matrix(q, p) @ p["n"].to_numpy()})

    degree = _eps_blocks(near(base), base.drop("cells"), count, "pid long, m long", chunk).groupBy("pid").agg(F.sum("m").alias("m"))
    cores = freeze(base.join(degree.where(F.col("m") >= min_samples).select("pid"), "pid"), "cores")

    def link(q, p):
        if not len(q) or not len(p):
            return pd.DataFrame({"a": [], "b": []})
        i, j = np.nonzero(matrix(q, p))
        a, b = q["micro"].to_numpy()[i], p["micro"].to_numpy()[j]
        return pd.DataFrame({"a": a[a < b], "b": b[a < b]}).drop_duplicates()

    edges = _eps_blocks(near(cores), cores.drop("cells"), link, "a string, b string", chunk).distinct()
    nodes = cores.groupBy(F.col("micro").alias("node")).agg(F.min("pid").alias("first"))
    comp = freeze(connected_components(nodes, edges).join(nodes, "node"), "components")
    order = number_rows(comp.groupBy("component").agg(F.min("first").alias("first")), ["first"], name="number").select("component", (F.col("number") - 1).cast("int").alias("label"))
    micro_label = comp.join(order, "component").select(F.col("node").alias("micro"), "label")
    labelled = freeze(cores.join(micro_label, "micro"), "labelled")
    rest = base.join(cores.select("pid"), "pid", "left_anti")

    def reach(q, p):
        if not len(q) or not len(p):
            return pd.DataFrame({"pid": [], "label": []})
        hit = np.where(matrix(q, p), p["label"].to_numpy()[None, :], np.iinfo("int32").max).min(1)
        ok = hit < np.iinfo("int32").max
        return pd.DataFrame({"pid": q["pid"].to_numpy()[ok], "label": hit[ok]})

    border = _eps_blocks(near(rest), labelled.drop("cells"), reach, "pid long, label int", chunk).groupBy("pid").agg(F.min("label").alias("label"))
    every = labelled.select("pid", "label").unionByName(border)
    table = freeze(pts.join(every, "pid", "left").select(*[F.col(c).alias(f"_k_{c}") for c in cols], "n", F.coalesce("label", F.lit(-1)).alias(name)), "clusters")
    keyed = df.withColumns({f"_k_{c}": number(c) for c in cols})
    return attach(keyed, keep(table, "clusters"), [f"_k_{c}" for c in cols], [name], weight="n").drop(*[f"_k_{c}" for c in cols])


def cluster_labels(df: DataFrame, columns=None, method="kmeans", n_clusters=5, seed=42, name="cluster", **params):
    """Append a cluster label: kmeans, gmm, hierarchical (divisive) or dbscan."""
    from millrace.operators.models import score, train_model

    cols = numeric_or(df, columns)
    if method == "dbscan":
        return dbscan(df, cols, name=name, **params)
    algorithm = {"kmeans": "kmeans", "gmm": "gaussian_mixture", "hierarchical": "hierarchical"}.get(method)
    if algorithm is None:
        raise ValueError(f"unknown clustering {method}")
    trained = train_model(df, None, cols, algorithm, seed=seed, k=n_clusters, **params)
    return score(trained, df).withColumnRenamed("Predicted_Cluster", name)
