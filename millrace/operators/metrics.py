"""Evaluation of predictions: everything is computed from small count tables or one aggregate."""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.columns import string_columns
from millrace.operators.profile import value_range
from millrace.plans import batches
from millrace.plans.ordered import prefix_sum
from millrace.plans.quantiles import column_quantiles, number
from millrace.plans.sizing import freeze, keep


def _sum(*terms):
    return reduce(lambda a, b: a + b, terms)


def confusion_counts(df: DataFrame, actual, predicted):
    """(actual, predicted, count) of the labels that occur."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("count"))


def confusion_matrix(df: DataFrame, actual, predicted, normalize=False):
    """Counts for every label pair, zeros included; normalised rows are rounded to 3 decimals."""
    counts = keep(confusion_counts(df, actual, predicted), "confusion")
    labels = counts.select(F.col("actual").alias("l")).union(counts.select("predicted")).distinct()
    grid = _label_grid(labels)
    dense = grid.join(counts, ["actual", "predicted"], "left").na.fill(0, ["count"])
    if not normalize:
        return dense
    total = F.sum("count").over(Window.partitionBy("actual"))
    return dense.withColumn("share", F.round(F.coalesce(F.try_divide(F.col("count"), total), F.lit(0.0)), 3)).drop("count")


def _label_grid(labels):
    """All label pairs."""
    return labels.select(F.col("l").alias("actual")).crossJoin(labels.select(F.col("l").alias("predicted")))


def _class_table(counts):
    """Per label: support, predicted count, hits."""
    rows = counts.groupBy(F.col("actual").alias("label")).agg(F.sum("count").alias("support"))
    cols = counts.groupBy(F.col("predicted").alias("label")).agg(F.sum("count").alias("predicted"))
    hits = counts.where("actual = predicted").select(F.col("actual").alias("label"), F.col("count").alias("hits"))
    table = rows.join(cols, "label", "full").join(hits, "label", "left").na.fill(0, ["support", "predicted", "hits"])
    p = F.coalesce(F.try_divide(F.col("hits"), F.col("predicted")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("hits"), F.col("support")), F.lit(0.0))
    return table.select("label", "support", "predicted", "hits", p.alias("precision"), r.alias("recall"),
                        F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def classification_report(df: DataFrame, actual, predicted):
    """precision, recall, f1, support per class, then accuracy, macro and weighted averages."""
    table = keep(_class_table(confusion_counts(df, actual, predicted)), "classes")
    label = F.col("label").cast("string").alias("label")
    each = table.select(label, "precision", "recall", "f1", "support")
    n = F.sum("support")
    macro = table.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), n.alias("support"))
    weigh = lambda c: (F.sum(F.col(c) * F.col("support")) / n).alias(c)
    weighted = table.agg(weigh("precision"), weigh("recall"), weigh("f1"), n.alias("support"))
    acc = F.sum("hits") / n
    accuracy = table.agg(acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), n.alias("support"))
    name = lambda t, s: t.select(F.lit(s).alias("label"), "precision", "recall", "f1", "support")
    return each.unionByName(name(accuracy, "accuracy")).unionByName(name(macro, "macro avg")).unionByName(name(weighted, "weighted avg"))


def binary_rates(df: DataFrame, actual, predicted, positive=1):
    """Counts and rates of the two-by-two table."""
    a, p = F.col(actual) == F.lit(positive), F.col(predicted) == F.lit(positive)
    row = df.agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
    d = lambda x, y: F.try_divide(F.col(x), F.col(x) + F.col(y))
    return row.select("tp", "fp", "fn", "tn", d("tp", "fn").alias("sensitivity"), d("tn", "fp").alias("specificity"), d("fp", "tn").alias("false_positive_rate"),
                      d("fn", "tp").alias("false_negative_rate"), d("tp", "fp").alias("precision"), d("tn", "fn").alias("negative_predictive_value"))


def classification_metrics(df: DataFrame, actual, predicted, positive=1):
    """accuracy, precision, recall, f1: of the positive class when binary, else weighted by support."""
    table = keep(_class_table(confusion_counts(df, actual, predicted)), "classes")
    n = F.sum("support")
    accuracy = (F.sum("hits") / n).alias("accuracy")
    if table.count() <= 2:
        pick = lambda c: F.coalesce(F.max(F.when(F.col("label") == F.lit(positive), F.col(c))), F.lit(0.0)).alias(c)
        return table.agg(accuracy, pick("precision"), pick("recall"), pick("f1"))
    weigh = lambda c: (F.sum(F.col(c) * F.col("support")) / n).alias(c)
    return table.agg(accuracy, weigh("precision"), weigh("recall"), weigh("f1"))


def score_counts(df: DataFrame, actual, score, positive=1):
    hit = F.col(actual) == F.lit(positive)
    return df.where(F.col(score).isNotNull() & F.col(actual).isNotNull()).groupBy(number(score).alias("threshold")).agg(
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))


def curve_counts(df: DataFrame, actual, score, positive=1):
    """Per distinct score, from the highest: true and false positives at ``score >= threshold``."""
    counts = keep(score_counts(df, actual, score, positive), "scores")
    tp = prefix_sum(counts, F.col("pos"), ["-threshold"], before="_tp", total="P")
    both = prefix_sum(tp, F.col("neg"), ["-threshold"], before="_fp", total="N")
    return both.select("threshold", (F.col("_tp") + F.col("pos")).alias("tp"), (F.col("_fp") + F.col("neg")).alias("fp"), "P", "N", "pos", "neg")


def roc_curve(df: DataFrame, actual, score, positive=1):
    """threshold, fpr, tpr; the curve starts at (0, 0) with an infinite threshold."""
    c = curve_counts(df, actual, score, positive)
    curve = c.select("threshold", F.try_divide(F.col("fp"), F.col("N")).alias("fpr"), F.try_divide(F.col("tp"), F.col("P")).alias("tpr"))
    start = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(curve)


def precision_recall_curve(df: DataFrame, actual, score, positive=1):
    """threshold, precision, recall; ends at precision 1, recall 0 without a threshold."""
    c = curve_counts(df, actual, score, positive)
    curve = c.select("threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide(F.col("tp"), F.col("P")).alias("recall"))
    end = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return curve.unionByName(end)


def auc(df: DataFrame, actual, score, positive=1):
    """Area under the ROC curve by rank sums (ties count half) and average precision."""
    c = curve_counts(df, actual, score, positive)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    roc = F.try_divide(F.sum(neg * (F.col("tp") - F.col("pos")) + neg * pos / 2), F.max(F.col("P").cast("double") * F.col("N")))
    ap = F.sum(pos / F.col("P") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return c.agg(roc.alias("roc_auc"), ap.alias("average_precision"))


def auc_one_vs_rest(df: DataFrame, actual, scores: dict):
    """(label, roc_auc) for every label with its own score column, and their mean as 'macro'."""
    out = None
    for label, column in scores.items():
        one = auc(df, actual, column, label).select(F.lit(str(label)).alias("label"), "roc_auc")
        out = one if out is None else out.unionByName(one)
    return out.unionByName(out.agg(F.lit("macro").alias("label"), F.avg("roc_auc").alias("roc_auc")).select("label", "roc_auc"))


def best_threshold(df: DataFrame, actual, score, positive=1):
    """Threshold with the largest tpr - fpr (ties: the highest threshold)."""
    return roc_curve(df, actual, score, positive).orderBy(F.desc(F.col("tpr") - F.col("fpr")), F.desc("threshold")).limit(1)


def log_loss(df: DataFrame, actual, score, positive=1, eps=1e-15):
    """Mean negative log likelihood of a binary target; rows without target or score are left out."""
    p = F.least(F.greatest(number(score), F.lit(eps)), F.lit(1 - eps))
    known = df.where(F.col(actual).isNotNull() & number(score).isNotNull())
    return known.agg(F.avg(-F.ln(F.when(F.col(actual) == F.lit(positive), p).otherwise(1 - p))).alias("log_loss"))


def regression_metrics(df: DataFrame, actual, predicted, names=None):
    """mse, rmse, mae, r2, median absolute error, mape (zero targets skipped), explained variance, residual mean and std.

    All of them, or those in ``names``. The median alone needs passes of its own over the rows.
    """
    y, p = number(actual), number(predicted)
    both = df.where(y.isNotNull() & p.isNotNull()).select(y.alias("y"), (y - p).alias("r"))
    abs_r = F.abs("r")
    wanted = lambda n: names is None or n in names
    median = column_quantiles(both.select(abs_r.alias("a")), ["a"], [0.5])["a"][0] if wanted("median_ae") else None
    mse = F.avg(F.col("r") * F.col("r"))
    every = {
        "mse": mse, "rmse": F.sqrt(mse), "mae": F.avg(abs_r), "r2": 1 - F.try_divide(mse, F.var_pop("y")),
        "median_ae": F.lit(median), "mape": F.avg(F.when(F.col("y") != 0, abs_r / F.abs("y")) * 100),
        "explained_variance": 1 - F.try_divide(F.var_pop("r"), F.var_pop("y")), "residual_mean": F.avg("r"), "residual_std": F.stddev("r")}
    return both.agg(*[e.alias(n) for n, e in every.items() if wanted(n)])


def compare_models(rows, metric, higher_is_better=True):
    """Stack one-row metric tables {name: table} and mark the best by ``metric``."""
    stacked = reduce(lambda a, b: a.unionByName(b), [t.select(F.lit(n).alias("model"), "*") for n, t in rows.items()])
    kept = keep(stacked, "metrics")
    pick = F.max(metric) if higher_is_better else F.min(metric)
    best = kept.agg(pick).first()[0]
    return kept.withColumn("best", F.col(metric) == F.lit(best))


def top_confusions(df: DataFrame, actual, predicted, k=5):
    counts = confusion_counts(df, actual, predicted).where("actual != predicted")
    return counts.orderBy(F.desc("count"), "actual", "predicted").limit(k)


def error_rates(df: DataFrame, actual, predicted):
    """Errors and error rate per true class."""
    wrong = F.count_if(F.col(actual) != F.col(predicted))
    return df.groupBy(F.col(actual).alias("label")).agg(F.count("*").alias("total"), wrong.alias("errors"), (wrong / F.count("*")).alias("error_rate"))


def error_by_range(df: DataFrame, actual, predicted, bins=5):
    """Error summary per equal-width bin of the target."""
    lo, hi = value_range(df, [actual])[actual]
    width = (hi - lo) / bins
    y, p = number(actual), number(predicted)
    e = F.abs(y - p)
    out = df.where(y.isNotNull()).groupBy(_right_closed(y, lo, width, bins).alias("bin")).agg(
        F.count("*").alias("count"), F.avg(e).alias("mean_absolute_error"), F.stddev(e).alias("std_absolute_error"), F.avg(y - p).alias("mean_error"))
    return out.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("low"), (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
                      "count", "mean_absolute_error", "std_absolute_error", "mean_error")


def _right_closed(v, lo, width, bins):
    """Equal-width bin with right-closed edges, the lowest value included."""
    index = F.lit(0)
    for i in range(1, bins):
        index = index + F.when(v > F.lit(lo + i * width), 1).otherwise(0)
    return index


def _silhouette():
    """From the mean squared distances of against_centres; 0 for the only row of a cluster."""
    return F.coalesce(F.try_divide(F.col("_other") - F.col("_own"), F.greatest("_own", "_other")), F.lit(0.0))


def _squared_gap(vector, point):
    point = F.array(*[F.lit(float(v)) for v in point])
    return F.aggregate(F.zip_with(vector, point, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)


def _worst_ratios(classes: DataFrame, width):
    """(g, worst): the greatest (s_a + s_b) / distance of the centres, over the other clusters, in blocks of centres."""
    out = classes.select("g", "mean", "dist", F.lit(0.0).alias("worst"))
    for rows in batches.centre_blocks(classes, width, ["mean", "dist"]):
        if not rows:
            continue
        sent = classes.sparkSession.sparkContext.broadcast((np.array([r["mean"] for r in rows]), np.array([r["dist"] for r in rows])))

        def run(parts, sent=sent):
            mean, dist = sent.value
            for b in parts:
                own, spread, worst = batches.rows_of(b.column("mean"), width), b.column("dist").to_numpy(), b.column("worst").to_numpy().copy()
                step = max(1, batches.HELD_BYTES // (8 * len(dist)))
                for s in range(0, len(own), step):
                    some = own[s : s + step]
                    gap = np.sqrt(np.stack([((mean - x) ** 2).sum(1) for x in some]))
                    ratio = np.where(gap > 0, (spread[s : s + step, None] + dist[None, :]) / np.where(gap > 0, gap, 1.0), 0.0)
                    worst[s : s + step] = np.maximum(worst[s : s + step], ratio.max(1))
                yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(worst)], names=b.schema.names)

        out = out.mapInArrow(run, batches.ddl(out))
    return out.select("g", "worst")


def clustering_metrics(df: DataFrame, cluster, features, noise=-1):
    """Clusters, silhouette (squared distances), Davies-Bouldin and Calinski-Harabasz of the complete rows.

    Counts, means and spreads of the clusters are merged from Arrow batches; one more pass compares every row
    with the centres. With fewer than two clusters, or with noise points, the scores are undefined (NULL).
    """
    cols, width = list(features), len(features)
    classes, _ = batches.class_statistics(df, cols, cluster)
    # Labels of text are compared as text.
    is_noise = F.col("g").eqNullSafe(F.lit(str(noise) if "g" in string_columns(classes) else noise))
    own, noisy = classes.agg(F.count(F.when(~is_noise, 1)), F.count(F.when(is_noise, 1))).first()
    if own < 2 or noisy:
        null = F.lit(None).cast("double")
        return df.sparkSession.range(1).select(F.lit(own).alias("clusters"), null.alias("silhouette"), null.alias("davies_bouldin"), null.alias("calinski_harabasz"))
    rows = batches.vectors(df, cols, F.col(cluster).alias("_g"))
    compared = batches.against_centres(rows, "_g", classes, width).select("_g", "_gap", _silhouette().alias("_s"))
    per = freeze(compared.groupBy("_g").agg(F.count("*").alias("rows"), F.avg("_gap").alias("dist"), F.sum("_s").alias("s")), "spread")
    joined = freeze(classes.join(per, F.col("g").eqNullSafe(F.col("_g"))).select("g", "n", "within", "mean", "dist", "s"), "classes")
    within, s = joined.agg(F.sum("within"), F.sum("s")).first()
    n, middle = batches.overall(joined, width)
    between = joined.agg(F.sum(F.col("n") * _squared_gap("mean", middle))).first()[0]
    worst = _worst_ratios(joined, width).agg(F.avg("worst")).first()[0]
    ch = (between / (own - 1)) / (within / (n - own)) if within and n > own else None
    return df.sparkSession.range(1).select(
        F.lit(own).alias("clusters"), F.lit(s / n).cast("double").alias("silhouette"), F.lit(worst).cast("double").alias("davies_bouldin"), F.lit(ch).cast("double").alias("calinski_harabasz"))


def silhouette_samples(df: DataFrame, cluster, features):
    """Squared-Euclidean silhouette of every row, from counts, means and spreads of the clusters; 0 for incomplete rows."""
    cols = list(features)
    classes, _ = batches.class_statistics(df, cols, cluster)
    x = F.array(*[number(c) for c in cols])
    rows = df.withColumn("_x", F.when(~F.exists(x, lambda v: v.isNull()), x))
    out = batches.against_centres(rows, cluster, classes, len(cols))
    return out.withColumn("silhouette", _silhouette()).drop("_x", "_own", "_other", "_gap")
