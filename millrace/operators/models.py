"""Training, scoring and storing of Spark ML models."""

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as mc
from pyspark.ml import clustering as mk
from pyspark.ml import regression as mr
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.metrics import classification_metrics, clustering_metrics, regression_metrics

# Boosting with more than two classes trains one booster per class.
CLASSIFIERS = {
    "logistic_regression": lambda **p: mc.LogisticRegression(**{"maxIter": 100, **p}),
    "decision_tree_classifier": lambda **p: mc.DecisionTreeClassifier(**p),
    "random_forest_classifier": lambda **p: mc.RandomForestClassifier(**{"numTrees": 100, **p}),
    "gradient_boosting_classifier": lambda **p: mc.GBTClassifier(**p),
    "naive_bayes": lambda **p: mc.NaiveBayes(**{"modelType": "gaussian", **p}),
    "neural_network": lambda **p: mc.MultilayerPerceptronClassifier(**p),
    "linear_svm": lambda **p: mc.LinearSVC(**p),
}
_TREES = ("decision_tree", "random_forest", "gradient_boosting")
ROWS_A_TASK = 1_000_000
_BINARY_ONLY = ("gradient_boosting_classifier", "linear_svm")


def _penalised(l1_ratio, per_row):
    """Linear model with penalty ``alpha`` on the weights in the units of the data.

    The fit divides its penalty by the target's deviation, which rescales the squared part only;
    that part is multiplied back here. ``per_row``: alpha belongs to a sum of squares (ridge).
    """

    def build(rows=1, deviation=1.0, alpha=1.0, l1_ratio=l1_ratio, **p):
        alpha = alpha / rows if per_row else alpha
        absolute, squared = alpha * l1_ratio, alpha * (1 - l1_ratio) * (deviation or 1.0)
        total = absolute + squared
        return mr.LinearRegression(regParam=total, elasticNetParam=absolute / total if total else 0.0, standardization=False, **p)

    build.needs_target = True
    return build


REGRESSORS = {
    "linear_regression": lambda **p: mr.LinearRegression(**p),
    "ridge": _penalised(0.0, True),
    "lasso": _penalised(1.0, False),
    "elastic_net": _penalised(0.5, False),
    "decision_tree_regressor": lambda **p: mr.DecisionTreeRegressor(**p),
    "random_forest_regressor": lambda **p: mr.RandomForestRegressor(**{"numTrees": 100, **p}),
    "gradient_boosting_regressor": lambda **p: mr.GBTRegressor(**p),
}
CLUSTERERS = {
    "kmeans": lambda **p: mk.KMeans(**p),
    "gaussian_mixture": lambda **p: mk.GaussianMixture(**p),
    # Divisive clustering stands in for the agglomerative one, which needs all pairwise distances.
    "hierarchical": lambda **p: mk.BisectingKMeans(**p),
}


@dataclass
class Trained:
    model: PipelineModel
    kind: str
    algorithm: str
    features: list
    target: str | None = None
    labels: list = field(default_factory=list)
    metadata: dict = field(default_factory=dict)


def assemble(df: DataFrame, columns, output="features"):
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="error").transform(df)


def kind_of(algorithm):
    for kind, table in (("classifier", CLASSIFIERS), ("regressor", REGRESSORS), ("clusterer", CLUSTERERS)):
        if algorithm in table:
            return kind
    raise ValueError(f"unknown algorithm {algorithm}")


def check_features(df: DataFrame, features):
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")


def _seeded(stage, seed):
    if stage.hasParam("seed"):
        stage.set(stage.getParam("seed"), seed)
    return stage


def _train_classifier(df, target, features, algorithm, seed, class_weight, params):
    text = "_target"
    df = df.withColumn(text, F.col(target).cast("string"))
    counts = df.groupBy(text).agg(F.count("*").alias("n")).collect()
    classes, total = len(counts), sum(r["n"] for r in counts)
    indexer = StringIndexer(inputCol=text, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)
    labels = list(indexer.labels)
    if algorithm == "neural_network":
        hidden = params.pop("hidden_layers", [16])
        params["layers"] = [len(features), *hidden, classes]
    stage = _seeded(CLASSIFIERS[algorithm](**params), seed)
    if class_weight == "balanced":
        weight = F.lit(None).cast("double")
        for r in counts:
            weight = F.when(F.col(text) == r[text], F.lit(total / (classes * r["n"]))).otherwise(weight)
        df = df.withColumn("_weight", weight)
        stage.setWeightCol("_weight")
    stage.setFeaturesCol("_features").setLabelCol("_label").setPredictionCol("_prediction")
    if algorithm in _BINARY_ONLY and classes > 2:
        stage = mc.OneVsRest(classifier=stage, featuresCol="_features", labelCol="_label", predictionCol="_prediction")
    back = IndexToString(inputCol="_prediction", outputCol="_class", labels=labels)
    data = spread(indexer.transform(df).drop(text), total, algorithm)
    # The label index drops its spare category, which no training row uses.
    stages = [VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="error"), stage, back]
    model = Pipeline(stages=stages).fit(_clean_label(data))
    return model, labels, {"classes": classes, "class_counts": {r[text]: r["n"] for r in counts}}


def _clean_label(df):
    """Drop the nominal attribute of the label column, whose extra category would count as a class."""
    return df.withColumn("_label", F.col("_label") + F.lit(0.0))


def importance_of(model, features):
    """(feature, importance) in falling order: impurity importances or absolute coefficients."""
    last = next((s for s in reversed(model.stages) if hasattr(s, "predict") or hasattr(s, "featureImportances") or hasattr(s, "coefficients")), None)
    if last is None:
        return []
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray().tolist()
    elif isinstance(last, mc.LogisticRegressionModel):
        m = last.coefficientMatrix.toArray()
        values = abs(m).mean(axis=0).tolist()
    elif hasattr(last, "coefficients"):
        values = [abs(v) for v in last.coefficients.toArray().tolist()]
    else:
        return []
    return sorted(zip(features, values), key=lambda x: -x[1])


def spread(df: DataFrame, rows, algorithm):
    """Rows for a tree learner, which caches them at some 330 bytes each: at most about ROWS_A_TASK in a partition.

    A file split holds as many rows as their compressed columns, read or not, fit in.
    """
    if not algorithm.startswith(_TREES) or rows <= ROWS_A_TASK:
        return df
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK)))


def train_model(df: DataFrame, target, features, algorithm, seed=42, class_weight=None, **params) -> Trained:
    """Fit a registered algorithm on ``features``; clusterers take no target."""
    kind, features = kind_of(algorithm), list(features)
    check_features(df, features)
    df = df.select(*features, *([target] if target and target not in features else []))
    if kind == "classifier":
        model, labels, extra = _train_classifier(df, target, features, algorithm, seed, class_weight, dict(params))
        meta = {**extra, "n": sum(extra["class_counts"].values())}
    else:
        labels = []
        build = (REGRESSORS if kind == "regressor" else CLUSTERERS)[algorithm]
        meta = {}
        if kind == "regressor":
            y = F.col(target).cast("double")
            row = df.agg(F.count("*").alias("n"), F.min(y).alias("min"), F.max(y).alias("max"), F.avg(y).alias("mean"), F.stddev(y).alias("std"), F.stddev_pop(y).alias("deviation")).first()
            meta = {"n": row["n"], "target_stats": {k: row[k] for k in ("min", "max", "mean", "std")}}
            df = spread(df.withColumn("_label", y), row["n"], algorithm)
        stage = build(rows=row["n"], deviation=row["deviation"], **params) if getattr(build, "needs_target", False) else build(**params)
        stage = _seeded(stage, seed).setFeaturesCol("_features").setPredictionCol("_prediction")
        if kind == "regressor":
            stage.setLabelCol("_label")
        model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="error"), stage]).fit(df)
        if kind == "clusterer":
            last = model.stages[-1]
            sizes = model.transform(df).groupBy("_prediction").agg(F.count("*").alias("n")).collect()
            meta = {"n": sum(r["n"] for r in sizes), "sizes": {int(r["_prediction"]): r["n"] for r in sizes}}
            if hasattr(last, "clusterCenters"):
                meta["centres"] = [[float(v) for v in c] for c in last.clusterCenters()]
    meta["feature_importance"] = importance_of(model, features)
    meta.update(algorithm=algorithm, features=features, target=target, params={k: str(v) for k, v in params.items()})
    return Trained(model, kind, algorithm, features, target, labels, meta)



def score(trained: Trained, df: DataFrame, before=(), after=()):
    """Append Predicted_Class and Probability_Class_*, Predicted_Value or Predicted_Cluster.

    ``before`` and ``after`` are DataFrame -> DataFrame hooks. Works on streaming tables as well.
    """
    for hook in before:
        df = hook(df)
    check_features(df, trained.features)
    kept = df.columns
    out = trained.model.transform(df)
    if trained.kind == "classifier":
        new = [F.col("_class").alias("Predicted_Class")]
        if "probability" in out.columns:
            p = vector_to_array("probability")
            new += [F.get(p, i).alias(f"Probability_Class_{l}") for i, l in enumerate(trained.labels)]
    elif trained.kind == "regressor":
        new = [F.col("_prediction").alias("Predicted_Value")]
    else:
        new = [F.col("_prediction").cast("int").alias("Predicted_Cluster")]
    out = out.select(*[F.col(f"`{c}`") for c in kept], *new)
    for hook in after:
        out = hook(out)
    return out


def evaluate(trained: Trained, df: DataFrame, names=None) -> DataFrame:
    """One-row metric table of a model on a table; of a regressor only the metrics in ``names``, when given."""
    scored = score(trained, df)
    if trained.kind == "classifier":
        positive = trained.labels[-1]
        return classification_metrics(scored.withColumn("_y", F.col(trained.target).cast("string")), "_y", "Predicted_Class", positive)
    if trained.kind == "regressor":
        return regression_metrics(scored, trained.target, "Predicted_Value", names)
    return clustering_metrics(scored, "Predicted_Cluster", trained.features)


def export_selection(scored: DataFrame, inputs=(), keep_inputs=False, keep_probabilities=True):
    out = scored if keep_inputs else scored.drop(*inputs)
    return out if keep_probabilities else out.drop(*[c for c in out.columns if c.startswith("Probability_Class_")])


def centre_distances(df: DataFrame, features, centres, key):
    """(key, cluster, distance) to every centre, nearest first within a row; centres are literals."""
    items = []
    for i, c in enumerate(centres):
        d2 = F.lit(0.0)
        for f, v in zip(features, c):
            d2 = d2 + (F.col(f) - F.lit(float(v))) * (F.col(f) - F.lit(float(v)))
        items.append(F.struct(F.sqrt(d2).alias("distance"), F.lit(i).alias("cluster")))
    return df.select(key, F.posexplode(F.array_sort(F.array(*items))).alias("rank", "d")).select(key, "rank", "d.cluster", "d.distance")


def linear_estimator(task, df, target, strength=1.0):
    """Fit for feature elimination: absolute coefficients of a logistic model or a lasso."""

    def fit(assembled):
        if task == "classification":
            data = StringIndexer(inputCol="_t", outputCol="_label", stringOrderType="alphabetAsc").fit(
                assembled.withColumn("_t", F.col(target).cast("string"))).transform(assembled.withColumn("_t", F.col(target).cast("string")))
            m = mc.LogisticRegression(featuresCol="features", labelCol="_label", maxIter=100, regParam=strength / max(1, df.count()), standardization=False).fit(data)
            return abs(m.coefficientMatrix.toArray()).sum(axis=0).tolist()
        data = assembled.withColumn("_label", F.col(target).cast("double"))
        m = mr.LinearRegression(featuresCol="features", labelCol="_label", regParam=strength, elasticNetParam=1.0, standardization=False).fit(data)
        return [abs(v) for v in m.coefficients.toArray().tolist()]

    return fit


def save_model(trained: Trained, path):
    """Store the fitted stages and a one-line JSON description under ``path``."""
    trained.model.write().overwrite().save(f"{path}/model")
    info = {"type": trained.kind, "algorithm": trained.algorithm, "features": trained.features, "target": trained.target, "labels": trained.labels,
            "timestamp": datetime.now(timezone.utc).isoformat(), "metadata": trained.metadata}
    _active().range(1).select(F.lit(json.dumps(info)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/description")


def _active():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def load_model(path, expected=None) -> Trained:
    spark = _active()
    info = json.loads(spark.read.text(f"{path}/description").first()[0])
    if expected and info["type"] != expected:
        raise ValueError(f"stored model is a {info['type']}, not a {expected}")
    return Trained(PipelineModel.load(f"{path}/model"), info["type"], info["algorithm"], info["features"], info["target"], info["labels"], info["metadata"])
