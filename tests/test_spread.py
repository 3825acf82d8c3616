"""Tree learners cache rows in partitions of bounded size."""

from pyspark.sql import functions as F

from millrace.operators import models


def test_tree_learners_get_bounded_partitions(spark, monkeypatch):
    df = spark.range(0, 5000, 1, 2).select((F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 2).alias("y"))
    seen = []
    fit = models.Pipeline.fit
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, data: seen.append(data.rdd.getNumPartitions()) or fit(self, data))
    monkeypatch.setattr(models, "ROWS_A_TASK", 250)
    for algorithm in ("decision_tree_regressor", "decision_tree_classifier"):
        models.train_model(df, "y", ["x"], algorithm, maxDepth=2)
    models.train_model(df, "y", ["x"], "linear_regression")
    assert seen == [20, 20, 2]
