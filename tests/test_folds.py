"""Scores over folds: one assignment, only the metrics that are asked for, shares of the training rows in few passes."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import metrics, search, select
from millrace.plans.quota import flag_quota, order_hash, training_cuts


@pytest.fixture
def rows(spark):
    return spark.range(2000).select("id", (F.col("id") % 37).cast("double").alias("x"), (F.col("id") % 11).cast("double").alias("z")).withColumn("y", F.col("x") * 3 + F.col("z") * 0.1)


@pytest.fixture
def no_median(monkeypatch):
    def fail(*a):
        raise AssertionError("a quantile that nobody asked for")

    monkeypatch.setattr(metrics, "column_quantiles", fail)


def test_metrics_by_name(rows):
    every = metrics.regression_metrics(rows, "y", "x").first().asDict()
    assert metrics.regression_metrics(rows, "y", "x", ("r2", "median_ae")).first().asDict() == {k: every[k] for k in ("r2", "median_ae")}


def test_curve_needs_its_metric_only(rows, no_median):
    got = search.learning_curve(rows, "y", ["x"], "linear_regression", "id", sizes=(0.1, 1.0), folds=2).collect()
    assert [(r["fraction"], r["n_train"]) for r in got] == [(0.1, 100), (1.0, 1000)]
    assert all(r["test_mean"] > 0.99 for r in got)


def test_search_needs_its_metric_only(rows, no_median):
    got = search.grid_search(rows, "y", ["x"], "ridge", "id", {"alpha": [1.0, 1e9]}, folds=2).collect()
    assert [r["rank"] for r in got] == [1, 2] and got[0]["params"] == '{"alpha": 1.0}'


def test_cuts_take_the_rows_of_the_quota(rows):
    table = search.fold_table(rows, "y", ["id"], "id", 3).withColumn("_order", order_hash(["id"], 7))
    shares = (0.0, 0.1, 0.33, 1.0)
    cuts = training_cuts(table, shares)
    for i in range(3):
        train = table.where(F.col("fold") != i)
        for s in shares:
            old = flag_quota(train, ["id"], F.ceil(F.col("_rows") * F.lit(s)), seed=7).where("_picked")
            new = train.where(F.col("_order") <= F.lit(cuts.get((i, s))).cast("long"))
            assert sorted(r["id"] for r in old.collect()) == sorted(r["id"] for r in new.collect())
            assert new.count() == math.ceil(train.count() * s)


def test_folds_are_assigned_once(rows, no_median, monkeypatch):
    calls = []
    assign = search.assign_folds
    monkeypatch.setattr(search, "assign_folds", lambda *a, **k: calls.append(1) or assign(*a, **k))
    assert select.select_sequentially(rows, "y", "id", ["x", "z"], n_features=1, folds=2).columns == ["id", "x", "y"]
    assert len(calls) == 1
