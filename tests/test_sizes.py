"""Plans whose cost must not run away with the number of columns or rows."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from millrace.operators import corr, reduce
from millrace.plans.ordered import number_rows
from millrace.plans.sizing import is_small, slices
from millrace.plans.spec import fit_transform
from millrace.sources import images


def test_kernel_components_of_many_columns(spark):
    x = np.random.default_rng(5).normal(size=(80, 64))
    cols = [f"e{i}" for i in range(64)]
    df = spark.createDataFrame(pd.DataFrame({"v": list(x)}), "v array<double>").select(*[F.get("v", i).alias(c) for i, c in enumerate(cols)])
    began = time.time()
    out = reduce.kernel_pca(df, cols, 2, landmarks=40).select("kpca_component_1", "kpca_component_2").collect()
    assert len(out) == 80 and all(np.isfinite(list(r)).all() for r in out)
    assert time.time() - began < 40


def test_rank_correlation_of_millions_of_rows(spark):
    df = spark.range(2_500_000).select((F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 50 * 2).cast("double").alias("b"))
    assert abs(corr.correlations(df, ["a", "b"], "spearman").first()["correlation"] - 1) < 1e-12


def test_row_numbers_of_many_rows_are_cut_into_slices(spark):
    df = spark.range(10_000_000).toDF("k")
    # A plan with one window over all rows would need one task for them.
    assert not is_small(df) and slices(df) >= 38
    assert slices(df.crossJoin(spark.range(1000).toDF("j"))) < 1000
    row = number_rows(df, ["-k"]).agg(F.max("row_number").alias("n"), F.count_if(F.col("row_number") + F.col("k") != 10_000_000).alias("off")).first()
    assert (row["n"], row["off"]) == (10_000_000, 0)


def test_stop_words_are_looked_up_by_hash(spark):
    df = spark.createDataFrame([("The cat's on THE mat, and it isn't l'eau",), (None,), ("",)], "t string")
    out = fit_transform("text_features", df, ["t"], features=["stopword_count"])
    assert "INSET" in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r["t_stopword_count"] for r in out.collect()] == [6, 0, 0]


def test_histograms_come_in_small_batches(spark, monkeypatch):
    assert [len(p) for p in images._few([pd.DataFrame({"a": range(2 * images.PICTURES + 1)})])] == [images.PICTURES, images.PICTURES, 1]
    monkeypatch.setattr(images, "PICTURES", 2)
    df = spark.range(0, 7, 1, 1).select("id", F.struct(F.lit(1).alias("height"), F.lit(2).alias("width"), F.lit(1).alias("nChannels"), F.unhex(F.concat(F.lit("0"), F.hex("id"), F.lit("05"))).alias("data")).alias("image"))
    got = {r["id"]: r["histogram"] for r in images.histograms(df, "id").collect()}
    assert len(got) == 7 and all(h[i] == h[256 + i] == (2 if i == 5 else 1) and sum(h) == 6 for i, h in got.items())
