"""Moments under power candidates equal Spark's aggregates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import transform


@pytest.mark.parametrize("family, low", [("box-cox", 0.25), ("yeo-johnson", -8.0)])
def test_power_moments_equal_the_aggregates(spark, family, low):
    df = spark.range(3000).repartition(5).select(
        F.when(F.col("id") % 7 != 0, F.pmod(F.col("id") * 37, F.lit(101)) / 4 + F.lit(low)).alias("a"), F.lit(None).cast("double").alias("b"))
    lams = [-1.5, 0.0, 0.5, 2.0, 3.25]
    got = {(r["i"], r["j"]): (r["mean"], r["var"]) for r in transform.power_moments(df, [lams, lams], family).collect()}
    f, slope = (transform.box_cox, F.ln("a")) if family == "box-cox" else (transform.yeo_johnson, F.signum("a") * F.log1p(F.abs("a")))
    want = df.agg(F.avg(slope).alias("s"), *[F.var_pop(f(F.col("a"), lam)).alias(f"v{j}") for j, lam in enumerate(lams)]).first()
    assert set(got) == {(0, j) for j in range(-1, len(lams))}
    assert got[0, -1][0] == pytest.approx(want["s"], rel=1e-12)
    assert [got[0, j][1] for j in range(len(lams))] == pytest.approx([want[f"v{j}"] for j in range(len(lams))], rel=1e-10)


def test_logarithms_without_value_are_left_out(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (4.0,)], "a double")
    got = {r["j"]: r["var"] for r in transform.power_moments(df, [[0.0, 1.0]], "box-cox").collect()}
    assert got[0] == pytest.approx(np.var([0.0, np.log(4.0)])) and got[1] == pytest.approx(np.var([-1.0, 0.0, 3.0]))
