"""Bootstrap tables against NumPy with the same weights; densities against the formula."""

import numpy as np
import pytest

from millrace.operators import bootstrap, charts
from pyspark.sql import functions as F


def replicate_quantiles(values, w, p):
    return np.array([np.quantile(np.repeat(values, w[:, b]), p) for b in range(w.shape[1])])


@pytest.mark.parametrize(("n", "fan", "rows"), [(3, 64, 2048), (400, 2, 50), (3000, 2, 700)])
def test_sums_and_quantiles_match_repeated_values(spark, monkeypatch, n, fan, rows):
    monkeypatch.setattr(bootstrap, "FAN", fan)
    rng = np.random.default_rng(n)
    values = np.round(rng.standard_normal(n), 2)
    df = spark.createDataFrame([(i, float(v), float(i % 5)) for i, v in enumerate(values)], "k long, v double, d double").repartition(9)
    got = bootstrap.bootstrap_table(df, "v", "k", 60, 5, "d", [0.05, 0.5, 0.9])
    keys = np.array([r[0] for r in df.orderBy("k").select(F.xxhash64(F.lit(5), "k")).collect()])
    w = bootstrap.weights(keys, 60, 5).astype(int)
    assert np.array_equal(got["count"], w.sum(0)) and np.allclose(got["sum"], values @ w) and np.allclose(got["denominator"], (np.arange(n) % 5) @ w)
    full = w.sum(0) > 0
    for p in (0.05, 0.5, 0.9):
        assert np.allclose(got[p][full], replicate_quantiles(values, w[:, full], p))


def test_cells_of_several_values_are_close(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "CELLS", 40)
    rng = np.random.default_rng(7)
    values = rng.exponential(size=5000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "k long, v double")
    got = bootstrap.bootstrap_table(df, "v", "k", 40, 5, quantiles=[0.5])[0.5]
    keys = np.array([r[0] for r in df.orderBy("k").select(F.xxhash64(F.lit(5), "k")).collect()])
    want = replicate_quantiles(values, bootstrap.weights(keys, 40, 5).astype(int), 0.5)
    assert np.abs(got - want).max() < 0.25 * want.std()


def test_intervals_have_their_width(spark):
    df = spark.range(4000).withColumn("v", (F.col("id") % 1000).cast("double"))
    ci = bootstrap.bootstrap_ci(df, "v", "id").first()
    assert ci["replicates"] == 1000 and (ci["upper"] - ci["lower"]) / 2 == pytest.approx(1.96 * 288.7 / 4000**0.5, rel=0.1) and ci["center"] == pytest.approx(499.5, abs=1)
    median = bootstrap.bootstrap_ci(df, "v", "id", "median").first()
    assert (median["upper"] - median["lower"]) / 2 == pytest.approx(1.96 * 500 / 4000**0.5, rel=0.15)
    spread = bootstrap.bootstrap_ci(df, "v", "id", lambda s: s[0.75] - s[0.25], 200, quantiles=[0.25, 0.75]).first()
    assert spread["lower"] < 500 < spread["upper"]


def test_nulls_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, None), (3, float("nan"))], "k long, v double")
    got = bootstrap.bootstrap_table(df, "v", "k", 100, 1)
    assert (got["count"] % 2 == 0).all()
    assert tuple(bootstrap.bootstrap_ci(df.limit(0), "v", "k").first()) == (None, None, None, 0)
    assert bootstrap.bootstrap_ci(df.where("v is null"), "v", "k", "median").first()["replicates"] == 0
    assert bootstrap.bootstrap_ci(df, "v", "k", "median").first()["lower"] == 1.0


def test_weights_are_poisson():
    w = bootstrap.weights(np.arange(20000) * 7919, 101, 3).astype(float)
    assert w.shape == (20000, 101) and abs(w.mean() - 1) < 0.002 and abs(w.var() - 1) < 0.005 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03


def test_no_row_is_exploded(spark, capsys):
    df = spark.range(100).withColumn("v", F.col("id").cast("double"))
    charts.density(df, "v").explain()
    assert "Generate" not in capsys.readouterr().out


@pytest.mark.parametrize("held", [4096, 2])
def test_density_of_groups_matches_the_formula(spark, monkeypatch, held):
    monkeypatch.setattr(charts, "HELD_GRIDS", held)
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g, n, s in (("a", 300, 0.001), ("b", 50, 3.0), (None, 20, 1.0)) for v in rng.standard_normal(n) * s] + [("one", 0.5), ("flat", 1.0), ("flat", 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {}
    for r in charts.density(df, "v", 60, ["g"]).collect():
        got.setdefault(r["g"], {})[r["point"]] = (r["x"], r["density"])
    assert set(got) == {"a", "b", None, "one", "flat"}
    for g in got:
        v = np.array([x for k, x in rows if k == g and x is not None])
        grid = np.array([got[g][i][0] for i in range(60)])
        h = v.std(ddof=1) * len(v) ** -0.2 if len(v) > 1 else 0
        if not h:
            assert all(d is None for _, d in got[g].values())
            continue
        want = np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
        assert np.allclose([got[g][i][1] for i in range(60)], want, rtol=1e-9, atol=1e-12)
