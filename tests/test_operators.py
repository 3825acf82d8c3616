"""Small hand-computed cases and brute-force comparisons."""

import io
import math
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import dist
from millrace.operators import charts, cluster, corr, filters, hypothesis, knn, metrics, models, outliers, reduce, schema, search, select, split, timefeat, transform
from millrace.operators.missing import handle_missing_values
from millrace.operators.profile import column_modes, numeric_summary
from millrace.plans.quantiles import column_quantiles
from millrace.plans.spec import FittedRecipe, Recipe, fit_transform
from millrace.sources import images, readers


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_tail_probabilities():
    assert dist.norm_sf(1.959963984540054) == pytest.approx(0.025)
    assert dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert dist.t_sf2(2.2281388519649385, 10) == pytest.approx(0.05)
    assert dist.f_sf(4.102821015130399, 2, 10) == pytest.approx(0.05)
    assert dist.f_sf(0.0, 2, 10) == 1.0


def test_nan_counts_as_missing(table):
    df = table("x double", x=[1.0, float("nan"), None, 3.0])
    s = numeric_summary(df).first()
    assert (s["count"], s["mean"], s["missing"]) == (2, 2.0, 2)


def test_mode_takes_smallest_of_ties(table):
    df = table("x double, s string", x=[10.0, 9.0, 10.0, 9.0], s=["b", "a", None, "c"])
    got = {r["column"]: r["mode"] for r in column_modes(df, ["x", "s"]).collect()}
    assert float(got["x"]) == 9.0 and got["s"] == "a"


def test_cap_keeps_missing_missing(table):
    df = table("k int, x double", k=[1, 2, 3, 4, 5], x=[1.0, 2.0, 3.0, None, 1000.0])
    out = dict(rows(fit_transform("cap_outliers", df, ["x"], method="quantile", lower=0.0, upper=0.5), "k"))
    assert out[4] is None and out[5] == 2.5


def test_constant_columns_scale(table):
    df = table("x double", x=[5.0, 5.0])
    assert rows(fit_transform("standard", df), "x") == [(0.0,), (0.0,)]
    assert rows(fit_transform("minmax", df, feature_range=(-1, 1)), "x") == [(-1.0,), (-1.0,)]


def test_robust_is_exact(table):
    got = [r[0] for r in fit_transform("robust", table("x double", x=[1.0, 2.0, 4.0])).orderBy("x").collect()]
    assert got == pytest.approx([-2 / 3, 0.0, 4 / 3])


@pytest.mark.parametrize("probs", [[0.0, 0.1, 0.5, 0.77, 1.0]])
def test_large_quantiles(table, large_plans, probs):
    x = [float(v) for v in np.random.default_rng(3).integers(0, 40, 500)]
    got = column_quantiles(table("x double", x=x), ["x"], probs)["x"]
    assert got == pytest.approx(list(np.quantile(x, probs)))


def test_unseen_category(table):
    train = table("c string, y double", c=["a", "a", "b"], y=[1.0, 3.0, 8.0])
    from millrace.plans.spec import fit

    fitted = fit("target", train, ["c"], target="y")
    out = fitted.transform(table("c string, y double", c=["z", None], y=[0.0, 0.0]))
    assert [r["c"] for r in out.collect()] == [4.0, 4.0]


def test_recipe_json_and_partitioning(table):
    df = table("k int, x double, c string", k=list(range(8)), x=[1.0, None, 3.0, 4.0, None, 6.0, 7.0, 80.0], c=list("aabbccdd"))
    fitted = Recipe().add("fill_median", ["x"]).add("standard", ["x"]).add("label", ["c"]).add("one_hot", ["c"]).undo().fit(df)
    again = FittedRecipe.from_json(fitted.to_json())
    assert rows(fitted.transform(df), "k") == rows(again.transform(df.repartition(5)), "k")


def test_interpolation_edges(table):
    df = table("t int, x double", t=list(range(6)), x=[None, 1.0, None, 3.0, None, None])
    assert [r[1] for r in rows(handle_missing_values(df, "fill_interpolation", ["x"], order_by=["t"]), "t")] == [1.0, 1.0, 2.0, 3.0, 3.0, 3.0]


def test_split_is_exact_and_disjoint(spark):
    df = spark.range(1003).withColumn("g", F.col("id") % 3)
    train, test = split.split_data(df, "id", 0.2, "g")
    assert test.count() == 3 * math.ceil(1003 / 3 * 0.2) and train.join(test, "id").count() == 0
    folds = split.assign_folds(df, "id", 4).groupBy("fold").count().collect()
    assert max(r["count"] for r in folds) - min(r["count"] for r in folds) <= 1


def test_sample_sizes(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") < 4000, "hot").otherwise(F.col("id").cast("string")))
    assert filters.sample_rows(df, 137, "id").count() == 137
    assert filters.sample_stratified(df, 100, "id", "g").count() == 100
    assert filters.sample_rows(df, 9999, "id").count() == 5000


def test_kendall_against_pairs(table, large_plans):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 12, 80).astype(float), rng.integers(0, 9, 80).astype(float)
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(80) for j in range(i))
    tx = sum(x[i] != x[j] for i in range(80) for j in range(i))
    ty = sum(y[i] != y[j] for i in range(80) for j in range(i))
    got = corr.correlations(table("x double, y double", x=list(x), y=list(y)), ["x", "y"], "kendall").first()["correlation"]
    assert got == pytest.approx(s / math.sqrt(tx * ty))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev"])
def test_nearest_against_brute_force(spark, table, large_plans, monkeypatch, metric):
    monkeypatch.setattr(knn, "CHUNK", 64)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, 2)) * 3, 2)
    x[:130] = [1.0, 1.0]  # a third of all rows are copies
    df = table("a double, b double", a=list(x[:, 0]), b=list(x[:, 1]))
    pts = knn.distinct_points(df, ["a", "b"]).cache()
    q = pts.select(F.col("pid").alias("qid"), "space", "vec", F.lit(1.0).alias("scale"), F.lit(None).cast("long").alias("self"))
    got = {}
    for r in knn.nearest(q, pts.select("pid", "space", "vec", "n"), 7, metric).collect():
        got.setdefault(r["qid"], []).extend([r["distance"]] * r["n"])
    for r in pts.collect():
        want = np.sort(knn.distances(np.array([r["vec"]]), x, metric)[0])[:7]
        assert np.sort(got[r["pid"]]) == pytest.approx(want, abs=1e-6)


def test_lof_with_copies(table):
    x = [0.0] * 30 + [0.1 * i for i in range(1, 31)] + [50.0]
    out = outliers.detect_outliers(table("x double", x=x), ["x"], "lof", n_neighbors=5)
    flagged = {r["x"] for r in out.where("outlier").collect()}
    assert out.count() == 61 and 50.0 in flagged and 1.0 not in flagged


def test_dbscan_with_copies_and_noise(table, large_plans):
    x = [0.0] * 40 + [0.4, 0.8, 1.2] + [10.0, 10.3, 10.6] + [99.0]
    got = dict(cluster.dbscan(table("x double", x=x), ["x"], eps=0.5, min_samples=3).distinct().collect())
    assert got[0.0] == got[1.2] == 0 and got[10.0] == got[10.6] == 1 and got[99.0] == -1


def test_isolation_forest_finds_far_point(table):
    rng = np.random.default_rng(0)
    x = list(rng.normal(size=300)) + [40.0]
    out = outliers.detect_outliers(table("x double", x=x), ["x"], "isolation_forest", contamination=0.02)
    top = out.orderBy(F.desc("anomaly_score")).first()
    assert top["x"] == 40.0 and top["outlier"] and 1 <= out.where("outlier").count() <= 8


def test_power_likelihood(table):
    x = list(np.exp(np.random.default_rng(2).normal(size=400)))
    lam = transform.likelihood_lambda(table("x double", x=x), ["x"], "box-cox")["x"]
    v = np.array(x)
    score = lambda l: -len(v) / 2 * np.log(np.var(np.log(v) if abs(l) < 1e-9 else (v**l - 1) / l)) + (l - 1) * np.log(v).sum()
    best = max(np.linspace(-0.5, 0.5, 20001), key=score)
    assert lam == pytest.approx(best, abs=2e-3)


def test_normal_quantile(table):
    p = [0.001, 0.02, 0.3, 0.5, 0.9, 0.9999]
    got = [r[0] for r in table("p double", p=p).select(transform.normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([dist.norm_ppf(v) for v in p], abs=1e-7)


def test_p_values(table):
    df = table("x double, g string", x=[1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 7.0, 9.0], g=list("aaaabbbb"))
    t = hypothesis.t_test(df, "x", "g", "a", "b").first()
    f = hypothesis.anova(df, "x", "g").first()
    assert t["t_statistic"] ** 2 == pytest.approx(f["f_statistic"]) and t["p_value"] == pytest.approx(f["p_value"])
    ci = hypothesis.bootstrap_ci(df.withColumn("k", F.col("x")), "x", "k", n_bootstrap=300).first()
    assert ci["lower"] < 5.0 < ci["upper"] and ci["replicates"] == 300


def test_correlation_pruning_rules():
    pairs = [("a", "b", 0.9), ("b", "c", 0.95)]
    assert select.correlation_drops(pairs) == {"c", "b"} and select.correlation_drops(pairs, {"a": 0.1, "b": 0.5, "c": 0.2}) == {"c", "a"}
    assert select.correlation_drops([("a", "b", 0.95), ("b", "c", 0.9)]) == {"b"}
    assert select.correlation_drops([("a", "b", 0.95), ("b", "c", 0.9)], strict_compat=True) == {"b", "c"} | {"b"}


def test_name_collision_raises(table):
    with pytest.raises(ValueError):
        schema.clean_column_names(table("`a!` int, `A` int", **{"a!": [1], "A": [2]}))


def test_wrong_columns_raise(table):
    df = table("x double, s string", x=[1.0], s=["a"])
    for call in (lambda: fit_transform("standard", df, ["s"]), lambda: handle_missing_values(df, "fill_constant", ["s"], value=1), lambda: handle_missing_values(df, "nope")):
        with pytest.raises(ValueError):
            call()


def test_model_type_and_features_are_checked(spark, table, tmp_path):
    df = table("x double, y double", x=[1.0, 2.0, 3.0, 4.0], y=[2.0, 4.0, 6.0, 8.0])
    m = models.train_model(df, "y", ["x"], "linear_regression")
    models.save_model(m, str(tmp_path / "m"))
    with pytest.raises(ValueError):
        models.load_model(str(tmp_path / "m"), "classifier")
    again = models.load_model(str(tmp_path / "m"), "regressor")
    assert models.score(again, df).orderBy("x").first()["Predicted_Value"] == pytest.approx(2.0)
    with pytest.raises(ValueError):
        models.score(again, df.drop("x"))


def test_string_classes(table):
    df = table("x double, y string", x=[float(i) for i in range(40)], y=["no"] * 20 + ["yes"] * 20)
    m = models.train_model(df, "y", ["x"], "decision_tree_classifier")
    assert m.labels == ["no", "yes"] and models.evaluate(m, df).first()["accuracy"] == 1.0


def test_pca_reconstructs(table):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3)) @ np.diag([3.0, 1.0, 0.2])
    df = table("a double, b double, c double", a=list(x[:, 0]), b=list(x[:, 1]), c=list(x[:, 2]))
    m = reduce.pca_fit(df)
    out = np.array([list(r) for r in reduce.pca(df, None, 3, keep_originals=False).collect()])
    assert out @ m["vectors"].T + m["mean"] == pytest.approx(np.array([list(r) for r in df.collect()]), abs=1e-9)


def test_perfect_auc(table):
    df = table("y int, s double", y=[0, 0, 1, 1], s=[0.1, 0.2, 0.8, 0.9])
    assert metrics.auc(df, "y", "s").first()["roc_auc"] == 1.0


def test_archive_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.csv", "id,name\n1,x\n2,\"y,z\"\n")
        z.writestr("two.csv", "id,name\n3,w\n")
        z.writestr("note.txt", "no record\n")
    got = readers.load_compressed(spark, str(tmp_path / "a.zip"), "*.csv")
    assert rows(got, "id") == [(1, "x"), (2, "y,z"), (3, "w")]


def test_feather_columns(spark, tmp_path):
    import pyarrow as pa

    for i in range(2):
        t = pa.table({"id": [i * 2, i * 2 + 1], "v": [0.5, 1.5], "s": ["a", None]})
        with pa.OSFile(str(tmp_path / f"{i}.feather"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
            w.write_table(t)
    got = readers.load_feather(spark, str(tmp_path), ["s", "id"])
    assert got.columns == ["s", "id"] and sorted(r["id"] for r in got.collect()) == [0, 1, 2, 3]


def test_sniffing(spark, tmp_path):
    for name, content in (("a", b"x,y\n1,2\n"), ("b", b'{"k": 1}'), ("c", b"<?xml version='1.0'?><r/>"), ("d", b"PK\x03\x04zzzz"), ("e", b"plain")):
        (tmp_path / name).write_bytes(content)
    got = {r["path"][-1]: r["format"] for r in readers.infer_file_types(spark, str(tmp_path)).collect()}
    assert got == {"a": "csv", "b": "json", "c": "xml", "d": "excel", "e": "text"}


def _png(width, height, rgb):
    raw = b"".join(b"\x00" + bytes(rgb) * width for _ in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_files(spark, tmp_path):
    (tmp_path / "p.png").write_bytes(_png(4, 6, (255, 128, 0)))
    (tmp_path / "broken.png").write_bytes(b"not an image")
    df = images.load_images(spark, str(tmp_path), "*.png")
    r = images.process(df, "origin", [{"type": "resize", "width": 2, "height": 3}, {"type": "normalize"}]).collect()
    assert len(r) == 1 and (r[0]["height"], r[0]["width"]) == (3, 2) and r[0]["values"][:3] == pytest.approx([1.0, 128 / 255, 0.0], abs=1e-6)
    h = images.histograms(df, "origin").first()["histogram"]
    assert h[255] == 24 and h[256 + 128] == 24 and h[512] == 24


def test_sample_table(spark):
    s = readers.sample_table(spark, 1000)
    assert s.count() == 1000 and 10 < s.where("numeric1 is null").count() < 100


def test_stopwords(table):
    df = table("t string", t=["The cat and the hat don't sing"])
    assert fit_transform("text_features", df, ["t"], features=["stopword_count"]).first()["t_stopword_count"] == 4


def test_trend_needs_full_windows(table):
    df = table("t int, x double", t=[1, 2, 3], x=[1.0, 2.0, 6.0])
    assert [r[2] for r in rows(timefeat.trend(df, "x", ["t"], 2), "t")] == [None, 1.5, 4.0]


def test_null_strata_are_drawn_from(spark):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") % 2 == 0, "a"))
    drawn = filters.sample_stratified(df, 100, "id", "s")
    assert rows(drawn.groupBy("s").count(), "s") == [(None, 50), ("a", 50)]
    train, test = split.split_data(df, "id", test_size=0.2, stratify="s")[:2]
    assert train.where("s is null").count() == 400 and test.where("s is null").count() == 100


def test_contamination_takes_its_share(table):
    df = table("x double", x=[float(v) for v in range(9)] + [40.0])
    out = knn.local_outlier_factor(df, ["x"], n_neighbors=3, contamination=0.1)
    assert rows(out.where("outlier").select("x"), "x") == [(40.0,)]


def test_fraction_into_an_integer_column(table):
    df = table("k int, x int", k=[1, 2, 3], x=[1, None, 3])
    assert rows(fit_transform("fill_constant", df, ["x"], value=0.5).select("k", "x"), "k") == [(1, 1.0), (2, 0.5), (3, 3.0)]


@pytest.mark.parametrize("strategy", ["uniform", "quantile", "kmeans"])
def test_constant_column_has_one_bin(table, strategy):
    df = table("x double", x=[5.0, 5.0, None])
    assert sorted(map(str, (r["x_bin"] for r in fit_transform("bins", df, ["x"], bins=5, strategy=strategy).collect()))) == ["0", "0", "None"]
    assert fit_transform("bins", df, ["x"], bins=5, strategy=strategy, one_hot=True).columns == ["x", "x_bin_0"]


def test_log_loss_leaves_out_nulls(table):
    df = table("y int, p double", y=[1, 0, None, 1], p=[0.5, 0.5, 0.9, None])
    assert metrics.log_loss(df, "y", "p").first()[0] == pytest.approx(math.log(2))


def test_draws_are_as_many_as_there_are():
    assert {p["a"] for p in search.draw_candidates({"a": [1] * 5000 + [2]}, 2)} == {1, 2}
    assert len(search.draw_candidates({"a": (1, 4), "b": ["x", "y"]}, 100)) == 8
    assert len(search.draw_candidates({"a": (0.0, 1.0)}, 50)) == 50


def test_no_caps_on_labels_density_and_bootstrap(spark):
    labels = spark.range(1100).select(F.col("id").alias("actual"), F.col("id").alias("predicted"))
    grid = metrics.confusion_matrix(labels, "actual", "predicted")
    assert grid.agg(F.count("*"), F.sum("count")).first()[:] == (1100 * 1100, 1100)

    values = np.concatenate([np.linspace(0, 1, 500), [1e6]])
    got = charts.density(spark.createDataFrame([(float(v),) for v in values], "x double"), "x", points=20).orderBy("point").toPandas()
    h = values.std(ddof=1) * len(values) ** -0.2
    x = np.linspace(0, 1e6, 20)
    want = np.exp(-0.5 * ((x[:, None] - values[None]) / h) ** 2).sum(1) / (len(values) * h * math.sqrt(2 * math.pi))
    assert got["density"].to_numpy() == pytest.approx(want, rel=1e-9)

    # Rows have weights of their own: the deviation of their number is the root of it.
    ci = hypothesis.bootstrap_ci(spark.range(20000).withColumn("v", F.lit(1.0)), "v", "id", lambda s: s["count"], n_bootstrap=200).first()
    assert 400 < ci["upper"] - ci["lower"] < 750
