"""Merged batch statistics against NumPy, over many tasks and wide tables."""

import numpy as np
import pytest

from millrace.operators import hypothesis, metrics, reduce
from millrace.plans import batches


def wide(spark, x, g, parts=7, kind="string"):
    import pandas as pd

    cols = [f"c{i}" for i in range(x.shape[1])]
    pdf = pd.DataFrame(x, columns=cols)
    pdf["g"] = g
    return spark.createDataFrame(pdf, ", ".join(f"{c} double" for c in cols) + f", g {kind}").repartition(parts), cols


def brute_scores(x, g):
    names = sorted(set(g))
    g = np.array(g)
    m = {c: x[g == c].mean(0) for c in names}
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    s = []
    for i in range(len(x)):
        own = (g == g[i]).sum()
        a = d2[i][g == g[i]].sum() / (own - 1) if own > 1 else None
        b = min(d2[i][g == c].mean() for c in names if c != g[i])
        s.append(0.0 if a is None else (b - a) / max(a, b))
    spread = {c: np.sqrt(((x[g == c] - m[c]) ** 2).sum(1)).mean() for c in names}
    db = np.mean([max((spread[c] + spread[d]) / np.linalg.norm(m[c] - m[d]) for d in names if d != c) for c in names])
    within = sum(((x[g == c] - m[c]) ** 2).sum() for c in names)
    between = sum((g == c).sum() * ((m[c] - x.mean(0)) ** 2).sum() for c in names)
    return len(names), np.mean(s), db, between / (len(names) - 1) / (within / (len(x) - len(names))), s


@pytest.mark.parametrize("held", [16 << 20, 200])
def test_class_statistics_merge_without_loss(spark, monkeypatch, held):
    monkeypatch.setattr(batches, "FAN", 2)
    monkeypatch.setattr(batches, "HELD_BYTES", held)
    rng = np.random.default_rng(1)
    g = [["a", "b", None][i % 3] for i in range(400)]
    x = rng.standard_normal((400, 5)) + 1e6 * np.array([[{"a": 1, "b": 2, None: 3}[v]] for v in g])
    df, cols = wide(spark, x, g)
    table, scatter = batches.class_statistics(df, cols, "g", full=True)
    got = {r["g"]: r for r in table.collect()}
    want = np.zeros((5, 5))
    for c in ("a", "b", None):
        part = x[[v is c or v == c for v in g]]
        rest = part - part.mean(0)
        want += rest.T @ rest
        assert got[c]["n"] == len(part) and np.allclose(got[c]["mean"], part.mean(0), rtol=1e-14) and np.isclose(got[c]["within"], (rest**2).sum(), rtol=1e-8)
    assert np.allclose(scatter, want, rtol=1e-7, atol=1e-6)


@pytest.mark.parametrize("held", [16 << 20, 300])
def test_clustering_metrics_match_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(batches, "HELD_BYTES", held)  # so small that the centres come in several blocks
    rng = np.random.default_rng(2)
    g = [f"k{i % 9}" for i in range(180)] + ["alone"]
    x = rng.standard_normal((181, 4)) + np.array([[len(v) * 3 + int(v[-1], 36)] for v in g])
    df, cols = wide(spark, x, g)
    k, s, db, ch, each = brute_scores(x, g)
    got = metrics.clustering_metrics(df, "g", cols).first()
    assert got["clusters"] == k and np.allclose([got["silhouette"], got["davies_bouldin"], got["calinski_harabasz"]], [s, db, ch])
    rows = {tuple(r[c] for c in cols): r["silhouette"] for r in metrics.silhouette_samples(df, "g", cols).collect()}
    assert np.allclose([rows[tuple(v)] for v in x.tolist()], each)


def test_undefined_and_incomplete(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (None, 2.0, 0), (3.0, float("nan"), 1), (5.0, 2.0, None), (6.0, 1.0, None)], "a double, b double, g int")
    assert metrics.clustering_metrics(df.where("g = 0"), "g", ["a", "b"]).first()[1:] == (None, None, None)
    assert metrics.clustering_metrics(df.limit(0), "g", ["a", "b"]).first()["clusters"] == 0
    noisy = df.selectExpr("a", "b", "coalesce(g, -1) AS g")
    assert metrics.clustering_metrics(noisy, "g", ["a", "b"]).first()["calinski_harabasz"] is None
    assert metrics.clustering_metrics(df, "g", ["a", "b"]).first()["clusters"] == 2
    assert sorted(r["silhouette"] for r in metrics.silhouette_samples(df, "g", ["a", "b"]).collect())[:3] == [0.0, 0.0, 0.0]


def test_five_hundred_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 500))
    x[:, 0] *= 40
    g = [i % 3 for i in range(300)]
    df, cols = wide(spark, x, g, kind="int")
    got = metrics.clustering_metrics(df, "g", cols).first()
    assert np.isclose(got["calinski_harabasz"], brute_scores(x, g)[3])
    fit = reduce.pca_fit(df, cols, 2)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(fit["variance"], values[::-1][:2]) and np.isclose(abs(fit["vectors"][:, 0] @ vectors[:, -1]), 1)
    scores = reduce.pca(df, cols, 2, keep_originals=False)
    assert scores.columns == ["g", "pca_component_1", "pca_component_2"] and np.isclose(np.std([r[1] for r in scores.collect()], ddof=1) ** 2, values[-1])


def test_discriminants_match_whitened_eigenvectors(spark):
    rng = np.random.default_rng(4)
    g = np.array([i % 4 for i in range(600)])
    x = rng.standard_normal((600, 20)) @ rng.standard_normal((20, 20)) + rng.standard_normal((4, 20))[g] * 3
    df, cols = wide(spark, x, g.tolist(), kind="int")
    got = np.array([[r["lda_component_1"], r["lda_component_2"]] for r in reduce.lda(df, "g", cols, 2).orderBy("c0").collect()])
    w = sum(np.cov(x[g == c].T, bias=True) * (g == c).sum() for c in range(4)) / 600
    m = x.mean(0)
    b = sum((g == c).sum() * np.outer(x[g == c].mean(0) - m, x[g == c].mean(0) - m) for c in range(4)) / 600
    values, vectors = np.linalg.eig(np.linalg.solve(w, b))
    best = vectors[:, np.argsort(-values.real)[:2]].real
    best /= np.sqrt(np.einsum("ij,ik,kj->j", best, w, best))
    want = (x - m)[np.argsort(x[:, 0])] @ best
    assert np.allclose(np.abs(got), np.abs(want), rtol=1e-6, atol=1e-8)


def test_vif_of_many_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 30)) + 2
    df, cols = wide(spark, x, [0] * 200, kind="int")
    gram = x.T @ x
    got = [r["vif"] for r in hypothesis.vif(df, cols).collect()]
    assert np.allclose(got, np.diag(gram) * np.diag(np.linalg.inv(gram)))


def test_projection_keeps_incomplete_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x"), (None, 1.0, "y"), (float("nan"), 1.0, None)], "a double, b double, t string")
    got = batches.projected(df, ["a", "b"], np.zeros(2), np.array([[1.0], [2.0]]), ["p"]).collect()
    assert [(r["t"], r["p"]) for r in got] == [("x", 5.0), ("y", None), (None, None)]


@pytest.mark.parametrize(("kernel", "few"), [("rbf", 64), ("poly", 5), ("linear", 3), ("cosine", 64)])
def test_kernel_components_match_the_full_kernel(spark, monkeypatch, kernel, few):
    monkeypatch.setattr(reduce, "CANDIDATES", few)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((150, 3))
    df, cols = wide(spark, np.concatenate((x, x[:10])), [0] * 160, kind="int")
    m = reduce.kernel_pca_fit(df, cols, 3, kernel=kernel, gamma=0.3, tolerance=1e-8)
    full = np.concatenate((x, x[:10]))
    k = reduce._kernel(full, full, kernel, 0.3, 3, 1.0)
    k = k - k.mean(0) - k.mean(1)[:, None] + k.mean()
    values, vectors = np.linalg.eigh(k)
    assert m["error"] <= 1e-8 and np.allclose(m["variance"] * 159, values[::-1][:3], rtol=1e-4)
    order = np.lexsort(full.T[::-1])
    want = (vectors[:, ::-1][:, :2] * np.sqrt(values[::-1][:2]))[order]
    got = np.array([[r["kpca_component_1"], r["kpca_component_2"]] for r in reduce.kernel_pca(df, cols, 2, kernel=kernel, gamma=0.3, tolerance=1e-8).orderBy(*cols).collect()])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-3)


@pytest.mark.parametrize("kernel", ["rbf", "cosine"])
def test_kernel_components_of_all_rows_are_exact(spark, monkeypatch, kernel):
    # Directions of nearly equal weight, of which landmarks hold too little; several chunks of rows.
    monkeypatch.setattr(reduce, "START_LANDMARKS", 150, raising=False)
    monkeypatch.setattr(batches, "HELD_BYTES", 40_000)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 12)) * np.linspace(2, 1, 12)
    x = np.concatenate((x, x[:20]))
    df, cols = wide(spark, x, [0] * 320, kind="int")
    m = reduce.kernel_pca_fit(df, cols, 2, kernel=kernel)
    k = reduce._kernel(x, x, kernel, 1 / 12, 3, 1.0)
    k = k - k.mean(0) - k.mean(1)[:, None] + k.mean()
    values, vectors = np.linalg.eigh(k)
    assert m["error"] == 0 and np.allclose(m["variance"] * 319, values[::-1][:2], rtol=1e-9)
    want = vectors[:, ::-1][:, :2] * np.sqrt(values[::-1][:2])
    want = (want * np.sign(want[np.argmax(np.abs(want), axis=0), range(2)]))[np.lexsort(x.T[::-1])]
    holes = df.select(*cols).union(df.limit(1).selectExpr("CAST(NULL AS DOUBLE) AS c0", *cols[1:]))
    got = reduce.kernel_pca(holes, cols, 2, kernel=kernel).orderBy(*cols).collect()
    assert got[0]["kpca_component_1"] is None and got[0]["c1"] is not None
    assert np.allclose([[r["kpca_component_1"], r["kpca_component_2"]] for r in got[1:]], want, atol=1e-5)


def test_kernel_components_with_few_landmarks_tell_their_error(spark):
    rng = np.random.default_rng(7)
    df, cols = wide(spark, rng.standard_normal((200, 4)), [0] * 200, kind="int")
    errors = [reduce.kernel_pca_fit(df, cols, 2, gamma=0.5, landmarks=n)["error"] for n in (5, 40)]
    assert 0 < errors[1] < errors[0] < 1
    holes = df.selectExpr("CASE WHEN c0 > 1 THEN NULL ELSE c0 END AS c0", "c1")
    out = reduce.kernel_pca(holes, ["c0", "c1"], 1).collect()
    assert len(out) == 200 and all((r["kpca_component_1"] is None) == (r["c0"] is None) for r in out)
