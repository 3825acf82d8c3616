import duckdb
import numpy as np
import pytest

from millrace.llm import ann, vectors
from millrace.llm.queries import op13_nearest


def exact(data, queries, k):
    """query -> the k best (id, product), by comparing with every row."""
    out = {}
    for q in queries:
        scored = sorted((-float(np.dot(data[q], v)), i) for i, v in data.items() if i != q and len(v) == len(data[q]))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_whole_table(spark, sf):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '/root/testdata/{sf}/embeddings.parquet'").fetchall()
    data = {i: np.array(v, float) for i, v in rows}
    want, got = exact(data, [i for i in data if i % 20 == 0], 20), found(op13_nearest(spark, f"/root/testdata/{sf}"))
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    assert recall(got, want) >= 0.98
    assert all(abs(s - float(np.dot(data[q], data[i]))) < 1e-12 for q, hits in got.items() for i, s in hits)


def test_recall_far_from_the_origin_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 100 * 24 * 8)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(24) * 5
    data = {i: centre + rng.standard_normal(24) * rng.choice([0.1, 1, 3]) for i in range(900)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in data.items()], "vec_id long, embedding array<double>")
    want, got = exact(data, [i for i in data if i % 9 == 0], 10), found(ann.nearest(df, df.where("vec_id % 9 = 0"), 10))
    assert recall(got, want) >= 0.97


def test_bounds_hold_and_leave_most_rows_out():
    rng = np.random.default_rng(3)
    rows, queries = (x / np.linalg.norm(x, axis=1)[:, None] for x in (rng.standard_normal((4000, 64)), rng.standard_normal((50, 64))))
    centre, turned = rows[:100].mean(axis=0), ann.rotation(64)
    assert np.allclose(turned.T @ turned, np.eye(64))
    import pyarrow as pa

    code, length, fit, shift = ann.encode(rows, centre, turned)
    part = pa.table({"id": pa.array(np.arange(4000)), "v": pa.array(rows.tolist()), "code": pa.array([c.tobytes() for c in code], pa.binary()), "length": length, "fit": fit, "shift": shift})
    low, high = ann.Block(part, centre, turned).bounds(queries)
    true = queries @ rows.T
    assert ((low <= true) & (true <= high)).mean() > 0.9
    least = np.partition(low, 4000 - 20, axis=1)[:, 4000 - 20, None]
    assert (high >= least).mean() < 0.15


def test_many_copies_of_one_vector(spark):
    rng = np.random.default_rng(4)
    data = {i: np.array([0.5, 1.0, -2.0]) for i in range(500)} | {i: rng.standard_normal(3) for i in range(500, 700)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in data.items()], "vec_id long, embedding array<double>")
    want, got = exact(data, range(0, 700, 100), 20), found(ann.nearest(df, df.where("vec_id % 100 = 0")))
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in range(0, 500, 100))


def test_hard_rows(spark):
    rows = [(20, [1.0, 0.5]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]), (7, [-1.0, -1.0]), (None, [1.0, 1.0]), (8, [1.0, 1.0, 1.0]), (40, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], "vec_id long, embedding array<float>, id string, code int, score string")
    assert found(ann.nearest(df, df.where("vec_id % 20 = 0"))) == {20: [(6, 1.5), (7, -1.5)]}
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    assert ann.nearest(df.where("vec_id = 20"), df.where("vec_id = 20")).count() == 0
    huge = spark.createDataFrame([(20, [1.0, 1.0]), (1, [1e200, 1e200]), (2, [1e200, 3e200]), (3, [1e308, 1e308]), (4, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in ann.nearest(huge, huge.where("vec_id = 20")).orderBy("rank").collect()] == [3, 2, 1, 4]
