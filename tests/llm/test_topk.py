import math

import duckdb
import numpy as np
import pytest

from millrace.llm import topk
from millrace.llm.queries import ORACLES, op10_top_k

SF = "/root/testdata/sf0.01"


def brute(vectors, queries, k):
    rows = set()
    for q in queries:
        scores = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        rows |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)}
    return rows


def as_rows(df):
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()}


def test_whole_table_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert as_rows(op10_top_k(spark, SF)) == set(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({ORACLES['op10_top_k']})").fetchall())


@pytest.mark.parametrize(("rows", "dims", "k"), [(300, 8, 5), (300, 2, 20), (40, 3, 60)])
def test_many_ties_and_small_blocks(spark, monkeypatch, rows, dims, k):
    monkeypatch.setattr(topk, "QUERY_ROWS", 16)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 50)
    rng = np.random.default_rng(rows + dims)
    data = {i: (rng.integers(-3, 4, dims) / 2).tolist() for i in range(rows)}
    df = spark.createDataFrame(list(data.items()), "vec_id long, embedding array<double>")
    whole = {i: [math.floor(64 * x) for x in v] for i, v in data.items()}
    got = as_rows(topk.top_k(df, df.where("vec_id % 3 = 0"), k))
    assert got == brute(whole, [i for i in data if i % 3 == 0], k)


def test_bounds_stop_early_and_stay_exact():
    rng = np.random.default_rng(1)
    vectors = np.concatenate((rng.integers(-40, 40, (500, 16)), rng.integers(-900, 900, (3, 16))))
    index = topk.Index(vectors)
    queries = rng.integers(-40, 40, (20, 16))
    for q, hits in enumerate([index.search(queries[q : q + 1], np.array([-1]), 3) for q in range(20)]):
        found = {c: s for _, cs, ss in hits for c, s in zip(cs.tolist(), ss.tolist(), strict=True)}
        exact = vectors @ queries[q]
        best = np.lexsort((np.arange(503), -exact))[:3]
        assert set(best.tolist()) <= set(found) and all(exact[c] == s for c, s in found.items())


def test_hard_rows(spark):
    rows = [(20, [1.0, 0.5]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]), (7, [-1.0, -1.0]), (None, [1.0, 1.0]), (8, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], "vec_id long, embedding array<float>, id string, score string, rank int")
    got = as_rows(topk.top_k(df, df.where("vec_id % 20 = 0")))
    assert got == {(20, 1, 6, 64 * 64 + 32 * 64), (20, 2, 7, -64 * 64 - 32 * 64)}
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id = 20"), df.where("vec_id = 20")).count() == 0


def test_a_query_in_a_block_leaves_the_others_all_candidates():
    vectors = np.arange(12, dtype=np.int64).reshape(6, 2)
    queries = np.array([[1, 1], [2, -1]], dtype=np.int64)
    # The first query is candidate 3, the second one is from elsewhere; all six and k = 6.
    hits = topk.Index(vectors).search(queries, np.array([3, -1]), 6)
    got = {(q, c) for rows, what, _ in hits for q, c in zip(rows.tolist(), what.tolist(), strict=True)}
    assert got == {(0, c) for c in range(6) if c != 3} | {(1, c) for c in range(6)}
    assert topk.Index(vectors[:1]).search(queries[:1], np.array([0]), 6) == []
