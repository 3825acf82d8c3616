import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import negatives, vectors
from millrace.llm.queries import ORACLES, op12_hard_negatives

SF = "/root/testdata/sf0.01"
NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def as_rows(df):
    return sorted(tuple(r[n] for n in NAMES) for r in df.collect())


def brute(rows, anchors, positives=5, most=10, low=30, high=90, scale=256):
    whole = {i: ([math.floor(scale * x) for x in v], label) for i, v, label in rows}
    out = []
    for a in anchors:
        v, label = whole[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, mine) for i, (w, mine) in whole.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [(i, -t) for t, i, mine in scored if mine != label and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, rank, i, -s, t) for rank, (i, t) in enumerate(fit[:most], 1)]
    return sorted(out)


def test_whole_table_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(NAMES)} FROM ({ORACLES['op12_hard_negatives']})").fetchall()
    assert want and as_rows(op12_hard_negatives(spark, SF)) == sorted(want)


@pytest.mark.parametrize(("n", "dims", "scale"), [(300, 3, 2.0), (200, 6, 256.0), (60, 2, 3e7)])
def test_ties_zero_and_negative_scores_over_many_blocks(spark, monkeypatch, n, dims, scale):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 40 * dims * 8)
    rng = np.random.default_rng(n)
    rows = [(i - 20, (rng.integers(-3, 4, dims) / 2).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = as_rows(negatives.hard_negatives(df, df.where("vec_id % 5 = 0"), scale=scale))
    want = brute(rows, [i for i, _, _ in rows if i % 5 == 0], scale=scale)
    assert got == want and len(want) > 50


def test_one_large_group_of_equal_rows(spark):
    rows = [(i, [1.0, 0.5], i % 2) for i in range(400)] + [(1000 + i, [1.0, 0.2 + i / 500], i % 2) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert as_rows(negatives.hard_negatives(df, df.where("vec_id % 100 = 0"), high=100)) == brute(rows, [i for i, _, _ in rows if i % 100 == 0], high=100)


def test_hard_rows(spark):
    rows = [(100, [1.0, 0.5], 1), (1, None, 1), (2, [], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 2), (5, [float("inf"), 1.0], 2), (6, [1.0, 1.0], 1), (6, [1.0, 1.0], 1), (8, [0.5, 0.5], 2), (9, [0.5, 0.5], None), (None, [1.0, 1.0], 1), (10, [1.0, 1.0, 1.0], 2), (200, [0.0, 0.0], 2)]
    df = spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], "vec_id long, embedding array<double>, label int, id string, v int, score string")
    got = as_rows(negatives.hard_negatives(df, df.where("vec_id % 100 = 0")))
    # The only positive of 100 is 6 with 1.5 * 65536; 8 scores half of it. The zero vector has one positive and negatives with 0.
    assert got == [(100, 6, 1, 8, 98304, 49152), (200, 8, 1, 6, 0, 0), (200, 8, 2, 100, 0, 0)]
    assert negatives.hard_negatives(df.limit(0), df.limit(0)).count() == 0
    assert negatives.hard_negatives(df.where("vec_id = 100"), df.where("vec_id = 100")).count() == 0


def test_products_never_wrap():
    big = np.array([[2**40, 1]])
    with pytest.raises(OverflowError):
        negatives.products(big, big)
    assert negatives.products(np.array([[2**30, 3]]), np.array([[2**30, 1]]))[0, 0] == 2**60 + 3


def test_keys_sort_as_anchor_descending_score_kind_id():
    rng = np.random.default_rng(5)
    values = np.array([-(2**63), -5, -1, 0, 1, 7, 2**62])
    rows = [tuple(int(x) for x in rng.choice(values, 3)) for _ in range(300)]
    anchor, score, ids = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    packed = pa.chunked_array([negatives.pack(anchor, score, kind, ids) for kind in (0, 1)]).combine_chunks()
    back = list(zip(*(x.tolist() for x in negatives.unpack(packed)), strict=True))
    assert [b[:2] + b[3:] for b in back] == rows * 2
    assert [x[1] for x in sorted(zip(packed.to_pylist(), back, strict=True))] == sorted(back, key=lambda x: (x[0], -x[1], x[2], x[3]))


def test_windows_are_exact():
    scores = np.array([-(2**62), -101, -7, 0, 1, 3, 99, 100, 101, 12345, 2**62])
    least, most = negatives.window_of(scores, 30, 90)
    assert [(int(a), int(b)) for a, b in zip(least, most, strict=True)] == [(-(-30 * s // 100), 90 * s // 100) for s in scores.tolist()]
