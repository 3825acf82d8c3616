import pytest

from millrace.llm import quality
from millrace.llm.queries import op4_quality_classifier
from tests.llm.common import hard_rows, no_rows

SF = "/root/testdata/sf0.1"


def test_estimation_finds_the_good_labellers():
    import random

    rng, counts = random.Random(2), {}
    right = [0.95, 0.9, 0.9, 0.6, 0.55, 0.85, 0.7, 0.9, 0.5]
    for _ in range(6000):
        good = rng.random() < 0.8
        pattern = 0
        for p in right:
            vote = 0 if rng.random() < 0.3 else 1 if (rng.random() < p) == good else 2
            pattern = pattern * 3 + vote
        counts[pattern] = counts.get(pattern, 0) + 1
    _, rate = quality.estimate(counts)
    assert rate[1] == pytest.approx(right, abs=0.06) and 1 - rate[0] == pytest.approx(right, abs=0.1)


def test_held_out_labels(spark):
    got = {r["doc_id"]: r for r in op4_quality_classifier(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    good, bad = ([got[i]["keep"] for i, y in labels.items() if y == k] for k in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_hard_rows(spark):
    df = hard_rows(spark)
    model = quality.fit(df)
    got = quality.score(df, model).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 and r["keep"] == bool(r["predicted"]) for r in got)
    assert all(r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    empty = quality.fit(no_rows(spark))
    assert quality.score(no_rows(spark), empty).count() == 0 and quality.score(df, empty).count() == 10
