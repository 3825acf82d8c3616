"""Distinct counts: exact where they are the result, settled where a rule could turn, never through Expand."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import profile, schema
from millrace.plans import distinct


@pytest.fixture
def mixed(spark):
    return spark.range(3000).select(
        F.col("id"), (F.col("id") % 7).cast("string").alias("few"), (F.col("id") % 700).cast("double").alias("some"), F.when(F.col("id") % 3 > 0, F.col("id") % 1000).alias("holes"),
        F.lit(None).cast("string").alias("nothing"), F.when(F.col("id") % 2 == 0, F.lit(0.0)).otherwise(F.lit(-0.0)).alias("zeros"),
        F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.lit(1.0)).alias("nans"), F.timestamp_seconds(F.col("id") % 20).alias("ts"), F.array("id").alias("list"))


def test_counts_equal_count_distinct(spark, mixed):
    want = mixed.agg(*[F.count_distinct(c).alias(c) for c in mixed.columns]).first().asDict()
    assert distinct.distinct_counts(mixed, mixed.columns) == want
    assert {r["column"]: r["unique"] for r in profile.column_info(mixed).collect()} == want
    assert distinct.distinct_counts(mixed.limit(0), mixed.columns) == dict.fromkeys(mixed.columns, 0)


@pytest.mark.parametrize("values", [18, 19, 20, 21, 99, 100, 101])
def test_roles_turn_at_exactly_their_limits(spark, values):
    df = spark.range(4000).select((F.col("id") % values).alias("n"), F.concat(F.lit("v"), F.col("id") % values).alias("t"))
    roles = {r["column"]: r["role"] for r in schema.detect_roles(df).collect()}
    assert roles == {"n": "categorical" if values < 20 else "numeric", "t": "categorical"}
    assert schema.suggest_types(df).first()["suggestion"] == ("category" if values <= 100 else "object")


def test_no_copy_of_the_table_per_column(spark, mixed, capsys, monkeypatch):
    plans = []
    kept = type(mixed).agg
    monkeypatch.setattr(type(mixed), "agg", lambda self, *a: plans.append(kept(self, *a)) or plans[-1])
    schema.detect_roles(mixed.drop("list"))
    profile.column_info(mixed.drop("list"))
    assert len(plans) >= 3
    assert not any("Expand" in p._jdf.queryExecution().executedPlan().toString() for p in plans)
