import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import shards
from millrace.llm.queries import op5_kd_sharding
from tests.llm.common import hard_rows, no_rows, texts

SF = "/root/testdata/sf0.01"


def test_whole_table_keeps_the_law(spark):
    held = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op5_kd_sharding(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(held) and len(got) == len(held)
    by = {}
    for r in got:
        raw = held[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        by.setdefault(r["shard"], []).append(r)
    assert sorted(by) == list(range(40))
    assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in by.values())
    sizes, largest = [sum(r["size"] for r in rows) for rows in by.values()], max(r["size"] for r in got)
    # Each of the six levels may be off by half a document.
    assert max(sizes) - min(sizes) <= 6 * largest


def test_one_group_with_most_rows(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i} of its own", "hot" if i % 3 else f"s{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    sizes = [r["b"] for r in shards.kd_shards(df, 7).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 7 and max(sizes) / min(sizes) < 1.05


def test_target_bytes_and_widest_dimension(spark):
    rows = [(i, "x" * 84, float(i % 2), 0.001 * i) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, a double, b double")
    got = shards.kd_shards(df, target_bytes=50_000, dimensions=("b", "a")).join(df, "doc_id")
    two = got.groupBy("shard").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count("*").alias("n")).orderBy("low").collect()
    assert [r["n"] for r in two] == [500, 500] and two[0]["high"] < two[1]["low"]


@pytest.mark.parametrize("n", [1, 5])
def test_hard_rows(spark, n):
    df = hard_rows(spark)
    got = shards.kd_shards(df, n, dimensions=("size", "score", "pos")).collect()
    assert len(got) == 10 and all(0 <= r["shard"] < n for r in got)
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert shards.kd_shards(no_rows(spark), n, dimensions=("size",)).count() == 0


def test_not_a_number_and_nulls_in_metadata(spark):
    df = spark.createDataFrame([(1, "a", float("nan")), (2, "b", None), (3, "c", 1.0), (4, "d", float("inf"))], "doc_id long, text string, m double")
    assert sorted(r["shard"] for r in shards.kd_shards(df, 2, dimensions=("m",)).collect()) == [0, 0, 1, 1]


def test_no_python_in_the_plan(spark):
    plan = shards.kd_shards(texts(spark, [(1, "a"), (2, "b")]), 2, dimensions=("size", "doc_id"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_plan_does_not_grow_with_the_levels(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.expr("repeat('a', cast(id % 50 as int))").alias("text"))
    plans = [shards.kd_shards(docs, shards=n)._jdf.queryExecution().optimizedPlan().toString() for n in (2, 16)]
    assert len(plans[0].splitlines()) == len(plans[1].splitlines())
