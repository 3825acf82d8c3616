"""What several operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = context._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="millrace-llm-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written once to the shared folder and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame, **options) -> DataFrame:
    """As cut(), as Parquet: smaller, and later scans read only the columns they need. `options` go to the writer."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/millrace-llm/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """At most so many rows in an Arrow batch of the jobs that run meanwhile: for rows of megabytes each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def blocks(batches, column: int, most: int = 4_000_000):
    """Slices of Arrow batches with about `most` bytes in a text column, so that memory has a bound."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * most / max(most, batch.column(column).nbytes)))
        for start in range(0, rows, step):
            yield batch.slice(start, step)


def quietly(items):
    """The items, with Python's cycle collector off meanwhile: it only slows loops that make many small objects."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield from items
    finally:
        if on:
            gc.enable()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): a row (node, root) for every linked node, root the smallest.

    Alternating large-star and small-star rounds: every round moves links to smaller neighbours by one
    aggregate and one join, so no task holds a component. Ends when a round changes nothing.
    Duplicate links and links of a node to itself are allowed.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        links = cut(small.select("x.*").where("u <> v").distinct())
        # Links of a star point straight at their smallest node; the sums show whether a round moved any.
        now = links.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2**31)))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v"), F.col("v"))).distinct()
