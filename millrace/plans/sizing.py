"""Size checks and durable intermediate tables.

Operators that have both a compact plan (one exact aggregate, one window) and a fully
distributed plan choose by the optimizer's own size estimate of the input, which costs no job.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SMALL_INPUT_BYTES = "millrace.smallInputBytes"
# The estimate counts compressed files, and of few columns only their share: some rows take 2 bytes of it and 400 in a sort.
DEFAULT_SMALL_INPUT_BYTES = 4 * 1024 * 1024
SLICE_BYTES = 2 * 1024 * 1024
MAX_SLICES = 20_000
# Sources that cannot tell their size are estimated in exabytes.
UNKNOWN_BYTES = 1 << 50
LOCAL_TABLE_ROWS = 10_000


def estimated_bytes(df: DataFrame) -> int:
    """Size estimate of the optimized plan in bytes (from file sizes; no job runs)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame, default: int = DEFAULT_SMALL_INPUT_BYTES) -> bool:
    limit = int(df.sparkSession.conf.get(SMALL_INPUT_BYTES, str(default)))
    return estimated_bytes(df) <= limit


def slices(df: DataFrame) -> int:
    """Number of range slices used when a global order is needed; grows with the input, so that a slice does not."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    # A join is estimated as the product of its sides.
    size = min(estimated_bytes(df), sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())))
    return max(partitions, min(size // SLICE_BYTES, MAX_SLICES)) if size < UNKNOWN_BYTES else partitions


_local_scratch = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's spark.checkpoint.dir when it is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="millrace-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


def freeze(df: DataFrame, tag: str = "table", path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so a lost executor re-reads the table instead of re-running the plan, and
    gives Spark exact statistics for the joins that follow.
    """
    path = path or scratch_path(df.sparkSession, tag)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame, tag: str = "lookup") -> DataFrame:
    """Materialise a fitted lookup table.

    Up to LOCAL_TABLE_ROWS rows it becomes a local table that Spark can broadcast; a larger one is
    frozen, and Spark decides between broadcast and shuffle from the size of its files.
    """
    rows = df.limit(LOCAL_TABLE_ROWS + 1).toArrow()
    if rows.num_rows <= LOCAL_TABLE_ROWS:
        return df.sparkSession.createDataFrame(rows, df.schema)
    return freeze(df, tag)


def is_local(df: DataFrame) -> bool:
    return "LocalRelation" in df._jdf.queryExecution().optimizedPlan().getClass().getName()
