"""Registry, table loading and shared fixtures of the checks."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES = {}
ORACLES = {}


def check(name, sql=None):
    """Register a (spark, sf_dir) -> DataFrame callable under ``name``, with its SQL when it has one."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


def load(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df, decimals=4):
    """Round every floating column, so that sums in another order compare equal."""
    real = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`").cast("double"), decimals) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, real) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


# The given tables hold no NULL; these fixtures set some by the same rule on both sides.
NULL_RULES = {
    "l_quantity": "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END",
    "l_discount": "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_discount END",
    "l_returnflag": "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_returnflag END",
}
OUTLIER_RULE = "CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 20 ELSE l_extendedprice END"


def lineitem_null(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").withColumns({c: F.expr(e) for c, e in NULL_RULES.items()})


LN = "ln AS (SELECT * REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in NULL_RULES.items()) + ") FROM lineitem)"


def lineitem_outlier(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").withColumn("l_extendedprice", F.expr(OUTLIER_RULE))


LO = f"lo AS (SELECT * REPLACE ({OUTLIER_RULE} AS l_extendedprice) FROM lineitem)"


def events_null(spark, sf_dir):
    return load(spark, sf_dir, "events").withColumn("value", F.expr("CASE WHEN event_id % 4 IN (1, 2) THEN NULL ELSE value END"))


EN = "en AS (SELECT * REPLACE (CASE WHEN event_id % 4 IN (1, 2) THEN NULL ELSE value END AS value) FROM events)"


def scored(spark, sf_dir):
    """Orders with a binary target and a deterministic score."""
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr("CAST(o_totalprice > 150000 AS INT)").alias("y"),
        F.expr("(o_orderkey * 7919 % 1000) / 1000.0D").alias("score"), "o_orderstatus", "o_orderpriority",
    )


SC = (
    "sc AS (SELECT o_orderkey, CAST(o_totalprice > 150000 AS INT) AS y, "
    "CAST(o_orderkey * 7919 % 1000 AS DOUBLE) / 1000.0 AS score, o_orderstatus, o_orderpriority FROM orders)"
)


def regressed(spark, sf_dir):
    """Orders with a deterministic prediction of their price."""
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("y"),
        F.expr("o_totalprice * (0.9D + 0.2D * ((o_orderkey % 100) / 100.0D))").alias("p"), "o_orderdate",
    )


RG = (
    "rg AS (SELECT o_orderkey, o_totalprice AS y, o_totalprice * (CAST(0.9 AS DOUBLE) + CAST(0.2 AS DOUBLE) * "
    "(CAST(o_orderkey % 100 AS DOUBLE) / 100.0)) AS p, o_orderdate FROM orders)"
)


def union_all(parts):
    return "\nUNION ALL\n".join(parts)
