"""What the vector operators share: whole vectors with ids, and their meeting in blocks of bounded size."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of the vectors in a block, at eight a component: 8,192 rows of 64 components.
BLOCK_BYTES = 4 << 20


def is_whole(v: Column) -> Column:
    """Not null nor empty, and all components are finite numbers."""
    return (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def whole(df: DataFrame, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    """(id, v array<double>, dims[, label]) of the whole vectors that have an id (and a label), one row an id.

    A repeated id counts with its smallest vector in the order of arrays, and of those the smallest label.
    """
    held = [df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("v")]
    held += [df[label_col].cast("long").alias("label")] if label_col else []
    rows = df.select(*held).where(is_whole(F.col("v"))).dropna(subset=["id", *(["label"] if label_col else [])])
    least = F.min(F.struct("v", *(["label"] if label_col else []))).alias("x")
    return rows.groupBy("id").agg(least).select("id", "x.*").withColumn("dims", F.size("v"))


def counted(rows: DataFrame) -> int:
    """Blocks that rows with a column dims fill, at BLOCK_BYTES each."""
    n, dims = rows.agg(F.count("*"), F.max("dims")).first()
    return max(1, math.ceil(n * (dims or 1) * 8 / BLOCK_BYTES))


def in_blocks(asked: DataFrame, held: DataFrame, run, schema: str) -> DataFrame:
    """run(table, table) for every block of queries with every block of candidates of the same dims.

    Each side is copied once per block of the other, so a task holds one block of either; both have the
    columns id and dims.
    """
    mine, others = counted(asked), counted(held)

    def numbers(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def block(n):
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    left = asked.withColumn("q", block(mine)).withColumn("c", numbers(others))
    right = held.withColumn("c", block(others)).withColumn("q", numbers(mine))
    return left.groupBy("q", "c", "dims").cogroup(right.groupBy("q", "c", "dims")).applyInArrow(run, schema)


def matrix(part: pa.Table, column: str = "v") -> np.ndarray:
    return part.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def places(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The row of each wanted id among ascending ids; -1 where there is none."""
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return np.where(ids[at] == wanted, at, -1)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest finite scores of every row, by descending score, ties to the lower column."""
    n = scores.shape[1]
    k = min(k, n)
    least = np.partition(scores, n - k, axis=1)[:, n - k]
    row, column = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], column[first]
