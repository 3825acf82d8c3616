"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Every component of a candidate, counted from the smallest of its block, is an impact, written in digits
of DIGIT bits. The index of a block keeps one posting segment per digit, the segment of the highest digit
first: its postings carry the largest impacts. A block of queries takes the segments in that order. After
each one, what the digits to come can add to a score is bounded from both sides; a query is done as soon
as the candidates that may still belong to its top k are few enough to be rescored, which the bounds
prove. These, and only these, are rescored with the exact components.

Queries and candidates meet in blocks of bounded size; a task passes on k rows per query and block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_ROWS, CANDIDATE_ROWS = 2048, 8192
DIGIT = 2


class Index:
    """Posting segments of the digits of a block of integer vectors, by descending impact."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.low = vectors.min(axis=0)
        impact = vectors - self.low
        digits = max(1, -(-int(impact.max()).bit_length() // DIGIT))
        self.segments = []
        for k in range(digits - 1, -1, -1):
            digit = (impact >> (k * DIGIT)) & ((1 << DIGIT) - 1)
            self.segments.append((1 << (k * DIGIT), digit.astype(np.float64)))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int):
        """(query row, candidate row, score) with every candidate that may belong to a query's top k, except
        `own`, the candidate row that is the query itself (-1: none); at least the top k are among them."""
        n = len(self.vectors)
        weights = queries.astype(np.float64)
        # Scores on which the bounds stand: what the digits seen so far give.
        seen = np.repeat((weights @ self.low.astype(np.float64))[:, None], n, axis=1)
        up, down = np.maximum(weights, 0).sum(axis=1), np.minimum(weights, 0).sum(axis=1)
        itself = np.flatnonzero(own >= 0)
        rows, found = np.arange(len(queries)), []
        # A query that is itself a candidate has one candidate less than the others.
        tops = np.minimum(k, n - (own >= 0))
        for number, (impact, digit) in enumerate(self.segments):
            seen += (weights[rows] * impact) @ digit.T
            masked = itself[np.isin(itself, rows)]
            seen[np.searchsorted(rows, masked), own[masked]] = -np.inf
            rest = float(impact - 1)
            low = seen + rest * down[rows, None]
            least = np.empty(len(rows))
            for top in np.unique(tops[rows]):
                same = tops[rows] == top
                least[same] = np.partition(low[same], n - top, axis=1)[:, n - top] if top > 0 else np.inf
            possible = seen + rest * up[rows, None] >= least[:, None]
            last = number + 1 == len(self.segments)
            done = np.ones(len(rows), bool) if last else possible.sum(axis=1) <= 4 * k
            who, what = np.nonzero(possible & done[:, None] & np.isfinite(seen))
            if len(who):
                exact = np.einsum("ij,ij->i", queries[rows[who]], self.vectors[what])
                found.append((rows[who], what, exact))
            rows, seen = rows[~done], seen[~done]
            if not len(rows):
                break
        return found


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: by descending score, then ascending id."""
    order = np.lexsort((ids, -score, query))
    sorted_query = query[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_query, sorted_query)
    return order[rank < k]


def _numbers(n: int):
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, id, score): the k highest integer inner products of floor(scale * x), ties to the
    smaller id; rank counts from 1.

    `queries` are rows of the same columns; a query never finds rows of its own id. Vectors that are null or
    empty, or hold null or non-finite components, take no part; nor do rows without an id. A repeated id
    counts once, with its first vector in the order of arrays. A candidate of another length than the query
    is no partner. Fewer than k candidates are all returned; other columns are not read.
    """

    def whole(df):
        v = F.col("v")
        fit = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        rows = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("v")).where(fit & F.col("id").isNotNull())
        rows = rows.groupBy("id").agg(F.min("v").alias("v"))
        return rows.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v")).withColumn("dims", F.size("v"))

    left, right = whole(queries), whole(vectors)
    sizes = [r for r in (left.agg(F.count("*")).first()[0], right.agg(F.count("*")).first()[0])]
    query_blocks, blocks = max(1, math.ceil(sizes[0] / QUERY_ROWS)), max(1, math.ceil(sizes[1] / CANDIDATE_ROWS))

    def block(n):
        return F.pmod(F.xxhash64("id"), F.lit(n))

    # Each side is copied once per block of the other; a task holds one block of either.
    asked = left.select("id", "v", "dims", block(query_blocks).alias("q"), F.explode(_numbers(blocks)).alias("c"))
    held = right.select("id", "v", "dims", block(blocks).alias("c"), F.explode(_numbers(query_blocks)).alias("q"))

    def run(query_part, part):
        empty = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not query_part.num_rows or not part.num_rows:
            return empty
        asked_ids, ids = (t.column("id").to_numpy() for t in (query_part, part))
        queries_, vectors_ = (t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (query_part, part))
        order = np.argsort(ids)
        at = np.minimum(np.searchsorted(ids[order], asked_ids), len(ids) - 1)
        own = np.where(ids[order][at] == asked_ids, order[at], -1)
        index, found = Index(vectors_), []
        for start in range(0, len(queries_), 256):
            hits = index.search(queries_[start : start + 256], own[start : start + 256], k)
            found += [(asked_ids[start + q], ids[c], s) for q, c, s in hits]
        if not found:
            return empty
        query, candidate, score = (np.concatenate(x) for x in zip(*found, strict=True))
        best = _best(query, candidate, score, k)
        return pa.table({"query_id": query[best], "id": candidate[best], "score": score[best]})

    met = asked.groupBy("q", "c", "dims").cogroup(held.groupBy("q", "c", "dims")).applyInArrow(run, "query_id long, id long, score long")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
