"""Approximate nearest neighbours by inner product over randomly rotated one-bit codes.

A vector x is written as c + r * o, with c a common centre, r a length and o a direction. Padded with zeros to
BITS dimensions and turned by a random rotation, o keeps one bit a dimension, its sign. The code s (signs over
the root of BITS) and the scalar f = <s, o> give an estimate of <q - c, o> for any query q, <s, q - c> / f.
The rotation is random, so its error is at most

    length of (q - c) * sqrt((1 - f * f) / (f * f)) * SURE / sqrt(BITS - 1)

but with a probability that falls exponentially with the square of SURE. With r, <x, c> and this bound every
inner product <q, x> lies between two known numbers. A query takes all candidates of a block whose upper bound
reaches the k-th greatest lower bound, and these are reranked by the exact product of the original vectors.

Every row is indexed; the centre alone comes from a bounded sample of CENTRE_ROWS rows, and any centre gives valid bounds.
Queries meet the index in blocks of bounded size; a task passes on k rows per query and block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import table
from millrace.llm.vectors import in_blocks, matrix, places, whole

#: Least bits of a code; wider vectors get one for each of their dimensions (in whole bytes).
BITS = 512
SURE = 1.9
CENTRE_ROWS = 4096
#: Queries estimated at once, and pairs reranked at once.
ROWS, PAIRS = 128, 65536
INDEXED = "id long, v array<double>, dims int, code binary, length double, fit double, shift double"


def code_bits(dims: int) -> int:
    return max(BITS, -(-dims // 8) * 8)


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """The columns of a random rotation of code_bits(dims) dimensions that a padded vector meets; orthonormal."""
    drawn = np.random.default_rng([seed, dims]).standard_normal((code_bits(dims), dims))
    turned, upper = np.linalg.qr(drawn)
    return turned * np.sign(np.diag(upper))


def encode(vectors: np.ndarray, centre: np.ndarray, turned: np.ndarray):
    """(code bytes, length, fit, shift) of every row; shift is <x, c>. A row at the centre has length 0."""
    with np.errstate(all="ignore"):
        return _encoded(vectors, centre, turned)


def _encoded(vectors, centre, turned):
    rest = vectors - centre
    length = np.sqrt(np.einsum("ij,ij->i", rest, rest))
    direction = rest / np.where(length > 0, length, 1)[:, None] @ turned.T
    fit = np.abs(direction).sum(axis=1) / np.sqrt(len(turned))
    return np.packbits(direction >= 0, axis=1), length, np.where(length > 0, fit, 1.0), vectors @ centre


class Block:
    """A block of the index, in the order of ids, with its codes unpacked to signs."""

    def __init__(self, part: pa.Table, centre: np.ndarray, turned: np.ndarray):
        part = part.sort_by("id")
        self.ids, self.vectors, self.centre, self.turned = part.column("id").to_numpy(), matrix(part), centre, turned
        codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, -1)
        self.signs = (np.unpackbits(codes, axis=1, count=len(turned)).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(len(turned)))
        self.length, self.fit, self.shift = (part.column(n).to_numpy() for n in ("length", "fit", "shift"))
        with np.errstate(all="ignore"):
            self.error = self.length * np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit * SURE / np.sqrt(len(turned) - 1)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of the inner product of every query with every row."""
        rest = queries - self.centre
        seen = (rest @ self.turned.T).astype(np.float32) @ self.signs.T
        estimate = seen * (self.length / self.fit) + self.shift + (queries @ self.centre - self.centre @ self.centre)[:, None]
        error = np.sqrt(np.einsum("ij,ij->i", rest, rest))[:, None] * self.error
        return estimate - error, estimate + error

    def search(self, queries: np.ndarray, own: np.ndarray, k: int):
        """(query row, block row, exact product) of the k best rows found, without `own` (-1: none)."""
        with np.errstate(all="ignore"):
            low, high = self.bounds(queries)
        # Numbers too large for an estimate bound nothing.
        low[np.isnan(low)], high[np.isnan(high)] = -np.inf, np.inf
        itself = np.flatnonzero(own >= 0)
        low[itself, own[itself]] = high[itself, own[itself]] = -np.inf
        n = low.shape[1]
        k = min(k, n)
        row, column = np.nonzero((high >= np.partition(low, n - k, axis=1)[:, n - k, None]) & (high > -np.inf))
        exact = np.concatenate([np.einsum("ij,ij->i", queries[row[s : s + PAIRS]], self.vectors[column[s : s + PAIRS]]) for s in range(0, len(row), PAIRS)] or [np.empty(0)])
        exact = np.where(np.isnan(exact), -np.inf, exact)
        order = np.lexsort((column, -exact, row))
        first = order[np.arange(len(row)) - np.searchsorted(row[order], row[order]) < k]
        return row[first], column[first], exact[first]


def centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each number of dimensions the mean of up to CENTRE_ROWS sampled vectors (lowest hashes of ids); zero without any."""
    drawn = rows.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(CENTRE_ROWS).select("v").collect()
    by: dict[int, list] = {}
    for r in drawn:
        by.setdefault(len(r["v"]), []).append(r["v"])
    return {dims: np.mean(np.array(v, float), axis=0) for dims, v in by.items()}


class Coder:
    """Centre and rotation of each number of dimensions; rotations are drawn where they are needed."""

    def __init__(self, held: dict[int, np.ndarray]):
        self.held, self.drawn = held, {}

    def of(self, dims: int) -> tuple[np.ndarray, np.ndarray]:
        if dims not in self.drawn:
            self.drawn = {dims: (self.held.get(dims, np.zeros(dims)), rotation(dims))}
        return self.drawn[dims]


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Coder]:
    """(id, v, dims, code, length, fit, shift) of every whole vector that is not zero, and what made the codes."""
    rows = whole(vectors, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    rows = table(rows)
    coder = Coder(centres(rows))

    def run(batches):
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for n in np.unique(dims):
                part = pa.Table.from_batches([batch]).filter(pa.array(dims == n))
                codes, length, fit, shift = encode(matrix(part), *coder.of(int(n)))
                part = part.append_column("code", pa.array([c.tobytes() for c in codes], pa.binary()))
                for name, value in (("length", length), ("fit", fit), ("shift", shift)):
                    part = part.append_column(name, pa.array(value))
                yield from part.to_batches()

    return table(rows.mapInArrow(run, INDEXED)), coder


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, id, score): the k nearest found by inner product, ties to the smaller id; rank from 1.

    `queries` are rows of the same columns; a query never finds rows of its own id. The score is the exact
    product of the original vectors in double precision. Vectors that are null, empty or zero, or hold null or
    non-finite components, take no part; nor do rows without an id. A repeated id counts once, with its first
    vector in the order of arrays. A candidate of another length than the query is no partner. Fewer than k
    candidates are all returned; no rows give no rows; other columns are not read. A product that is no number,
    as huge terms of both signs give, counts as minus infinity.
    """
    held, coder = index(vectors, id_col, vector_col)
    asked = table(whole(queries, id_col, vector_col).where(F.exists("v", lambda x: x != 0)))
    names = ("query_id", "id", "score")

    def run(query_part, part):
        found = []
        if query_part.num_rows and part.num_rows:
            asked_ids, wanted = query_part.column("id").to_numpy(), matrix(query_part)
            block = Block(part, *coder.of(wanted.shape[1]))
            for start in range(0, len(wanted), ROWS):
                some = slice(start, start + ROWS)
                row, column, exact = block.search(wanted[some], places(block.ids, asked_ids[some]), k)
                found.append((asked_ids[some][row], block.ids[column], exact))
        if not found:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=names)
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)

    met = in_blocks(asked, held, run, "query_id long, id long, score double")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
