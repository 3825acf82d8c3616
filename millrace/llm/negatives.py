"""Hard-negative mining by a secondary-sort shuffle.

Scores are integer inner products. Anchors meet all rows twice, in blocks of bounded size. The first
meeting gives every anchor its positives, the highest rows of its own label. They set the score windows
of the negatives, so in the second meeting a block passes on only the first rows of other labels in each
window: what lies behind them in a block lies behind them in the whole.

The pairs, positives and negatives alike, get packed keys whose byte order is (anchor, descending score,
positives first, id). They are dealt out by anchor and sorted within the partitions by that key
(repartition and sortWithinPartitions, the DataFrame form of repartitionAndSortWithinPartitions). A
streaming iterator reads each partition once: a positive opens its window, a negative is emitted for every
open window that holds it and is not full, and a new anchor closes all. It never holds an anchor's pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import table
from millrace.llm.vectors import best, in_blocks, matrix, places, whole

#: Anchors whose scores with a block are held at once.
ROWS = 256
PAIRS = "anchor long, key binary"
EXACT, WORD = 2**53, 2**63


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of int64 rows: in float64 where that is exact, else in int64; an error beyond."""
    most = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0)) * left.shape[1]
    if most < EXACT:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    if most < WORD:
        return left @ right.T
    raise OverflowError("an inner product of these vectors may pass 64 bits")


def pack(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.Array:
    """Keys of 25 bytes: anchor, descending score, kind (0: positive), id; byte order is their order."""
    out = np.empty(len(ids), np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")]))
    sign = np.uint64(1 << 63)
    out["anchor"], out["id"], out["kind"] = anchor.view(np.uint64) ^ sign, ids.view(np.uint64) ^ sign, kind
    out["score"] = ~(score.view(np.uint64) ^ sign)
    return pa.Array.from_buffers(pa.binary(25), len(out), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


def unpack(keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, score, kind, id) of packed keys."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")]))
    sign = np.uint64(1 << 63)

    def back(x):
        return (x.astype(np.uint64) ^ sign).view(np.int64)

    return back(raw["anchor"]), back(~raw["score"].astype(np.uint64)), raw["kind"], back(raw["id"])


def window_of(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer s with low * score <= 100 * s <= high * score; no step passes 64 bits."""
    whole_, part = score // 100, score % 100
    return low * whole_ - (-low * part) // 100, high * whole_ + (high * part) // 100


def _sorted(part: pa.Table) -> pa.Table:
    return part.sort_by("id")


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components count as floor(scale * x). An anchor's positives are its `positives` highest other rows of the
    same label; for each of them the first `negatives` rows of other labels, by descending score and then
    ascending id, with low * positive_score <= 100 * score <= high * positive_score (0 <= low, high <= 100).

    `anchors` are rows with the same columns, ids and labels as in `vectors`. Rows with a null id, label or
    vector, an empty vector, or a null or non-finite component take no part. A repeated id counts once (see
    vectors.whole). Vectors of another length than the anchor's are no partners. No rows, or no partners,
    give no rows; other columns are not read. An inner product that may pass 64 bits is an error.
    """

    def integers(df):
        rows = whole(df, id_col, vector_col, label_col)
        return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))

    held, asked = table(integers(vectors)), table(integers(anchors))

    def scored(anchor_part, part):
        """Scores of up to ROWS anchors at a time with the block, in the order of ids."""
        part = _sorted(part)
        ids, labels, right = part.column("id").to_numpy(), part.column("label").to_numpy(), matrix(part)
        for start in range(0, anchor_part.num_rows, ROWS):
            some = anchor_part.slice(start, ROWS)
            scores = products(matrix(some), right)
            yield some, ids, labels, scores

    def first_positives(anchor_part, part):
        out = []
        if anchor_part.num_rows and part.num_rows:
            for some, ids, labels, scores in scored(anchor_part, part):
                mine = some.column("id").to_numpy()
                own = places(ids, mine)
                fit = some.column("label").to_numpy()[:, None] == labels[None, :]
                fit[np.flatnonzero(own >= 0), own[own >= 0]] = False
                row, column = best_integers(scores, fit, positives)
                out.append(pa.table({"anchor": mine[row], "id": ids[column], "score": scores[row, column]}))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], pa.int64()) for n in ("anchor", "id", "score")})

    met = in_blocks(asked, held, first_positives, "anchor long, id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc("id"))
    chosen = table(met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives).drop("n"))

    # Every anchor has at most `positives` of them.
    scores_of = chosen.groupBy("anchor").agg(F.sort_array(F.collect_set("score"), asc=False).alias("scores"))
    windows = asked.join(scores_of, asked["id"] == scores_of["anchor"]).select("id", "label", "v", "dims", "scores")

    def first_negatives(anchor_part, part):
        out = []
        if anchor_part.num_rows and part.num_rows:
            for some, ids, labels, scores in scored(anchor_part, part):
                mine, opened = some.column("id").to_numpy(), some.column("scores").to_pylist()
                other = some.column("label").to_numpy()[:, None] != labels[None, :]
                pairs = []
                for at in range(max(map(len, opened))):
                    with_one = np.array([k for k, x in enumerate(opened) if len(x) > at])
                    least, most = window_of(np.array([opened[k][at] for k in with_one], np.int64), low, high)
                    inside = other[with_one] & (scores[with_one] >= least[:, None]) & (scores[with_one] <= most[:, None])
                    row, column = best_integers(scores[with_one], inside, negatives)
                    pairs.append(with_one[row] * len(ids) + column)
                row, column = np.divmod(np.unique(np.concatenate(pairs)), len(ids))
                anchor = mine[row]
                out.append(pa.table({"anchor": anchor, "key": pack(anchor, scores[row, column], 1, ids[column])}))
        return pa.concat_tables(out) if out else pa.table({"anchor": pa.array([], pa.int64()), "key": pa.array([], pa.binary())})

    def keys(batches):
        for b in batches:
            anchor, ids, score = (b.column(n).to_numpy() for n in ("anchor", "id", "score"))
            yield pa.record_batch({"anchor": pa.array(anchor), "key": pack(anchor, score, 0, ids)})

    pairs = chosen.mapInArrow(keys, PAIRS).union(in_blocks(windows, held, first_negatives, PAIRS))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = pairs.repartition(parts, "anchor").sortWithinPartitions("key")
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

    def stream(batches):
        """One pass over the sorted pairs; between batches only the open windows of one anchor are held."""
        now, opened = None, []  # open windows: [positive, its score, least, most, emitted]
        for b in batches:
            anchor, score, kind, ids = unpack(b.column("key"))
            found = []
            ends = np.flatnonzero(np.diff(anchor)) + 1
            for start, end in zip(np.r_[0, ends], np.r_[ends, len(anchor)], strict=True):
                if start == end:
                    continue
                if anchor[start] != now:
                    now, opened = anchor[start], []
                is_positive = kind[start:end] == 0
                for at in np.flatnonzero(is_positive) + start:
                    least, most = window_of(score[at : at + 1], low, high)
                    opened.append([ids[at], score[at], least[0], most[0], 0])
                # A window lies at or below its positive, and a positive comes first among equal scores.
                mine, names_ = score[start:end][~is_positive], ids[start:end][~is_positive]
                for w in opened:
                    if w[4] < negatives:
                        hits = np.flatnonzero((mine <= w[3]) & (mine >= w[2]))[: negatives - w[4]]
                        n = len(hits)
                        found.append((np.full(n, now), np.full(n, w[0]), w[4] + 1 + np.arange(n), names_[hits], np.full(n, w[1]), mine[hits]))
                        w[4] += n
            if found:
                columns = [np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True)]
                columns[2] = columns[2].astype(np.int32)
                yield pa.record_batch([pa.array(c) for c in columns], names=names)

    return ordered.select("key").mapInArrow(stream, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def best_integers(scores: np.ndarray, fit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest integer scores of every row among those that fit, ties to the lower column."""
    if np.abs(scores).max(initial=0) < EXACT:
        return best(np.where(fit, scores, -np.inf), k)
    # float64 would merge neighbours here: order the fitting ones themselves.
    row, column = np.nonzero(fit)
    order = np.lexsort((column, ~scores[row, column], row))
    row, column = row[order], column[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], column[first]
