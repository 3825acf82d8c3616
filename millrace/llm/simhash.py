"""SimHash near-duplicates with pivot distance tables.

Every fingerprint gets a table of its Hamming distances to 64 reference fingerprints, the rows of a
Hadamard matrix. By the triangle inequality two fingerprints within k bits have tables that differ by
at most k in every coordinate, so a pair whose largest coordinate difference exceeds k is discarded.
These references are provably sharp: the mean squared coordinate difference of a pair at h bits is h,
hence every pair with more than k * k bits is discarded. Survivors are verified bit by bit.

Pairs are only formed within cells: of BLOCKS blocks of the fingerprint, a pair within two bits has
all but two equal, so it meets in a cell of one of the choices of two blocks to leave out. A cell with
more than CELL_ROWS fingerprints is cut finer in the same way within the bits it leaves open, until a
cell has at most 2**CELL_BITS possible fingerprints; nothing is capped and no pair is lost.

Only distinct fingerprints are paired: copies are merged by the aggregate before.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blocks, components, cut, quietly, table

BITS = 2
BLOCKS = 6
CELL_ROWS = 64
CELL_BITS = 8
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the word shingles of a text; A-Z are lower-cased, words end at ASCII white space."""
    parts = (text or "").encode("utf-8").translate(_LOWER).split()
    if not parts:
        return 0
    joined = memoryview(b" ".join(parts))
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(parts) > words:
        starts, ends = starts[: 1 - words], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Rows (id, bits long) with the 64-bit fingerprint of every whole text."""

    def run(batches):
        for part in quietly(blocks(batches, 1)):
            found = np.array([fingerprint(t, words) for t in part.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["id", "bits"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, bits long")


def _signed(word: int) -> int:
    return word - (1 << 64) if word >= 1 << 63 else word


def references() -> list[int]:
    """The rows of the 64 x 64 Hadamard matrix as signed 64-bit words: bit j of row i is the parity of i & j."""
    return [_signed(sum((bin(i & j).count("1") & 1) << j for j in range(64))) for i in range(64)]


def distance_table(bits: Column) -> Column:
    """Distances of a fingerprint to all references."""
    return F.array(*[F.bit_count(bits.bitwiseXOR(F.lit(r))).cast("tinyint") for r in references()])


def _masks(places: list[int], blocks_: int) -> list[int]:
    """For each choice of two of the blocks that the places are dealt into: the places of all the others."""
    parts = [places[len(places) * i // blocks_ : len(places) * (i + 1) // blocks_] for i in range(blocks_)]
    return [sum(1 << p for k, part in enumerate(parts) if k not in out for p in part) for out in combinations(range(blocks_), 2)]


def links(prints: DataFrame) -> DataFrame:
    """All pairs (a, b) of distinct fingerprints within two bits; prints has one column, bits.

    The first cells leave out two of BLOCKS blocks; a finer level leaves out two of more blocks, until
    the bits left open are CELL_BITS at most. A finer level takes only the fingerprints of cells with
    more than CELL_ROWS rows, and sees only pairs that this cell has.
    """
    levels = [BLOCKS]
    while 2 * -(-64 // levels[-1]) > CELL_BITS:
        levels.append(min(2 * levels[-1], 64 * 2 // CELL_BITS))
    rest, found = prints, []
    for level in levels:
        masks = _masks(list(range(64)), level)
        keyed = rest.select("bits", F.posexplode(F.array(*[F.col("bits").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("choice", "cell"))
        sizes = keyed.groupBy("choice", "cell").count()
        last = level == levels[-1]
        dense = sizes.where("count > 1") if last else sizes.where(f"count between 2 and {CELL_ROWS}")
        kept = keyed.join(dense.drop("count"), ["choice", "cell"])
        pairs = kept.alias("x").join(kept.alias("y"), ["choice", "cell"]).where("x.bits < y.bits")
        found.append(pairs.select(F.col("x.bits").alias("a"), F.col("y.bits").alias("b")))
        if last:
            break
        rest = cut(keyed.join(sizes.where(f"count > {CELL_ROWS}").drop("count"), ["choice", "cell"]).select("bits").distinct())
        if rest.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    pairs = pairs.distinct()
    gap = F.array_max(F.zip_with(distance_table(F.col("a")), distance_table(F.col("b")), lambda p, q: F.abs(p - q)))
    return pairs.where(gap <= BITS).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Rows (id, fingerprint, component_id): the smallest id reachable over links of two bits or fewer.

    A null text counts as empty; texts without words have fingerprint zero, which links like any other.
    Fewer words than a shingle make one shingle of all. Ids should be unique: repeated rows come out
    repeatedly, and count once in a component. Null ids take part but never name a component unless it
    has no other. Other columns of the input are not read.
    """
    prints = table(fingerprints(df, id_col, text_col, words))
    first = prints.groupBy("bits").agg(F.min("id").alias("first"))
    roots = components(links(first.select("bits")))
    named = roots.join(first, roots["node"] == first["bits"]).select("root", "bits", "first")
    names = named.groupBy("root").agg(F.min("first").alias("low"))
    linked = named.join(names, "root").select("bits", "low")
    classes = table(first.join(linked, "bits", "left").select("bits", F.coalesce("low", "first").alias("component_id")))
    # A fingerprint may stand for a third of all rows; the side of the rows is streamed, and split where it is skewed.
    out = prints.join(classes, "bits")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, one document (the smallest id) of each component; a row whose id is null stays."""
    found = near_duplicates(df, id_col, text_col)
    gone = found.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("gone")).distinct()
    return df.join(gone, df[id_col] == gone["gone"], "left_anti")


