"""Sharding by a k-d tree over document metadata, with DataFrame operations only.

A node of the tree that stands for n shards is cut along its widest dimension so that floor(n / 2) / n of
its bytes go left; a leaf is one shard. All nodes of a level are cut together. The weighted quantile is
found by histograms: rows are counted by cuts of an interval in BINS parts, the part that holds the
quantile is cut again, until it holds one row or one value. Only histograms and cuts, at most BINS rows a node, leave
the aggregates; text never enters a shuffle.

Equal coordinates are told apart by a hash of the document id, so a group of copies, or a source with a
third of all rows, is cut like anything else.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import table

#: Bits of a coordinate, of the hash that breaks ties, and of the interval parts of one histogram.
GRID, TIE, BIN = 16, 30, 12
OVERHEAD = 16
SLOT_BLOCKS = 64


def text_code(value: Column) -> Column:
    """The first six bytes of a string as a number in the order of strings."""
    head = F.rpad(F.hex(F.substring(F.encode(F.coalesce(value, F.lit("")), "utf-8"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def metadata(docs: DataFrame, dimensions: tuple[str, ...], id_col: str, text_col: str) -> DataFrame:
    """Rows (id, size, text_crc32, d0, d1, ...): one scan, without the text."""
    kinds = dict(docs.dtypes)
    raw = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + OVERHEAD
    codes = [raw.cast("double") if name == "size" else text_code(docs[name]) if kinds[name] == "string" else F.coalesce(docs[name].cast("double"), F.lit(0.0)) for name in dimensions]
    crc = F.crc32(F.encode(F.coalesce(docs[text_col], F.lit("")), "utf-8"))
    return docs.select(docs[id_col].alias("id"), raw.alias("size"), crc.alias("text_crc32"), *[c.alias(f"d{k}") for k, c in enumerate(codes)])


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = ("size", "source", "lang", "doc_id"),
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot): shards of near equal bytes, 0 to shards - 1.

    `shards` is given, or follows from `target_bytes`. The size is the UTF-8 bytes of the text plus
    OVERHEAD; a null text counts as empty. `dimensions` are columns of docs, or "size". Null metadata
    count as zero or the empty string; not-a-number counts as zero. slot counts the rows of a shard from 0
    without gaps. Rows with equal id and equal coordinates stay together, so near equal sizes need ids
    that are unique. An empty table gives no rows; with fewer documents than shards some shards are empty.
    """
    base = table(metadata(docs, dimensions, id_col, text_col))
    n_dims = len(dimensions)
    ranges = [f(F.nanvl(f"d{k}", F.lit(0.0))).alias(f"{name}{k}") for k in range(n_dims) for name, f in (("low", F.min), ("high", F.max))]
    total = base.agg(F.sum("size").alias("bytes"), *ranges).first()
    shards = shards or max(1, math.ceil((total["bytes"] or 0) / (target_bytes or 1 << 30)))
    grid = (1 << GRID) - 1

    def coordinate(k):
        low, high = total[f"low{k}"] or 0.0, total[f"high{k}"] or 0.0
        return F.floor((F.nanvl(f"d{k}", F.lit(0.0)) - low) / (high - low) * grid) if high > low else F.lit(0).cast("long")

    # One coordinate on the grid, then the hash: the whole key of a row along a dimension.
    tie = F.pmod(F.xxhash64("id"), F.lit(1 << TIE))
    rows = base.select("id", "size", "text_crc32", *[(coordinate(k) * (1 << TIE) + tie).alias(f"k{k}") for k in range(n_dims)], F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("leaves"))
    keys = F.array(*[f"k{k}" for k in range(n_dims)])
    rows = table(rows)
    while True:
        cuts = _cuts(rows.where("leaves > 1"), keys, n_dims)
        if cuts is None:
            break
        at = rows.withColumn("cut", _at_node({f: {"dim": dim, "cut": cut} for f, dim, cut in cuts}))
        half, right = F.floor(F.col("leaves") / 2), F.get(keys, F.col("cut.dim").cast("int")) > F.col("cut.cut")
        # Written once a level, else the plans of the lower levels repeat the joins of all levels above.
        rows = table(at.select("id", "size", "text_crc32", *[f"k{k}" for k in range(n_dims)],
                               F.when(right, F.col("first") + half).otherwise(F.col("first")).alias("first"),
                               F.when(F.col("cut").isNull(), F.col("leaves")).when(right, F.col("leaves") - half).otherwise(half).alias("leaves")))
    return _slots(rows.select(F.col("id").alias(id_col), "size", "text_crc32", F.col("first").cast("int").alias("shard")), id_col)


def _at_node(nodes: dict[int, dict]) -> Column:
    """The numbers of the node that a row belongs to, as a struct; null at other nodes. At most one node per shard, so a literal map."""
    return F.try_element_at(F.create_map(*[x for f, held in nodes.items() for x in (F.lit(f).cast("long"), F.struct(*[_number(v).alias(k) for k, v in held.items()]))]), F.col("first"))


def _number(value: float) -> Column:
    return F.lit(value) if isinstance(value, float) else F.lit(value).cast("long")


def _cuts(rows: DataFrame, keys: Column, n_dims: int) -> list[tuple] | None:
    """(first, dim, cut) for every node with rows: keys up to cut go left. None if there is no such node."""
    spread = [(F.shiftright(F.max(f"k{k}"), TIE) - F.shiftright(F.min(f"k{k}"), TIE)) for k in range(n_dims)]
    ends = [F.struct(F.min(f"k{k}").alias("low"), F.max(f"k{k}").alias("high")) for k in range(n_dims)]
    nodes = rows.groupBy("first").agg(F.first("leaves").alias("leaves"), F.sum("size").alias("bytes"), F.array(*spread).alias("spread"), F.array(*ends).alias("ends")).collect()
    if not nodes:
        return None
    state = {}
    for n in nodes:
        dim = max(range(n_dims), key=lambda k: (n["spread"][k], -k))
        state[n["first"]] = {"dim": dim, "low": n["ends"][dim]["low"], "high": n["ends"][dim]["high"], "goal": n["bytes"] * (n["leaves"] // 2) / n["leaves"], "below": 0, "own": 0}
    while any(s["low"] < s["high"] for s in state.values()):
        steps = {f: ((s["high"] - s["low"]) >> BIN) + 1 for f, s in state.items() if s["low"] < s["high"]}
        asked = _at_node({f: {**{k: state[f][k] for k in ("dim", "low", "high")}, "step": step} for f, step in steps.items()})
        key = F.get(keys, F.col("asked.dim").cast("int"))
        inside = rows.withColumn("asked", asked).where("asked is not null").select("first", "asked.low", "asked.high", "asked.step", "size", key.alias("key")).where("key between low and high")
        counted = inside.groupBy("first", F.floor((F.col("key") - F.col("low")) / F.col("step")).alias("bin")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        upto = counted.withColumn("upto", F.sum("bytes").over(Window.partitionBy("first").orderBy("bin")))
        goal = _at_node({f: {"goal": float(state[f]["goal"] - state[f]["below"])} for f in steps})["goal"]
        reached = upto.groupBy("first").agg(F.min(F.when(F.col("upto") >= goal, F.struct("bin", "upto", "bytes", "n"))).alias("hit"), F.max(F.struct("bin", "upto", "bytes", "n")).alias("last")).collect()
        for r in reached:
            s, hit = state[r["first"]], r["hit"] or r["last"]
            low = s["low"] + hit["bin"] * steps[r["first"]]
            s["below"] += hit["upto"] - hit["bytes"]
            s["end"] = min(s["high"], low + steps[r["first"]] - 1)
            s["low"], s["high"], s["own"] = low, low if hit["n"] == 1 else s["end"], hit["bytes"]
    cuts = []
    for f, s in state.items():
        # The row on the cut goes to the side that ends nearer to its share.
        nearer = s["goal"] - s["below"] < s["own"] / 2
        cuts.append((f, s["dim"], s["low"] - 1 if nearer else s.get("end", s["high"])))
    return cuts


def _slots(rows: DataFrame, id_col: str) -> DataFrame:
    """Number the rows of a shard: blocks of hashed ids are counted, and numbered from their offset."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64(id_col, F.lit("slot")), F.lit(SLOT_BLOCKS)))
    counts = rows.groupBy("shard", "block").count()
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shard", "block").orderBy(id_col, "text_crc32")
    numbered = rows.withColumn("place", F.row_number().over(own) - 1)
    return numbered.join(offsets, ["shard", "block"]).select(id_col, "size", "text_crc32", "shard", (F.col("offset") + F.col("place")).cast("long").alias("slot"))
