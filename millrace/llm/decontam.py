"""Benchmark decontamination: a BM25 index of the test items, searched with block-max WAND.

Every passage of every training document is a query. Impacts are BM25 weights as shares of what the
item scores on its own text, so one threshold serves all items. The shallow test of block-max WAND (do
the block maxima of the passage's lists reach the threshold in any block?) runs for all passages of a
block of documents at once; passages that pass it walk the posting lists with pivots. All items above
the threshold are then verified by the five-word shingles of their question and of their answer.

The index holds the items, never the documents. It is broadcast in parts of at most PART_BYTES of item
text, each part with its own scan of the documents; statistics are taken over all items.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.common import blocks, quietly, table

K1, B = 1.2, 0.75
#: Items in a block of a posting list, and cells of (passage, block) bounds held at once.
ITEMS = 4
CELLS = 1 << 22
SHINGLE = 5
PART_BYTES = 8 << 20
_MARKS = bytes.maketrans(b"".join(bytes([c]) for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII marks and white space separate."""
    return (text or "").lower().encode("utf-8").translate(_MARKS).split()


def question_and_answer(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The words before the last sentence, and the last sentence; both take in words of the other side
    until they have SHINGLE words."""
    words = words_of(text)
    stripped = (text or "").rstrip(" \t\r\n.!?")
    last = max(stripped.rfind(mark) for mark in ".!?\n")
    n = max(len(words_of(stripped[last + 1 :])), min(SHINGLE, len(words)))
    return words[: max(len(words) - n, SHINGLE)], words[len(words) - n :]


def shingles(words: list[bytes], width: int = SHINGLE) -> set[bytes]:
    """Runs of `width` words."""
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def overlap(part: list[bytes], passage: list[bytes]) -> float:
    """Share of the part's shingles that the passage has; a part below SHINGLE words is one shingle."""
    width = min(SHINGLE, len(part))
    own = shingles(part, width)
    return len(own & shingles(passage, width)) / len(own)


class Index:
    """Posting lists of impacts, ordered by item, with the maxima of blocks of ITEMS items."""

    def __init__(self, items: list[tuple], weights: list[dict[bytes, float]]):
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(text) for _, text in items]
        self.length = max([32, *(len(words_of(text)) for _, text in items)])
        lists: dict[bytes, list[tuple[int, float]]] = {}
        for k in range(len(items)):
            for word, weight in weights[k].items():
                lists.setdefault(word, []).append((k, weight))
        self.number = {word: n for n, word in enumerate(lists)}
        self.lists = list(lists.values())
        self.most = np.array([max(w for _, w in posts) for posts in self.lists])
        self.blocks = -(-len(items) // ITEMS)
        self.tops = []
        for posts in self.lists:
            tops: dict[int, float] = {}
            for k, w in posts:
                tops[k // ITEMS] = max(w, tops.get(k // ITEMS, 0.0))
            self.tops.append(tops)
        # The block maxima for the shallow pass: lists that most blocks hold as a matrix, all others in one row.
        self.wide = np.array([2 * len(t) > self.blocks for t in self.tops], dtype=bool)
        self.wide_row = np.cumsum(self.wide) - 1
        self.wide_tops = np.zeros((int(self.wide.sum()), self.blocks), dtype=np.float32)
        for t in np.flatnonzero(self.wide).tolist():
            self.wide_tops[self.wide_row[t], list(self.tops[t])] = list(self.tops[t].values())
        sizes = np.array([0 if wide else len(t) for t, wide in zip(self.tops, self.wide, strict=True)], dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        narrow = [t for t, wide in zip(self.tops, self.wide, strict=True) if not wide]
        self.top_block = np.array([k for t in narrow for k in t], dtype=np.int64)
        self.top_weight = np.array([w for t in narrow for w in t.values()])

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """Block-max WAND: every item whose impacts over the distinct terms sum to `least` or more."""
        lists, tops, most = self.lists, self.tops, self.most
        at = dict.fromkeys(terms, 0)
        live = sorted(terms, key=lambda t: lists[t][0][0])
        found = []
        while live:
            bound, pivot = 0.0, -1
            for k, t in enumerate(live):
                bound += most[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[live[pivot]][at[live[pivot]]][0]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][at[live[pivot + 1]]][0] == item:
                pivot += 1
            # The lists up to the pivot, with their maxima in the pivot's block of items.
            block = item // ITEMS
            bound = sum(tops[t].get(block, 0.0) for t in live[: pivot + 1])
            if bound >= least:
                score = 0.0
                for t in live[: pivot + 1]:
                    posts, k = lists[t], at[t]
                    while k < len(posts) and posts[k][0] < item:
                        k += 1
                    if k < len(posts) and posts[k][0] == item:
                        score += posts[k][1]
                        k += 1
                    at[t] = k
                if score >= least:
                    found.append((item, score))
                goal = item + 1
            else:
                goal = (block + 1) * ITEMS
                if pivot + 1 < len(live):
                    goal = max(item + 1, min(goal, lists[live[pivot + 1]][at[live[pivot + 1]]][0]))
            for t in live[: pivot + 1]:
                posts, k = lists[t], at[t]
                while k < len(posts) and posts[k][0] < goal:
                    k += 1
                at[t] = k
            live = sorted((t for t in live if at[t] < len(lists[t])), key=lambda t: lists[t][at[t]][0])
        return found

    def shallow(self, owner: np.ndarray, term: np.ndarray, passages: int, least: float) -> np.ndarray:
        """Passages in which some block of items may reach `least`; (owner, term) are distinct pairs."""
        found = []
        step = max(1, CELLS // max(1, self.blocks))
        cuts = np.searchsorted(owner, np.arange(0, passages + step, step))
        for k, start in enumerate(range(0, passages, step)):
            who, what = owner[cuts[k] : cuts[k + 1]], term[cuts[k] : cuts[k + 1]]
            sizes = self.first[what + 1] - self.first[what]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[what] - (ends - sizes), sizes)
            n = min(step, passages - start)
            cell = np.repeat((who - start) * self.blocks, sizes) + self.top_block[at]
            has = np.zeros((n, len(self.wide_tops)), dtype=np.float32)
            wide = self.wide[what]
            has[who[wide] - start, self.wide_row[what[wide]]] = 1
            bound = np.bincount(cell, self.top_weight[at], n * self.blocks).reshape(n, self.blocks) + has @ self.wide_tops
            found.append(start + np.flatnonzero(bound.max(axis=1) >= least - 1e-5))
        return np.concatenate(found)

    def leaks(self, texts: list[str | None], least: float, similar: float) -> list[tuple]:
        """(text number, item, score, question overlap, answer overlap, first word) of the best passage of a
        text for each item that it leaks."""
        words = [words_of(text) for text in texts]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        if not sizes.sum() or not self.lists:
            return []
        get = self.number.get
        terms = np.fromiter(map(get, chain.from_iterable(words), repeat(-1)), dtype=np.int64, count=int(sizes.sum()))
        # Passages of two lengths of the longest item, one length apart: each item lies whole in one of them.
        step = self.length
        counts = np.maximum(1, -(-sizes // step) - 1) * (sizes > 0)
        base = np.cumsum(counts) - counts
        text = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(terms)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        piece = place // step
        known = terms >= 0
        text, piece, terms = text[known], piece[known], terms[known]
        later, earlier = piece < counts[text], piece > 0
        owner = np.concatenate((base[text[later]] + piece[later], base[text[earlier]] + piece[earlier] - 1))
        pairs = np.sort(owner * len(self.lists) + np.concatenate((terms[later], terms[earlier])))
        pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))[: len(pairs)]]
        owner, term = pairs // len(self.lists), pairs % len(self.lists)
        best: dict[tuple, tuple] = {}
        ends = np.cumsum(counts)
        for passage in self.shallow(owner, term, int(counts.sum()), least).tolist():
            low, high = np.searchsorted(owner, (passage, passage + 1))
            for k, score in self.search(term[low:high].tolist(), least):
                t = int(np.searchsorted(ends, passage, side="right"))
                start = (passage - int(base[t])) * step
                if (t, k) in best and best[t, k][2] >= score:
                    continue
                question, answer = (overlap(part, words[t][start : start + 2 * step]) for part in self.parts[k])
                if question >= similar and answer >= similar:
                    best[t, k] = (t, self.ids[k], score, question, answer, start)
        return list(best.values())


def impacts(items: DataFrame) -> DataFrame:
    """Items (key, id, text, weights map<word, impact>); the impacts of an item sum to 1."""

    def run(batches):
        for part in blocks(batches, 1):
            rows = []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = words_of(text)
                rows += [(key, word.decode("utf-8"), n, len(words)) for word, n in Counter(words).items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], ["key", "word", "tf", "dl"])

    counts = table(items.select("key", "text").mapInArrow(run, "key long, word string, tf long, dl long"))
    known = counts.groupBy("word").agg(F.count("*").alias("df"))
    whole = counts.groupBy("key").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).first()
    rare = F.log(1 + (F.lit(whole["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    raw = rare * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(whole["mean"] or 1.0)))
    scored = counts.join(known, "word").select("key", "word", raw.alias("raw"))
    lists = scored.groupBy("key").agg(F.sum("raw").alias("own"), F.collect_list(F.struct("word", "raw")).alias("list"))
    return items.join(lists, "key").select("key", "id", "text", F.transform("list", lambda x: F.struct(x["word"].alias("word"), (x["raw"] / F.col("own")).alias("weight"))).alias("weights"))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          least: float = 0.6, similar: float = 0.8) -> DataFrame:
    """Rows (id, item, score, question_overlap, answer_overlap, word): a document's best passage for each
    item that it leaks. word is the first word of the passage.

    A passage leaks an item if its BM25 score is at least the share `least` of the item's own, and at
    least `similar` of the five-word shingles of both the question and the answer lie in it. Null and
    empty documents or items leak nothing; repeated documents come out repeatedly, repeated items count
    once; items of one id with different texts are tried separately and each may give a row. Other
    columns are not read.
    """
    named = items.select(items[item_col].alias("id"), items[text_col].alias("text")).where(F.trim("text") != "").distinct()
    named = named.withColumn("key", F.xxhash64("id", "text"))
    held = table(impacts(named).withColumn("bytes", F.octet_length("text")))
    parts = max(1, math.ceil((held.agg(F.sum("bytes")).first()[0] or 0) / PART_BYTES))
    key_kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = None
    for k in range(parts):
        rows = sorted(held.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k).collect(), key=lambda r: r["key"])
        packed = [(r["id"], r["text"], {w["word"].encode("utf-8"): w["weight"] for w in r["weights"]}) for r in rows]
        found = source.mapInArrow(_searcher(docs.sparkSession.sparkContext.broadcast(packed), to_arrow_type(items.schema[item_col].dataType), least, similar), f"id {key_kind}, item {item_kind}, score double, question_overlap double, answer_overlap double, word long")
        out = found if out is None else out.union(found)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def _searcher(held, item_type, least, similar):
    def run(batches):
        packed = held.value
        index = Index([(i, text) for i, text, _ in packed], [weights for _, _, weights in packed])
        for part in quietly(blocks(batches, 1)):
            rows = index.leaks(part.column(1).to_pylist(), least, similar)
            ids = part.column(0).take(pa.array([r[0] for r in rows], type=pa.int64()))
            items = pa.array([r[1] for r in rows], type=item_type)
            rest = [pa.array([r[c] for r in rows], type=pa.float64()) for c in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([ids, items, *rest, pa.array([r[5] for r in rows], type=pa.int64())], ["id", "item", "score", "question_overlap", "answer_overlap", "word"])

    return run


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that leak no item; rows with a null id stay."""
    found = leaks(docs, items, id_col, **options).select(F.col(id_col).alias("gone")).where("gone is not null").distinct()
    return docs.join(found, docs[id_col] == found["gone"], "left_anti")
