"""Byte-level BPE by corpus-level merge replay.

The words of a block of documents are laid out once in one row of symbols. An inverted index leads
from every merge to the positions where it applies. Merges are replayed in rank order; each visits
only its own positions, and only the two neighbours of a merged pair enter the index anew.

Words met before in the same worker come from a table of bounded size, so a frequent word is replayed
once per worker in the usual case. Texts are cut one at a time: a block never lies in memory word by
word, only its distinct words do. A worker outlives its task, and what it keeps counts in the executor's
memory during later stages too. The vocabulary (a fixed file of under 1 MB) is the only thing that is
broadcast; no row is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.llm.common import blocks, quietly

#: Words kept in each of the two tables beside those of the block at hand, and ranks of pairs kept.
CACHED_WORDS = 100_000
CACHED_PAIRS = 100_000
#: Pieces that are replayed together.
TOGETHER = 32_768
BLOCK_BYTES = 8_000_000


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines `base64 rank` of a vocabulary file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


def _keys(left: np.ndarray, right) -> np.ndarray:
    """Two symbols each, packed into one integer."""
    return left.astype(np.int64) << 32 | right


class Encoder:
    """Encodes words with a vocabulary of ranks; `pattern` cuts a text into words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.words = regex.compile(pattern)
        self.token = {rank: token for token, rank in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pair_ranks: dict[int, int] = {}
        self.first: dict[str, bytes | None] = {}
        self.later: dict[str, bytes | None] = {}
        self.break_ids = np.array([ranks[b"\n"]], dtype="<u4").tobytes()

    def pair(self, key: int) -> int:
        """Rank of the merge of two symbols, packed into one integer; -1 if there is none."""
        rank = self.pair_ranks.get(key)
        if rank is None:
            rank = self.pair_ranks[key] = self.ranks.get(self.token[key >> 32] + self.token[key & 0xFFFFFFFF], -1)
        return rank

    def _enter(self, index: dict, queue: list, keys: np.ndarray, places: np.ndarray) -> None:
        """Enter places into the inverted index under their pairs, if these can merge."""
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        for key, start, end in zip(keys[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
            rank = self.pair(key)
            if rank >= 0:
                if rank not in index:
                    index[rank] = []
                    heappush(queue, rank)
                index[rank].append((key, places[start:end]))

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The token ids of every word, as little-endian unsigned 32-bit integers.

        A word that is a token itself needs no merge: the replay reaches the same token.
        """
        if not words:
            return []
        if len(self.pair_ranks) > CACHED_PAIRS:
            self.pair_ranks.clear()
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum([len(w) for w in words])
        n = len(flat)
        symbol, after, before = self.byte[flat], np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[np.concatenate(([0], ends[:-1]))] = -1
        index: dict[int, list] = {}
        queue: list[int] = []
        places = np.flatnonzero(after >= 0).astype(np.int32)
        if len(places):
            self._enter(index, queue, _keys(symbol[places], symbol[places + 1]), places)
        while queue:
            rank = heappop(queue)
            entries = index.pop(rank)
            if len(entries) == 1:
                key, at = entries[0]
            else:
                at, where = np.unique(np.concatenate([places for _, places in entries]), return_index=True)
                key = np.repeat([key for key, _ in entries], [len(places) for _, places in entries])[where]
            right = after[at]
            at = at[(right >= 0) & (_keys(symbol[at], symbol[right]) == key)]
            if not len(at):
                continue
            if len(at) > 1:
                # Overlapping pairs (aaa): from the left, every other one of a run.
                chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
                if chained.any():
                    step = np.arange(len(at))
                    at = at[(step - np.maximum.accumulate(np.where(chained, 0, step))) % 2 == 0]
            right = after[at]
            last = after[right]
            symbol[at], symbol[right], after[at] = rank, -1, last
            has = last >= 0
            last, left = last[has], at[has]
            before[last] = left
            prior = before[at]
            prior = prior[prior >= 0]
            keys = np.concatenate((rank << 32 | symbol[last].astype(np.int64), _keys(symbol[prior], rank)))
            if len(keys):
                self._enter(index, queue, keys, np.concatenate((left, prior)))
        alive = symbol >= 0
        coded = symbol[alive].astype("<u4").tobytes()
        stops = (np.cumsum(alive)[ends - 1] * 4).tolist()
        return [coded[start:stop] for start, stop in zip([0, *stops[:-1]], stops, strict=True)]

    def learn(self, first: set[str], later: set[str]) -> None:
        """Enter the ids of pieces that begin a line, and of pieces that follow one space.

        A piece that is empty, or has white space at an end, has no ids of its own (None): the space
        beside it may belong to another word. A table that grows past its size keeps only these pieces.
        """
        for known, pieces, lead in ((self.first, first, ""), (self.later, later, " ")):
            new = [p for p in pieces if p not in known]
            if len(known) + len(new) > CACHED_WORDS:
                kept = {p: known[p] for p in pieces if p in known}
                known.clear()
                known.update(kept)
            whole = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()]
            known.update(dict.fromkeys(new))
            for start in range(0, len(whole), TOGETHER):
                part = whole[start : start + TOGETHER]
                known.update(zip(part, self.code([lead + p for p in part]), strict=True))

    def code(self, texts: list[str]) -> list[bytes]:
        """The ids of texts by way of the pattern; their distinct words are replayed together."""
        parts = [self.words.findall(text) for text in texts]
        words = list(set().union(*parts))
        ids = dict(zip(words, self.replay([w.encode("utf-8") for w in words]), strict=True))
        return [b"".join([ids[w] for w in part]) for part in parts]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text as bytes. Lines are cut at single spaces, where words always end; texts
        with other white space go through the pattern as a whole."""
        first, later = set(), set()
        for text in filter(None, texts):
            for line in text.split("\n"):
                head, *rest = line.split(" ")
                first.add(head)
                later.update(rest)
        self.learn(first, later)
        first, later, whole, out = self.first, self.later, [], []
        for k, text in enumerate(texts):
            lines = (line.split(" ") for line in text.split("\n")) if text else ()
            try:
                out.append(self.break_ids.join([b"".join([first[line[0]], *[later[p] for p in line[1:]]]) for line in lines]))
            except TypeError:
                whole.append(k)
                out.append(b"")
        for k, ids in zip(whole, self.code([texts[k] for k in whole]), strict=True):
            out[k] = ids
        return out

    def decode(self, ids) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids])


def _prepared(content: bytes, pattern: str) -> Encoder:
    """One encoder per worker process: its table of words serves later tasks too."""
    key = hashlib.sha1(content).hexdigest() + pattern
    if key not in _READY:
        _READY.clear()
        _READY[key] = Encoder(read_ranks(content), pattern)
    return _READY[key]


_READY: dict[str, Encoder] = {}


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>): the tokens of every whole text. A null text counts as empty and has no ids.

    `path` is the vocabulary file on the driver. Repeated rows come out repeatedly; other columns of
    the input are not read.
    """
    held = _vocabulary(df, path)

    def run(batches):
        encoder = _prepared(held.value, pattern)
        for part in quietly(blocks(batches, 1, BLOCK_BYTES)):
            ids = [np.frombuffer(b, dtype="<u4").astype(np.int32) for b in encoder.encode(part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, type=pa.list_(pa.int32()))], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text): the text of every list of ids. Null lists give empty texts; bytes that are no
    whole characters become U+FFFD."""
    held = _vocabulary(df, path)

    def run(batches):
        token = {rank: t for t, rank in read_ranks(held.value).items()}
        for batch in batches:
            texts = [b"".join([token[i] for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], ["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[ids_col].alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode the ids again, and return (id, n_tokens, ids_sha256, decoded_sha256).

    The ids stay in the task; their digest is taken over little-endian unsigned 32-bit integers.
    """
    held = _vocabulary(df, path)

    def run(batches):
        encoder = _prepared(held.value, pattern)
        for part in quietly(blocks(batches, 1, BLOCK_BYTES)):
            coded = encoder.encode(part.column(1).to_pylist())
            back = [hashlib.sha256(encoder.decode(np.frombuffer(b, dtype="<u4").tolist())).hexdigest() for b in coded]
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(b) // 4 for b in coded], type=pa.int64()),
                pa.array([hashlib.sha256(b).hexdigest() for b in coded]), pa.array(back),
            ], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
