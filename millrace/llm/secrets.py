"""Secrets in texts: fixed patterns, and strings that a tokenizer's vocabulary does not know.

Words of any language fall into few tokens of a byte-level BPE vocabulary; random strings do not. A
run of key characters with few characters per token is reported, unless it is a known digest or UUID,
a number, or made of single-case parts that the vocabulary knows: these look like words, so they must
be longer, or fall into more tokens, than other runs.
"""

from __future__ import annotations

import re

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import read_ranks
from millrace.llm.common import blocks

# Fixed patterns and lengths of the contract.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LENGTH = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

#: Lengths in hexadecimal digits of the usual digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)
RUN = r"[A-Za-z0-9+/_=-]{%d,}"
#: A run of single-case parts is a key at SINGLE_LENGTH letters and digits, a shorter one below SINGLE_RATIO characters
#: a token; with fewer than SINGLE_LETTERS letters it is a number with a prefix.
SINGLE_LENGTH, SINGLE_RATIO, SINGLE_LETTERS = 20, 1.5, 8
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")

_assign, _access, _hex = re.compile(ASSIGN, re.ASCII | re.IGNORECASE), re.compile(ACCESS), re.compile(HEX)
_word = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]*|[0-9]*")


def is_known(run: str, tokens, chars_per_token: float = 2.0) -> bool:
    """Digests, UUIDs, numbers, and identifiers or paths whose parts are words that the vocabulary knows well.

    tokens(text): the count of tokens. Capitals count as known where their small letters are.
    """
    if UUID.fullmatch(run) or (len(run) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run)):
        return True
    parts = re.split(r"[-_/+=]+", run)
    if not all(_word.fullmatch(part) for part in parts):
        return False
    words = [part for part in parts if part.isalpha()]
    letters = sum(map(len, words))
    if letters < SINGLE_LETTERS:
        return True
    ratio = chars_per_token if sum(map(len, parts)) >= SINGLE_LENGTH else min(SINGLE_RATIO, chars_per_token)
    return letters > ratio * sum(min(tokens(w), tokens(w.lower())) for w in words)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and not overlapping within a kind."""
    found = []
    lower = text.lower()
    if any(word in lower for word in ASSIGN_WORDS):
        found += [(m.start(), "assign", m.end()) for m in _assign.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _access.finditer(text)]
    return found + [(m.start(), "hex", m.end()) for m in _hex.finditer(text)]


def find_secrets(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 min_length: int = 16, chars_per_token: float = 2.0) -> DataFrame:
    """Rows (id, spans array<struct<kind, start, end>>) in order of start, then kind as in KINDS.

    Offsets count code points, the end is exclusive. The kind `random` covers runs of `min_length` or
    more key characters with at most `chars_per_token` characters per token that no fixed pattern
    touches. A null or empty text has no spans; repeated rows come out repeatedly; other columns are
    not read.
    """
    with open(ranks_path, "rb") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())
    run_pattern = RUN % min_length

    def run(batches):
        coder = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=read_ranks(held.value), special_tokens={})
        runs = re.compile(run_pattern)
        order = {kind: k for k, kind in enumerate(KINDS)}

        def tokens(text):
            return len(coder.encode_ordinary(text))

        def spans(text):
            found = base_spans(text)
            covered = sorted((start, end) for start, _, end in found)
            for m in runs.finditer(text):
                start, end = m.span()
                if any(s < end and start < e for s, e in covered):
                    continue
                if end - start <= chars_per_token * tokens(m[0]) and not is_known(m[0], tokens, chars_per_token):
                    found.append((start, "random", end))
            found.sort(key=lambda x: (x[0], order[x[1]], x[2]))
            return [{"kind": kind, "start": start, "end": end} for start, kind, end in found]

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for part in blocks(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([spans(t) if t else [] for t in part.column(1).to_pylist()], type=kind)], ["id", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")
    return out.withColumnRenamed("id", id_col)


def joined(spans):
    """kind:start:end of an array of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the fixed patterns' spans, and all spans as a string."""
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    counts = [count(kind) for kind in KINDS]
    return found.select(id_col, *counts[:3], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), counts[3])
