"""Quality of texts by weak labels: heuristic labellers vote, expectation-maximisation finds how far each
can be trusted, and the posterior labels train a hashed linear scorer. No given label is used.

The votes of all documents are counted by pattern (at most 3 ** labellers), which is all that the
estimation needs. The scorer is fitted on a bounded sample and applied to every whole text in the scan;
nothing but pattern counts is shuffled.
"""

from __future__ import annotations

import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blocks, quietly

BUCKETS = 1 << 12
GRAM = 4
#: Bound of the training sample, in documents.
SAMPLE_ROWS = 4000
THRESHOLD = 0.5
_SYMBOLS = bytes(b"#%*&$|{}<>~^=+@\\_")
_LETTERS = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))
_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)

# Fixed list: frequent function words of English, German, French and Spanish.
COMMON = frozenset("the of and to in is that it for was on are as with by at from this be or an a der die das und in den von zu mit dem ist ein eine nicht als auch es für le la les de des du et un une que qui en dans est pour pas sur au par el los las y del se por con una su al lo como más".split())

#: What each labeller looks at, the values up to which it votes good, and from which it votes bad.
LABELLERS = (
    ("symbols", 0.03, 0.08),  # marks per character
    ("shouting", 0.2, 0.5),  # capitals per letter
    ("same_words", 0.35, 0.5),  # words that are repeats among 100 words
    ("stutter", 0.05, 0.2),  # words equal to the word before
    ("same_lines", 0.1, 0.4),  # lines seen before in the text
    ("odd_length", 0.15, 0.4),  # words of over 16 or of one or two characters, but for common ones
    ("no_common", 0.85, 0.95),  # words that are no function words
    ("loose_ends", 0.25, 0.5),  # lines that end without a full stop or the like
    ("marked_words", 0.1, 0.3),  # words that end in two or more marks
)


def statistics(text: str | None) -> list[float] | None:
    """The values of LABELLERS; None for a text without words."""
    text = text or ""
    words = text.split()
    if not words:
        return None
    raw = text.encode("utf-8")
    letters = len(raw.translate(None, _LETTERS))
    n = len(words)
    plain = [w.strip(".,;:!?\"'()").lower() for w in words]
    stutter = sum(map(eq, plain, plain[1:]))
    fresh = sum(len(set(plain[at : at + 100])) for at in range(0, n, 100))
    lines = [line for line in text.split("\n") if line.strip()]
    odd = sum(1 for w in plain if (len(w) > 16 or len(w) < 3) and w not in COMMON)
    ends = sum(1 for line in lines if line.rstrip()[-1] not in ".!?:;\"'")
    marked = sum(1 for w in words if len(w) > 2 and not w[-1].isalnum() and not w[-2].isalnum())
    return [
        1 - len(raw.translate(None, _SYMBOLS)) / len(raw), len(raw.translate(None, _UPPER)) / max(1, letters), 1 - fresh / n,
        stutter / n, 1 - len(set(lines)) / len(lines), odd / n, 1 - sum(1 for w in plain if w in COMMON) / n, ends / len(lines), marked / n,
    ]


def votes(values: list[float] | None) -> int:
    """The pattern of votes in base 3: 0 abstains, 1 good, 2 bad. All abstain on a text without words."""
    pattern = 0
    for value, (_, good, bad) in zip(values or [], LABELLERS, strict=bool(values)):
        pattern = pattern * 3 + (1 if value <= good else 2 if value >= bad else 0)
    return pattern


def digits(pattern: int) -> list[int]:
    return [pattern // 3**k % 3 for k in range(len(LABELLERS) - 1, -1, -1)]


def estimate(counts: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of good for every pattern, and P(vote good | class) per labeller, by expectation-maximisation.

    Votes are independent given the class; abstaining says nothing. The start is the share of good votes,
    so good is the class that most labellers call good. Ties and no votes start at one half.
    """
    patterns = list(counts)
    cast = np.array([digits(p) for p in patterns]).reshape(-1, len(LABELLERS))
    weight = np.array([counts[p] for p in patterns], dtype=float)
    good, any_ = (cast == 1).astype(float), (cast > 0).astype(float)
    posterior = (good.sum(axis=1) + 0.5) / (any_.sum(axis=1) + 1)
    rate = np.full((2, len(LABELLERS)), 0.5)
    for _ in range(rounds):
        logs = []
        for k, share in enumerate((1 - posterior, posterior)):
            mass = weight * share
            # Pseudo-counts hold that a labeller is right more often than not.
            rate[k] = (mass @ good + (2 if k else 1)) / (mass @ any_ + 3)
            prior = (mass.sum() + 1) / (weight.sum() + 2)
            logs.append(np.log(prior) + good @ np.log(rate[k]) + (any_ - good) @ np.log(1 - rate[k]))
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))
    return dict(zip(patterns, posterior.tolist(), strict=True)), rate


def hashed(text: str | None, values: list[float] | None) -> np.ndarray:
    """Hashed features: shares of byte n-grams, and the range each statistic falls in."""
    out = np.zeros(BUCKETS, dtype=np.float32)
    raw = np.frombuffer((text or "").encode("utf-8"), dtype=np.uint8).astype(np.uint32)
    n = len(raw) - GRAM + 1
    if n > 0:
        code = np.zeros(n, dtype=np.uint32)
        for k in range(GRAM):
            code = (code ^ raw[k : k + n]) * np.uint32(0x9E3779B1)
        out += np.bincount(code >> np.uint32(20), minlength=BUCKETS)[:BUCKETS].astype(np.float32) / np.float32(n)
    for k, value in enumerate(values or []):
        out[zlib.crc32(b"%d:%d" % (k, min(20, int(value * 20)))) % BUCKETS] += 1.0
    return out


def train(features: np.ndarray, target: np.ndarray, rounds: int = 300, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic weights on soft labels, by gradient descent with momentum and a step per feature."""
    weights, bias = np.zeros(features.shape[1], np.float32), 0.0
    if not len(features):
        return weights, bias
    scale = 1 / (np.sqrt((features * features).mean(axis=0)) + 1e-3)
    speed, speed_bias = np.zeros_like(weights), 0.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(features @ weights + bias, -30, 30))) - target
        slope = (features.T @ error.astype(np.float32)) / len(features)
        speed = 0.9 * speed - 0.05 * (slope * scale + penalty * weights / scale) * scale
        speed_bias = 0.9 * speed_bias - 0.2 * float(error.mean())
        weights, bias = weights + speed.astype(np.float32), bias + speed_bias
    return weights, bias


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Weights and offset. Votes of all documents are counted; the scorer takes about `sample_rows` of them, by a
    hash of the id. Documents without words are not learnt from."""

    def run(batches):
        counts: Counter = Counter()
        for part in quietly(blocks(batches, 0)):
            counts.update(votes(v) for v in map(statistics, part.column(0).to_pylist()) if v)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), type=pa.int32()), pa.array(list(counts.values()), type=pa.int64())], ["pattern", "n"])

    found = docs.select(docs[text_col].alias("text")).mapInArrow(run, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    posterior, _ = estimate({r["pattern"]: r["n"] for r in found})
    total = sum(r["n"] for r in found)
    share = min(1.0, sample_rows / max(1, total))
    drawn = docs.where(F.pmod(F.xxhash64(docs[id_col]), F.lit(1 << 30)) < int(share * (1 << 30)))

    def featured(batches):
        for part in quietly(blocks(batches, 1)):
            rows = [(i, v, t) for i, t in zip(range(part.num_rows), part.column(1).to_pylist(), strict=True) for v in [statistics(t)] if v]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([i for i, _, _ in rows], type=pa.int64())), pa.array([votes(v) for _, v, _ in rows], type=pa.int32()), pa.array([hashed(t, v).tobytes() for _, v, t in rows], type=pa.binary())], ["id", "pattern", "features"])

    kind = docs.schema[id_col].dataType.simpleString()
    sample = drawn.select(drawn[id_col].alias("id"), drawn[text_col].alias("text")).mapInArrow(featured, f"id {kind}, pattern int, features binary")
    rows = sorted(sample.collect(), key=lambda r: (str(r["id"]), r["pattern"], bytes(r["features"])))
    features = np.array([np.frombuffer(r["features"], dtype=np.float32) for r in rows], dtype=np.float32).reshape(-1, BUCKETS)
    return train(features, np.array([posterior[r["pattern"]] for r in rows]))


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score, predicted, keep): score near 1 for good texts; predicted is 1, and keep true, from THRESHOLD on.

    Null texts and texts without words score 0. Repeated rows come out repeatedly; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, bias = held.value
        for part in quietly(blocks(batches, 1)):
            rows = [(t, statistics(t)) for t in part.column(1).to_pylist()]
            found = np.array([0.0 if v is None else 1 / (1 + np.exp(-np.clip(hashed(t, v) @ weights + bias, -60, 60))) for t, v in rows], dtype=float)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32)), pa.array(found >= THRESHOLD)], ["id", "score", "predicted", "keep"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int, keep boolean").withColumnRenamed("id", id_col)
