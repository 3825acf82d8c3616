"""Toxicity of texts: a bidirectional gated recurrent network with attention pooling, written in numpy.

A word enters as the sum of what is known of the word itself and of its characters: an embedding by the
hash of the word, and the mean embedding of its character n-grams. Two recurrent passes read a window of
words, attention pools their states, and a logistic unit scores the window. Windows overlap by half and
cover the whole text; a text scores as its highest window, on a scale calibrated on the training rows.

The network is fitted on the driver from a bounded sample of labelled rows; scoring runs in the scan, in
any number of tasks, and shuffles nothing.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blocks, quietly
from millrace.llm.decontam import words_of

WINDOW, STEP = 24, 12
HIDDEN, WIDTH = 8, 16
WORDS, GRAMS = 1 << 13, 1 << 14
NGRAMS = (3, 5)
#: Bounds of the training sample: rows of each label, and characters of a row.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 6000
THRESHOLD = 0.3
BATCH = 4096
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of distinct words; the hashes of all their character n-grams, and where each word's begin."""
    word = np.array([zlib.crc32(w) % WORDS for w in words], dtype=np.int64)
    flat = np.frombuffer(b"".join([b"\x02" + w + b"\x03" for w in words]), dtype=np.uint8).astype(np.uint32)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    hashes, owners = [], []
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(flat))
    for n in NGRAMS:
        code = np.full(len(flat), n, dtype=np.uint32)
        for k in range(n):
            code[: len(flat) - k] = (code[: len(flat) - k] ^ flat[k:]) * _MIX[k % 5] + np.uint32(k)
        # A word too short for an n-gram is one n-gram as a whole with what follows: it is left out.
        fits = left >= n
        code ^= code >> np.uint32(15)
        hashes.append((code[fits] * np.uint32(0x2C1B3C6D) >> np.uint32(18)).astype(np.int64) % GRAMS)
        owners.append(owner[fits])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return word, np.concatenate(hashes)[order], np.searchsorted(owner[order], np.arange(len(words)))


class Network:
    """Parameters by name in one dictionary; gates are laid out as update, reset, candidate."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, WIDTH

        def draw(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "word": draw(WORDS, d, scale=0.05), "gram": draw(GRAMS, d, scale=0.3),
            "in0": draw(d, 3 * h, scale=0.35), "in1": draw(d, 3 * h, scale=0.35), "b0": np.zeros(3 * h, np.float32), "b1": np.zeros(3 * h, np.float32),
            "rec0": draw(h, 3 * h, scale=0.3), "rec1": draw(h, 3 * h, scale=0.3),
            "attend": draw(2 * h, scale=0.3), "out": draw(2 * h, scale=0.3), "bias": np.zeros(1, np.float32),
        }
        self.scale = np.array([1.0, 0.0])

    def embed(self, word, gram, starts):
        sums = np.add.reduceat(self.p["gram"][gram], starts, axis=0)
        counts = np.diff(np.append(starts, len(gram)))
        return self.p["word"][word] + sums / counts[:, None].astype(np.float32)

    def forward(self, x, mask, keep=False):
        """Logits of windows x (n, WINDOW, WIDTH); mask is false at padding, which ends a short text."""
        p, h = self.p, HIDDEN
        n, steps = mask.shape
        states, kept = np.empty((n, steps, 2 * h), np.float32), []
        for side in (0, 1):
            gates = x @ p[f"in{side}"] + p[f"b{side}"]
            state = np.zeros((n, h), np.float32)
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                rec = state @ p[f"rec{side}"]
                zr = sigmoid(gates[:, t, : 2 * h] + rec[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(gates[:, t, 2 * h :] + r * rec[:, 2 * h :])
                following = np.where(mask[:, t, None], new + z * (state - new), state)
                if keep:
                    kept.append((side, t, state, z, r, new, rec[:, 2 * h :]))
                states[:, t, side * h : (side + 1) * h] = state = following
        weight = np.where(mask, states @ p["attend"], np.float32(-30.0))
        weight = np.exp(weight - weight.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", weight, states)
        logit = pooled @ p["out"] + p["bias"]
        return logit, (states, weight, pooled, kept)

    def gradient(self, x, mask, label, importance):
        """Gradients of the weighted log loss, of the parameters and of the inputs."""
        p, h = self.p, HIDDEN
        logit, (states, weight, pooled, kept) = self.forward(x, mask, keep=True)
        d_logit = ((sigmoid(logit) - label) * importance).astype(np.float32)
        g = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_states = weight[:, :, None] * d_pooled[:, None, :]
        d_weight = np.einsum("nth,nh->nt", states, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        g["attend"] = np.einsum("nt,nth->h", d_score, states)
        d_states += d_score[:, :, None] * p["attend"]
        dx = np.zeros_like(x)
        for side in (0, 1):
            g_rec, g_in, g_b = np.zeros_like(p[f"rec{side}"]), np.zeros_like(p[f"in{side}"]), np.zeros_like(p[f"b{side}"])
            back = np.zeros((len(x), h), np.float32)
            for s, t, state, z, r, new, rec_new in reversed(kept):
                if s != side:
                    continue
                on = mask[:, t, None]
                d = d_states[:, t, side * h : (side + 1) * h] + back
                d_new = d * (1 - z) * (1 - new * new) * on
                d_z = d * (state - new) * z * (1 - z) * on
                d_r = d_new * rec_new * r * (1 - r)
                d_gates = np.concatenate((d_z, d_r, d_new), axis=1)
                d_rec = np.concatenate((d_z, d_r, d_new * r), axis=1)
                g_rec += state.T @ d_rec
                g_in += x[:, t].T @ d_gates
                g_b += d_gates.sum(axis=0)
                dx[:, t] += d_gates @ p[f"in{side}"].T
                back = np.where(on, d * z, d) + d_rec @ p[f"rec{side}"].T
            g |= {f"rec{side}": g_rec, f"in{side}": g_in, f"b{side}": g_b}
        return g, dx


class Texts:
    """Texts as windows of word numbers; number -1 pads texts of fewer words than a window.

    Texts are cut one at a time, so only the distinct words are held beside their numbers.
    """

    def __init__(self, texts: list[str | None]):
        number: dict[bytes, int] = {}
        rows = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], dtype=np.int32) for t in texts]
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.words = list(number)
        sizes = np.array([len(row) for row in rows], dtype=np.int64)
        counts = np.where(sizes > 0, np.maximum(0, -(-(sizes - WINDOW) // STEP)) + 1, 0)
        self.owner = np.repeat(np.arange(len(rows)), counts)
        place = np.arange(len(self.owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        # The last window of a text ends with it.
        first = np.minimum(place * STEP, np.maximum(0, sizes[self.owner] - WINDOW))
        base = (np.cumsum(sizes) - sizes)[self.owner]
        self.mask = np.empty((len(self.owner), WINDOW), dtype=bool)
        self.index = np.full((len(self.owner), WINDOW), -1, dtype=np.int32)
        for start in range(0, len(self.owner), BATCH):
            part = slice(start, start + BATCH)
            at = first[part, None] + np.arange(WINDOW)
            self.mask[part] = at < sizes[self.owner[part], None]
            self.index[part] = np.where(self.mask[part], flat[np.minimum(base[part, None] + at, len(flat) - 1)], -1)


def window_logits(net: Network, texts: Texts) -> np.ndarray:
    """Logits of all windows. What a word gives to the gates is worked out once per distinct word."""
    if not len(texts.owner):
        return np.zeros(0, np.float32)
    p, h = net.p, HIDDEN
    tables = [[], []]
    for start in range(0, len(texts.words), 20_000):
        x = net.embed(*features(texts.words[start : start + 20_000]))
        for side in (0, 1):
            tables[side].append(x @ p[f"in{side}"] + p[f"b{side}"])
    # The row of padding holds the update gate open, so the state stays as it is.
    pad = np.concatenate((np.full(h, 40, np.float32), np.zeros(2 * h, np.float32)))[None]
    tables = [np.concatenate([*t, pad]).astype(np.float32) for t in tables]
    out = np.empty(len(texts.owner), np.float32)
    for start in range(0, len(out), BATCH):
        index, mask = texts.index[start : start + BATCH], texts.mask[start : start + BATCH]
        states = np.empty((WINDOW, len(index), 2 * h), np.float32)
        for side in (0, 1):
            state = np.zeros((len(index), h), np.float32)
            rec_w = p[f"rec{side}"]
            for t in range(WINDOW) if side == 0 else range(WINDOW - 1, -1, -1):
                gates = tables[side][index[:, t]]
                rec = state @ rec_w
                zr = gates[:, : 2 * h] + rec[:, : 2 * h]
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                new = rec[:, 2 * h :] * zr[:, h:]
                new += gates[:, 2 * h :]
                np.tanh(new, out=new)
                state = new + zr[:, :h] * (state - new)
                states[t, :, side * h : (side + 1) * h] = state
        weight = np.where(mask.T, states @ p["attend"], np.float32(-30.0))
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        out[start : start + BATCH] = np.einsum("tn,tnh->nh", weight, states) @ p["out"] + p["bias"]
    return out


def text_logits(net: Network, texts: Texts, n: int) -> np.ndarray:
    """The highest window of each text; -inf for texts without words."""
    out = np.full(n, -np.inf)
    if len(texts.owner):
        np.maximum.at(out, texts.owner, window_logits(net, texts))
    return out


def probability(net: Network, logits: np.ndarray) -> np.ndarray:
    """Calibrated scores; a text without words scores zero."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isneginf(logits), 0.0, 1 / (1 + np.exp(-np.clip(net.scale[0] * logits + net.scale[1], -60, 60))))


def train(rows: list[tuple[str | None, int]], weights: tuple[float, float] = (1.0, 1.0), epochs: int = 6, seed: int = 7) -> Network:
    """Fit the network to (text, label) rows; weights are how many rows of the table a row of each label stands for.

    The first epoch takes all windows with their text's label. Later ones take the windows that decide:
    the highest of each text, and some others of texts with label 0.
    """
    net = Network(seed)
    labels = np.array([label for _, label in rows], dtype=np.float32)
    if not len(rows) or labels.min() == labels.max():
        net.p["out"][:] = 0
        net.scale = np.array([0.0, 4.0 if len(rows) and labels.max() else -4.0])
        return net
    texts = Texts([t for t, _ in rows])
    word, gram, starts = features(texts.words)
    counts = np.diff(np.append(starts, len(gram)))
    rng = np.random.default_rng(seed)
    mean, square, step = {}, {}, 0
    for epoch in range(epochs):
        logit = window_logits(net, texts)
        order = np.lexsort((-logit, texts.owner))
        rank = np.arange(len(order)) - np.searchsorted(texts.owner, texts.owner[order])
        positive = labels[texts.owner[order]] == 1
        take = order if epoch == 0 else order[np.where(positive, rank < 1, (rank < 2) | (rng.random(len(order)) < 0.1))]
        take = rng.permutation(take)
        share = labels[texts.owner[take]].mean()
        for start in range(0, len(take), 256):
            batch = take[start : start + 256]
            label = labels[texts.owner[batch]]
            importance = np.where(label == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)) / len(batch)
            used, back = np.unique(texts.index[batch], return_inverse=True)
            back = back.reshape(len(batch), WINDOW)
            real = used[1:] if used[0] < 0 else used
            sizes = counts[real]
            grams = gram[np.repeat(starts[real] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            cuts = np.cumsum(sizes) - sizes
            table = net.p["word"][word[real]] + np.add.reduceat(net.p["gram"][grams], cuts, axis=0) / sizes[:, None].astype(np.float32)
            if used[0] < 0:
                table = np.concatenate((np.zeros((1, WIDTH), np.float32), table))
            g, dx = net.gradient(table[back], texts.mask[batch], label, importance.astype(np.float32))
            d_table = np.zeros_like(table)
            np.add.at(d_table, back.ravel(), dx.reshape(-1, WIDTH))
            d_table = d_table[len(used) - len(real) :]
            g["word"], g["gram"] = (word[real], d_table), (grams, np.repeat(d_table / sizes[:, None].astype(np.float32), sizes, axis=0))
            step += 1
            _adam(net.p, g, mean, square, step)
    final = text_logits(net, texts, len(rows))
    some = np.isfinite(final)
    net.scale = _calibrate(final[some], labels[some], np.where(labels[some] == 1, weights[1], weights[0]))
    return net


def _adam(p, g, mean, square, step, rate=0.01):
    for name, gradient in g.items():
        m, v = mean.setdefault(name, np.zeros_like(p[name])), square.setdefault(name, np.zeros_like(p[name]))
        if isinstance(gradient, tuple):  # rows of an embedding: only those touched move
            rows, back = np.unique(gradient[0], return_inverse=True)
            d = np.zeros((len(rows), p[name].shape[1]), np.float32)
            np.add.at(d, back, gradient[1])
        else:
            rows, d = slice(None), gradient
        m[rows] = 0.9 * m[rows] + 0.1 * d
        v[rows] = 0.99 * v[rows] + 0.01 * d * d
        p[name][rows] -= (rate * (m[rows] / (1 - 0.9**step)) / (np.sqrt(v[rows] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


def _calibrate(logit, label, weight):
    """Slope and offset of a logistic fit by Newton steps, with a small penalty on the slope."""
    x = np.stack((np.clip(logit, -15, 15), np.ones(len(logit))), axis=1)
    fit = np.array([0.5, 0.0])
    weight = weight / weight.sum()
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        slope = x.T @ (weight * (q - label)) + np.array([1e-3, 0]) * fit
        curve = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag([1e-3, 1e-6])
        fit = fit - np.clip(np.linalg.solve(curve, slope), -2, 2)
    return np.array([max(fit[0], 1e-3), fit[1]])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Network:
    """Fit on about `sample_rows` rows of each label (by a hash of the id) of at most `sample_chars` characters.

    Rows with a null label, id or text are not used; without rows of both labels every text scores alike.
    """
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).where("id is not null and label in (0, 1)")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, min(1.0, sample_rows / n))]) if counts else F.lit(None)
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[F.col("label")] * (1 << 30)) if counts else known
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(drawn), "id").where(F.length("text") <= sample_chars)
    held = sorted((r["id"], r["text"], r["label"]) for r in rows.select("id", "text", "label").collect())
    drawn_of = [max(1, sum(r[2] == k for r in held)) for k in (0, 1)]
    return train([(text, label) for _, text, label in held], tuple(counts.get(k, 0) / drawn_of[k] for k in (0, 1)))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score, predicted): predicted is 1 if the score is THRESHOLD or more.

    The whole text counts. Null texts, and texts without words, score 0. Repeated rows come out
    repeatedly; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for part in quietly(blocks(batches, 1)):
            texts = part.column(1).to_pylist()
            found = probability(held.value, text_logits(held.value, Texts(texts), len(texts)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], ["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def clean(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, without those predicted toxic; every row is judged in the scan."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def run(batches):
        for part in quietly(blocks(batches, at)):
            texts = part.column(at).to_pylist()
            found = probability(held.value, text_logits(held.value, Texts(texts), len(texts)))
            yield part.filter(pa.array(found < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
