import random
import tracemalloc
import zlib

import numpy as np
import pytest

from millrace.llm import toxicity
from millrace.llm.queries import op8_toxicity
from tests.llm.common import hard_rows, no_rows

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def fitted():
    rng = random.Random(1)
    plain = ["".join(rng.choice("abcdeghilmnorst") for _ in range(rng.randrange(2, 8))) for _ in range(200)]
    rows = []
    for k in range(800):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 200))]
        if k % 4 == 0:
            words.insert(rng.randrange(len(words)), "zuq" + rng.choice(["", "a", "er", "us"]))
        rows.append((" ".join(words), int(k % 4 == 0)))
    return toxicity.train(rows, epochs=8), plain


@pytest.fixture(scope="module")
def net(fitted):
    return fitted[0]


def test_gradients_match_differences():
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, mask = rng.standard_normal((3, toxicity.WINDOW, toxicity.WIDTH)), np.ones((3, toxicity.WINDOW), bool)
    mask[0, 7:] = False
    label, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 0.3, 0.2])

    def loss():
        logit = net.forward(x, mask)[0].astype(np.float64)
        return float((weight * (np.logaddexp(0, logit) - label * logit)).sum())

    g, dx = net.gradient(x, mask, label, weight)
    for value, slope in [*((net.p[k], g[k]) for k in ("in0", "in1", "rec0", "rec1", "b0", "attend", "out", "bias")), (x, dx)]:
        at = tuple(rng.integers(n) for n in value.shape)
        old = value[at]
        value[at] = old + 1e-3
        up = loss()
        value[at] = old - 1e-3
        down = loss()
        value[at] = old
        assert slope[at] == pytest.approx((up - down) / 2e-3, rel=0.03, abs=2e-4)


def test_windows_agree_with_the_plain_pass(net):
    texts = ["one two three", "", None, " ".join(f"word{k}" for k in range(61)), "zuqer"]
    held = toxicity.Texts(texts)
    fast = toxicity.window_logits(net, held)
    x = np.concatenate((net.embed(*toxicity.features(held.words)), np.zeros((1, toxicity.WIDTH), np.float32)))[held.index]
    assert np.allclose(fast, net.forward(x, held.mask)[0], atol=1e-4)
    # 61 words: windows begin at 0, 12, 24, 36 and 37, the last one ends the text.
    assert held.owner.tolist() == [0, 3, 3, 3, 3, 3, 4] and held.index[5, -1] == held.words.index(b"word60")


def test_one_word_in_a_very_long_text(fitted):
    net, plain = fitted
    rng = random.Random(7)
    words = [rng.choice(plain) for _ in range(3000)]
    long = " ".join(words)
    texts = [long, long + " zuqer", " ".join([*words[:900], "zuq", *words[900:]]), "zuqa", plain[0], ""]
    scores = toxicity.probability(net, toxicity.text_logits(net, toxicity.Texts(texts), len(texts)))
    assert (scores >= toxicity.THRESHOLD).tolist() == [False, True, True, True, False, False]


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in op8_toxicity(spark, SF).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    held = [(got[i]["predicted"], y) for i, y in labels.items() if got[i]["held_out"]]
    # This table has some 300 toxic rows to learn from; README has the figures for larger ones.
    hit, toxic, called = sum(p and y for p, y in held), sum(y for _, y in held), sum(p for p, _ in held)
    assert hit >= 0.9 * toxic and hit >= 0.75 * called
    scores = sorted((got[i]["score"], y) for i, y in labels.items() if got[i]["held_out"])
    ranks = [k for k, (_, y) in enumerate(scores) if y]
    assert (sum(ranks) - toxic * (toxic - 1) / 2) / (toxic * (len(scores) - toxic)) >= 0.97


def test_hard_rows(spark, net):
    got = toxicity.score(hard_rows(spark), net).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    kept = toxicity.clean(hard_rows(spark), net)
    assert kept.columns == hard_rows(spark).columns and kept.where("text is null").count() == 2
    assert toxicity.score(no_rows(spark), net).count() == 0


def test_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    for rows in ([], [(1, 0), (None, 1)], [(2, None)]):
        net = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert {r["predicted"] for r in toxicity.score(docs, net).collect()} == {0}


def test_windows_of_texts_need_little_memory(monkeypatch):
    monkeypatch.setattr(toxicity, "BATCH", 50)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choices(words, k=n)) for n in (0, 1, 23, 24, 25, 36, 37, 5000)] + [None]
    found = toxicity.Texts(texts)
    want = []
    for k, text in enumerate(texts):
        own = (text or "").split()
        starts = [min(s, max(0, len(own) - toxicity.WINDOW)) for s in range(0, max(1, len(own) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP)] if own else []
        want += [(k, own[s : s + toxicity.WINDOW]) for s in starts]
    assert [(int(k), [found.words[i].decode() for i in row[on]]) for k, row, on in zip(found.owner, found.index, found.mask, strict=True)] == want
    assert (found.index[~found.mask] == -1).all()

    monkeypatch.setattr(toxicity, "BATCH", 4096)
    texts = [" ".join(rng.choices(words, k=20_000)) for _ in range(30)]
    tracemalloc.start()
    found = toxicity.Texts(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The windows take 6 MB; one string for each of the 600,000 words would take over 20 MB.
    assert len(found.owner) == 30 * 1666 and most < 18e6
