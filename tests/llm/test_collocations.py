import random
import re
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import collocations
from millrace.llm.queries import ORACLES, op11_collocations
from tests.llm.common import hard_rows, no_rows

NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_rows(df):
    return sorted(tuple(r[n] for n in NAMES) for r in df.collect())


def brute(rows, least=10, share=50, top=2000):
    """The contract, with Python's integers."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = {p for long, a in candidates.items() if len(long) == 4 for p in (long[:3], (long[0], *long[2:])) if p in candidates and 100 * a >= share * candidates[p]}
    by = {}
    for p, a in candidates.items():
        if p not in gone:
            cuts = [(1000000 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1)]
            score, _, left, right = min(cuts)
            by.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, held in by.items() for rank, (s, a, p, left, right) in enumerate(sorted(held)[:top], 1))


def corpus(seed, texts, words=60):
    rng = random.Random(seed)
    known = [f"w{k}" for k in range(words)] + ["É", "ß", "😀x", "A", "a", "New", "york", "don't"]
    ends = [" ", " ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "!?", "\x0b", " \x0c", "\x85", " ", " "]
    weight = [1 / (k + 1) for k in range(len(known))]
    out = []
    for _ in range(texts):
        text = "".join(w + rng.choice(ends) for w in rng.choices(known, weight, k=rng.randrange(60)))
        out.append((text + rng.choice(["", "new york times", " New York"]), rng.choice(["en", "de", None, "und", ""])))
    return out


def test_whole_table_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(NAMES)} FROM ({ORACLES['op11_collocations']})").fetchall()
    assert len(want) > 1000 and as_rows(op11_collocations(spark, sf)) == sorted(want)


@pytest.mark.parametrize(("least", "share", "top"), [(10, 50, 2000), (3, 80, 40)])
def test_matches_brute_force(spark, least, share, top):
    rows = corpus(least, 700)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = as_rows(collocations.collocations(df, least, share, top))
    assert got == brute(rows, least, share, top) and len(got) > 30


def test_many_tries_small_bitmaps_and_bounded_tallies(spark, monkeypatch):
    # Colliding hashes, full bitmaps and flushed tallies may add candidates, never change a count.
    monkeypatch.setattr(collocations, "TRIE_PHRASES", 300)
    monkeypatch.setattr(collocations, "BITMAP", (15, 15))
    monkeypatch.setattr(collocations, "HELD", 50)
    rows = corpus(8, 400, 300)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert as_rows(collocations.collocations(df, 5)) == brute(rows, 5)


@pytest.mark.parametrize("bits", [6, 11])
def test_phrases_that_share_a_hash_are_all_counted(spark, bits):
    rows = corpus(9, 300, 40)
    held = collocations.encoded(spark.createDataFrame(rows, "text string, lang string").repartition(3), "lang", "text")
    got, want = (collocations.phrase_counts(held, 4, mask) for mask in (2**bits - 1, 2**64 - 1))
    got, want = (sorted(tuple(r) for r in x.collect()) for x in (got, want))
    assert got == want and len(got) > 300


def test_trie_holds_exactly_its_phrases():
    rng = random.Random(2)
    phrases = sorted({(rng.choice("xyz"), " ".join(f"t{int(rng.paretovariate(0.6)) % 5000}" for _ in range(rng.randrange(1, 4)))) for _ in range(20000)})
    langs, texts = zip(*phrases, strict=True)
    size = [len(t.split()) for t in texts]
    part = pa.table({"shard": pa.array([3] * len(texts), pa.int32()), "lang": list(langs), "phrase": list(texts), "size": pa.array(size, pa.int32()), "h": pa.array(range(len(texts)))})
    built = collocations.build(part)
    trie = collocations.Trie(*(built.column(n)[len(texts)].as_py() for n in ("words", "langs", "base", "check", "accepts")))
    assert trie.phrases == len(phrases)
    probes = phrases + [("x", "t1 t2 unknown"), ("none", "t1"), ("y", "")]
    words = collocations.Words(pa.array([t for _, t in probes]))
    names = pa.array([lang for lang, _ in probes]).dictionary_encode()
    got = trie.counts(SimpleNamespace(names=words.names, code=words.code, joined=words.joined, langs=names.dictionary, lang=names.indices.to_numpy()[words.text]))
    want = Counter((lang, " ".join(w[i : i + k])) for lang, t in probes for w in [t.split()] for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert got.tolist() == [want[p] for p in phrases]


def test_words_across_texts_and_pieces():
    held = collocations.Words(pa.array(["A b,c", None, "", "é B\tb. ", "x"]))
    assert [held.names[i].as_py() for i in held.code.tolist()] == ["a", "b", "c", "é", "b", "b", "x"]
    assert held.joined.tolist() == [True, False, False, True, True, False, False] and held.text.tolist() == [0, 0, 0, 3, 3, 3, 4]
    some = collocations.Words(pa.array(["skip me", "a b", "c"]).slice(1, 1))
    assert len(some.code) == 2 and np.array_equal(some.joined, [True, False])


def test_scores_beyond_64_bits_are_exact(spark, monkeypatch):
    counts = [("en", "a", 1, 5 * 10**9), ("en", "b", 1, 4 * 10**9), ("en", "a b", 2, 3 * 10**9 + 1)]
    held = spark.createDataFrame(counts, "lang string, phrase string, size int, n long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: held)
    got = as_rows(collocations.collocations(spark.createDataFrame([("a b", "en")], "text string, lang string")))
    assert got == [("en", 1, "a b", 3 * 10**9 + 1, 5 * 10**9, 4 * 10**9, 2, 10**6 * (3 * 10**9 + 1) ** 2 // (20 * 10**18))]


def test_hard_rows(spark):
    from pyspark.sql import functions as F

    df = hard_rows(spark).withColumn("lang", F.lit(None).cast("string")).withColumns({n: F.lit("clash") for n in ("phrase", "h", "n", "total", "shard")})
    rows = [(r["text"], None) for r in df.select("text").collect()]
    got = as_rows(collocations.collocations(df))
    assert got == brute(rows) and got
    empty = no_rows(spark).withColumn("lang", F.lit("en"))
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(df.where("text = ''")).count() == 0


def test_many_tries_do_not_read_all_blocks_each(spark, monkeypatch):
    monkeypatch.setattr(collocations, "TRIE_PHRASES", 100)
    monkeypatch.setattr(collocations, "DEALT", 500, raising=False)
    monkeypatch.setattr(collocations, "UNIT_PLACES", 200, raising=False)
    passes, counted = [], collocations._counted
    monkeypatch.setattr(collocations, "_counted", lambda *a: passes.append(a) or counted(*a))
    rows = corpus(10, 300, 200)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert as_rows(collocations.collocations(df, 4)) == brute(rows, 4)
    assert len(passes) <= 2


@pytest.mark.parametrize("mask", [2**64 - 1, 15])
def test_dealt_phrases_are_those_of_the_blocks(mask):
    rows = corpus(11, 200, 40)
    whole = np.full(1 << 15, 255, np.uint8)
    dealer, want = collocations.Dealer(10**6), Counter()
    for number in range(4):
        words = collocations.Words(pa.array([t for t, _ in rows[number * 50 : number * 50 + 50]]))
        langs = pa.array([str(g) for _, g in rows[number * 50 : number * 50 + 50]]).dictionary_encode()
        hashes = np.array([collocations.xxhash.xxh64_intdigest(x.as_py().encode()) for x in words.names], np.uint64)
        block = SimpleNamespace(names=words.names, hashes=hashes, code=words.code, joined=words.joined, langs=langs.dictionary, lang=langs.indices.to_numpy()[words.text])
        dealer.add(block, collocations.levels(block, [whole] * 3, mask))
        names, lang = [words.names[int(c)].as_py() for c in words.code], [langs.dictionary[int(k)].as_py() for k in block.lang]
        for k in (1, 2, 3):
            want.update((lang[i], *names[i : i + k]) for i in range(len(names) - k + 1) if all(words.joined[i : i + k - 1]))
    got, shards = Counter(), {}
    for shard, *stored in dealer.deal(3):
        piece = collocations.Piece(*stored)
        for j in range(len(piece.n)):
            phrase = (piece.langs[int(piece.lang[j])].as_py(), *[piece.names[int(w)].as_py().decode() for w in piece.words[: piece.size[j], j]])
            got[phrase] += int(piece.n[j])
            shards.setdefault(phrase, set()).add(shard)
    assert got == want and all(len(s) == 1 for s in shards.values()) and not list(dealer.deal(3))
