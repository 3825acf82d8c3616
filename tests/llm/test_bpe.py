import base64
import hashlib
import random
import tracemalloc

import public_tokenizers
import pytest
import tiktoken

from millrace.llm import bpe
from millrace.llm.queries import op7_byte_bpe, vocabulary
from tests.llm.common import hard_rows, no_rows, texts

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def coder():
    with open(vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    with open(vocabulary(), "rb") as f:
        return bpe.Encoder(bpe.read_ranks(f.read()), public_tokenizers.PATTERN)


def ids(own, text):
    raw = own.encode([text])[0]
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


def test_whole_table(spark, coder):
    held = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op7_byte_bpe(spark, SF).collect()
    assert len(got) == len(held)
    for r in got:
        want = coder.encode_ordinary(held[r["doc_id"]])
        raw = b"".join(i.to_bytes(4, "little") for i in want)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(raw).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(held[r["doc_id"]].encode()).hexdigest()


def test_every_token_is_reached(own):
    tokens = list(own.ranks)
    assert [int.from_bytes(x[:4], "little") for x in own.replay(tokens)] == list(own.ranks.values())


def test_random_texts(own, coder):
    rng = random.Random(2)
    alphabets = ["aab \n", "".join(map(chr, range(1, 127))), "aäß😀　  \n'st"]
    for _ in range(2000):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(60)))
        assert ids(own, text) == coder.encode_ordinary(text), repr(text)
    for text in ("a" * 3000, "ab" * 3000, " " * 700, "\n\n\n", " lead", "trail ", "it's we'll", "<|endoftext|>"):
        assert ids(own, text) == coder.encode_ordinary(text)


def test_hard_rows(spark):
    df = hard_rows(spark)
    got = bpe.round_trip(df, vocabulary(), public_tokenizers.PATTERN).collect()
    assert len(got) == 10 and sum(r["n_tokens"] == 0 for r in got) == 3
    assert bpe.round_trip(no_rows(spark), vocabulary(), public_tokenizers.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(df, vocabulary(), public_tokenizers.PATTERN), vocabulary())
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] or "" for r in df.collect())


def test_small_cache(spark, monkeypatch, own, coder):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 10)
    for text in ("one two three four", "five six seven eight nine ten eleven", "one two three"):
        assert ids(own, text) == coder.encode_ordinary(text)
    assert texts(spark, []).count() == 0


def test_a_block_is_not_held_word_by_word(own, coder):
    rng = random.Random(3)
    words = ["".join(rng.choice("abdeghilmnorst") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    block = [" ".join(rng.choices(words, k=20_000)) for _ in range(30)]
    own.encode(block[:1])
    tracemalloc.start()
    found = own.encode(block)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [int.from_bytes(found[7][i : i + 4], "little") for i in range(0, len(found[7]), 4)] == coder.encode_ordinary(block[7])
    # The ids take 4 MB or so; one string for each of the 600,000 words would take over 30 MB.
    assert most < 16e6


def test_tables_stay_small_and_keep_the_words_at_hand(monkeypatch, own, coder):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 20)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 20)
    monkeypatch.setattr(bpe, "TOGETHER", 7)
    rng = random.Random(4)
    common = ["kibula", "morfent", "zastrip"]
    for _ in range(40):
        text = " ".join(["x", *common, *("".join(rng.choices("abcdefgh", k=9)) for _ in range(12))])
        assert ids(own, text) == coder.encode_ordinary(text)
        assert len(own.later) <= 20 + 15 and set(common) <= set(own.later)
        # The pairs of the pieces replayed last come on top.
        assert len(own.pair_ranks) <= 20 + 7 * 2 * 10
