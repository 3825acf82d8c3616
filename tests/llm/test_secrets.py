import hashlib
import re

import public_tokenizers

from millrace.llm import secrets
from millrace.llm.queries import op1_secret_scan, vocabulary
from tests.llm.common import LONG, hard_rows, no_rows, texts

SF = "/root/testdata/sf0.01"


def scan(df, **options):
    return secrets.find_secrets(df, vocabulary(), public_tokenizers.PATTERN, **options)


def brute(text):
    """The fixed patterns read off the contract, kind by kind."""
    text, found = text or "", []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, "assign", m.end()))
    for k, kind, pattern, least in ((1, "access", "AKIA[A-Z0-9]+", 16), (2, "hex", "[0-9a-f]+", 32)):
        found += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found))


def test_whole_table_matches_brute_force(spark):
    held = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op1_secret_scan(spark, SF).collect()
    assert len(got) == len(held)
    for r in got:
        base = brute(held[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(base.count(k + ":") for k in ("assign", "access", "hex"))
        assert {s for s in base.split(",") if s} <= set(r["spans"].split(","))
    assert any(r["n_assign"] for r in got)


def test_random_strings_but_no_words_or_known_forms(spark):
    random = "q7Zx1vPb9TfK3mWc8RdY2nLs"
    rows = [(1, f"see {random} there"), (2, "einiekeitgeentzber Donaudampfschifffahrtsgesellschaft"), (3, "id 123e4567-e89b-12d3-a456-426614174000"),
            (4, "order-20240101-1234567890"), (5, "=" * 40 + " " + "-" * 40), (6, f"token: {random}"), (7, "D41D8CD98F00B204E9800998ECF8427E")]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in scan(texts(spark, rows)).collect()}
    assert got[1] == [("random", 4, 4 + len(random))]
    assert got[2] == got[3] == got[4] == got[5] == got[7] == []
    assert got[6] == [("assign", 0, 7 + len(random))]


def test_failing_match_takes_its_text(spark):
    got = scan(texts(spark, [(1, "token: secret : abcdefgh12345"), (2, "PassWord='abcdefgh' 😀 APIKEY = 12345678")])).collect()
    spans = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in got}
    assert spans[1] == [] and spans[2] == [("assign", 0, 18), ("assign", 22, 39)]


def test_hard_rows(spark):
    got = secrets.digests(scan(hard_rows(spark))).collect()
    assert len(got) == 10 and all(r["spans"] == "" for r in got)
    assert scan(no_rows(spark)).count() == 0
    late = LONG + " password=abcdefghij"
    assert scan(texts(spark, [(1, late)])).first()["spans"][0]["end"] == len(late)


def test_single_case_keys_are_reported(spark):
    keys = ["qzjxkvbwmpfhgtrdlcsnyqxz", "QZJXKVBWMPFHGTRDLCSNYQXZ", "qzjx-kvbw-mpfh-gtrd-lcsn", "QZJX_4821_VKWB_9937_MPFH"]
    known = ["get_user_name_by_customer_id", "MAX_BATCH_SIZE_LIMIT_VALUE", "einiekeitgeentzber", "5927243074273351", "4504-9950-3869-3466-1187"]
    rows = [(k, f"see {x} there") for k, x in enumerate(keys + known)]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in scan(texts(spark, rows)).collect()}
    for k, x in enumerate(keys + known):
        assert got[k] == ([("random", 4, 4 + len(x))] if x in keys else []), x
