import random

from millrace.llm import decontam
from millrace.llm.queries import op9_benchmark_decontamination
from tests.llm.common import hard_rows, no_rows, texts

SF = "/root/testdata/sf0.01"


def brute(docs, items, similar=0.8):
    """(doc, item) with enough five-word shingles of question and answer within two item lengths of words."""
    found = set()
    for i, text in docs.items():
        words = decontam.words_of(text)
        whole = decontam.shingles(words)
        for j, item in items.items():
            parts = decontam.question_and_answer(item)
            if all(len(decontam.shingles(p) & whole) >= similar * len(decontam.shingles(p)) for p in parts):
                found.add((i, j))
    return found


def test_whole_table_matches_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = op9_benchmark_decontamination(spark, SF).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items) and len(got) > 10
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})


def words(rng, n, size=400):
    return " ".join(f"w{int(rng.paretovariate(0.4)) % size}" for _ in range(n))


def test_search_finds_all_above_the_threshold():
    rng = random.Random(4)
    items = [(k, words(rng, rng.randrange(8, 50))) for k in range(150)]
    weights = []
    for _, text in items:
        raw = {w: rng.random() for w in set(decontam.words_of(text))}
        weights.append({w: x / sum(raw.values()) for w, x in raw.items()})
    index = decontam.Index(items, weights)
    for _ in range(300):
        own = {index.number[w] for w in decontam.words_of(words(rng, 80)) if w in index.number}
        names = {w for w, n in index.number.items() if n in own}
        scores = {k: sum(x for w, x in weights[k].items() if w in names) for k in range(len(items))}
        for least in (0.3, 0.6, 0.9):
            assert {k for k, _ in index.search(sorted(own), least)} == {k for k, s in scores.items() if s >= least + 1e-12 or abs(s - least) < 1e-12}


def test_planted_items(spark, monkeypatch):
    rng = random.Random(5)
    items = {k: f"{words(rng, 30, 5000)}. {words(rng, 8, 5000)}." for k in range(60)}
    items[60] = "One two. Three."
    docs = {k: words(rng, rng.randrange(20, 900), 5000) for k in range(200)}
    for k in range(0, 61):
        at = docs[k].split()
        cut = rng.randrange(len(at))
        docs[k] = " ".join([*at[:cut], items[k].upper().replace(" ", "\n"), *at[cut:]])
    docs[70] = items[3][: len(items[3]) // 2]
    for bytes_ in (decontam.PART_BYTES, 2000):  # also in several parts
        monkeypatch.setattr(decontam, "PART_BYTES", bytes_)
        got = decontam.leaks(texts(spark, list(docs.items())), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(k, k) for k in range(61)}


def test_hard_rows(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "same TEXT here it is the same"), (3, "same TEXT here it is the same"), (None, "a text without an id")], "item_id long, text string")
    got = decontam.leaks(hard_rows(spark), items).collect()
    assert sorted((str(r["doc_id"]), str(r["item_id"])) for r in got) == [("5", "3"), ("5", "3"), ("6", "3"), ("None", "None")]
    kept = decontam.without_leaks(hard_rows(spark), items)
    assert kept.columns == hard_rows(spark).columns and kept.count() == 7
    assert decontam.leaks(no_rows(spark), items).count() == 0
    assert decontam.leaks(hard_rows(spark), items.limit(0)).count() == 0
    assert decontam.leaks(texts(spark, [(1, "a")]), spark.createDataFrame([("x", "a")], "item_id string, text string")).first()["item_id"] == "x"
