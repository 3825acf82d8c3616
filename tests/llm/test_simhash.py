import random

import xxhash

from millrace.llm import simhash
from millrace.llm.queries import op2_simhash_near_dedup
from tests.llm.common import hard_rows, no_rows, texts

SF = "/root/testdata/sf0.001"


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    """Smallest reachable id by id, over all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_whole_table_matches_brute_force(spark):
    prints = {r["doc_id"]: brute_print(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    classes = brute_classes(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op2_simhash_near_dedup(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", classes[i]) for i in prints}


def clusters(rng, centres, each, bits):
    found = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(each):
            word = centre
            for b in rng.sample(range(64), rng.randrange(bits)):
                word ^= 1 << b
            found.add(word)
    return sorted(found)


def test_links_of_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 4)  # so that cells are cut finer
    words = clusters(random.Random(5), 6, 60, 5)
    df = spark.createDataFrame([(w - (1 << 64) if w >> 63 else w,) for w in words], "bits long")
    got = {tuple(sorted((r["a"] % (1 << 64), r["b"] % (1 << 64)))) for r in simhash.links(df).collect()}
    want = {(a, b) for a in words for b in words if a < b and bin(a ^ b).count("1") <= 2}
    assert got == want and len(want) > 500


def test_reference_distances_bound_the_distance(spark):
    words = clusters(random.Random(9), 3, 20, 12)
    references = [r % (1 << 64) for r in simhash.references()]
    table = {w: [bin(w ^ r).count("1") for r in references] for w in words}
    for a in words:
        for b in words:
            bits, gap = bin(a ^ b).count("1"), max(abs(p - q) for p, q in zip(table[a], table[b], strict=True))
            assert gap <= bits and (bits <= 4 or gap > 2)


def test_hard_rows(spark):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(hard_rows(spark)).collect()]
    assert len(got) == 10
    by = {i: c for i, _, c in got if i is not None}
    assert by[1] == by[2] == by[3] == 1 and by[5] == by[6] == 5 and by[4] == 4
    assert {f for i, f, _ in got if i in (1, 2, 3)} == {"0" * 16}
    assert simhash.near_duplicates(no_rows(spark)).count() == 0
    kept = simhash.keep_first(hard_rows(spark))
    assert kept.columns == hard_rows(spark).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "5", "5", "7", "None", "None"]


def test_all_rows_alike(spark):
    got = simhash.near_duplicates(texts(spark, [(i, "one and the same text again") for i in range(500)])).collect()
    assert len(got) == 500 and {r["component_id"] for r in got} == {0}
