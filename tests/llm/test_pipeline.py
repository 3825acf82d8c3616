import hashlib

import corpus_pipeline
from millrace.llm import decontam, toxicity
from millrace.llm.common import load, table
from tests.llm.test_decontam import brute as leaked
from tests.llm.test_simhash import brute_classes, brute_print

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = load(spark, SF, "documents")
    columns = docs.columns
    held, results = docs, []
    for _, stage in corpus_pipeline.STAGES:
        held = table(stage(spark, held, SF))
        results.append(held)
    assert all(r.columns == columns for r in results[:-1])
    start, clean, lined, single, free = ({r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()} for df in [docs, *results[:-1]])

    net = toxicity.fit(docs, load(spark, SF, "labels").where(corpus_pipeline.remainder() != 2))
    ids = sorted(start)
    scores = toxicity.probability(net, toxicity.text_logits(net, toxicity.Texts([start[i] for i in ids]), len(ids)))
    assert set(clean) == {i for i, s in zip(ids, scores, strict=True) if s < toxicity.THRESHOLD}

    assert set(lined) == set(clean)
    seen = set()
    for i in sorted(lined):
        kept = [line for line in lined[i].split("\n") if len(line) >= 10]
        assert not seen & set(kept) and set(kept) <= set(clean[i].split("\n"))
        seen |= set(kept)

    classes = brute_classes({i: brute_print(t) for i, t in lined.items()})
    assert set(single) == {i for i, c in classes.items() if i == c}

    items = {r["item_id"]: r["text"] for r in load(spark, SF, "benchmark").collect()}
    assert set(free) == set(single) - {i for i, _ in leaked(single, items)}
    assert decontam.SHINGLE == 5

    last = {r["doc_id"]: r["decoded_sha256"] for r in results[-1].collect()}
    assert last == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in free.items()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r) for r in results[-1].collect()}
