import random

from pyspark.sql import functions as F

from millrace.llm import lines
from tests.llm.common import LONG, hard_rows, no_rows, texts


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, edits, letters):
    text = list(text)
    for _ in range(edits):
        at, how = rng.randrange(len(text) + 1), rng.randrange(3)
        if how == 0 or at == len(text):
            text.insert(at, rng.choice(letters))
        elif how == 1:
            text.pop(at)
        else:
            text[at] = rng.choice(letters)
    return "".join(text)


def brute(docs):
    """id -> kept text, by comparing every line with all earlier ones."""
    first, out = {}, {}
    order = [(i, p, line) for i, text in sorted(docs.items()) for p, line in enumerate(text.split("\n"))]
    for i, p, line in order:
        first.setdefault(line, (i, p))
    near = {b for b in first for a in first if first[a] < first[b] and min(len(a), len(b)) >= 30 and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2}
    for i, p, line in order:
        if len(line) < 10 or (first[line] == (i, p) and line not in near):
            out.setdefault(i, []).append(line)
    return {i: "\n".join(out.get(i, [])) for i in docs}


def corpus(rng, families, copies, length):
    docs = {}
    for k in range(families):
        base = "".join(rng.choice("abcdef ") for _ in range(length + rng.randrange(8)))
        for c in range(copies):
            docs[len(docs)] = "\n".join([changed(rng, base, rng.randrange(5), "abcdefgé😀"), "short", f"unique line number {k} {c} of them all"[: 12 + 9 * (c % 4)]])
    return docs


def test_distance_in_a_band(spark):
    rng, pairs = random.Random(3), []
    for _ in range(1500):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(14)))
        pairs.append((a, changed(rng, a, rng.randrange(5), "abé😀")))
    for _ in range(100):
        a = "".join(rng.choice("abcdef") for _ in range(rng.randrange(30, 200)))
        pairs.append((a, changed(rng, a, rng.randrange(5), "abcdef")))
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("near", lines.within_edits(F.col("a"), F.col("b")))
    assert all(r["near"] == (distance(r["a"], r["b"]) <= 2) for r in df.collect())


def test_matches_brute_force(spark):
    docs = corpus(random.Random(4), 25, 6, 40)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(texts(spark, list(docs.items()))).collect()}
    assert got == brute(docs)


def test_crowded_segments(spark, monkeypatch):
    monkeypatch.setattr(lines, "CELL_LINES", 3)  # so that groups are joined by what is left of their lines
    rng, docs = random.Random(6), {}
    for _ in range(4):
        head, tail = ("".join(rng.choice("abcdef ") for _ in range(60)) for _ in range(2))
        for _ in range(14):
            middle = "".join(rng.choice("xyz") for _ in range(rng.randrange(18, 22)))
            docs[len(docs)] = head + middle + tail
            docs[len(docs)] = head + changed(rng, middle, rng.randrange(1, 3), "xyz") + tail
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(texts(spark, list(docs.items()))).collect()}
    want = brute(docs)
    assert got == want and sum(not t for t in want.values()) > 10


def test_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lines, "BROADCAST_LISTS", 0)
    docs = corpus(random.Random(8), 6, 5, 50)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(texts(spark, list(docs.items()))).collect()}
    assert got == brute(docs)


def test_hard_rows(spark):
    got = lines.dedup_lines(hard_rows(spark)).collect()
    assert len(got) == 10 and set(hard_rows(spark).columns) <= set(got[0].asDict())
    by = {r["doc_id"]: r for r in got}
    assert by[1]["text"] is None and by[1]["n_lines"] == 0 and by[2]["text"] == "" and by[3]["text"] == " \n\t "
    assert by[4]["text"] == LONG or by[4]["n_dropped"] > 0
    assert [r["text"] for r in got if r["doc_id"] == 5] == ["Same text here. It is the same."] * 2 and by[6]["text"] == ""
    assert lines.dedup_lines(no_rows(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = lines.dedup_lines(texts(spark, [(1, "a line that is long enough to be near another")]))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_near_copies_of_a_null_id_go(spark):
    line = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(None, "first line here of its own\n" + line), (5, line[:20] + "#" + line[20:]), (6, line.replace("lazy", "lady"))]
    got = {r["doc_id"]: r["n_dropped"] for r in lines.dedup_lines(texts(spark, rows)).collect()}
    assert got == {None: 0, 5: 1, 6: 1}


def test_columns_of_any_name(spark):
    line = "a line that is long enough to go where it stands twice"
    df = spark.createDataFrame([(1, line, 1, 2, 3, 4, 5), (2, line, 6, 7, 8, 9, 0)], "doc_id long, text string, dropped int, gone_id int, source int, `id` int, `a.b` int")
    got = {r["doc_id"]: r for r in lines.dedup_lines(df).collect()}
    assert got[2]["text"] == "" and got[2]["dropped"] == 6 and got[2]["gone_id"] == 7 and got[1]["a.b"] == 5 and got[1]["n_dropped"] == 0


def test_many_rows_of_one_id(spark):
    line = "the quick brown fox jumps over the lazy dog again"
    rows = [(7, f"{line} {i * i * 7919} and so on to the end of it") for i in range(300)] + [(8, f"{line} 7919 and so on to the end  of it")]
    got = lines.dedup_lines(texts(spark, rows))
    assert got.count() == 301 and got.where("doc_id = 8").first()["n_dropped"] == 1


def verified(monkeypatch):
    """Numbers of pairs that are compared, one for each call."""
    counts, compare = [], lines._verified

    def counted(docs, pairs, *columns):
        counts.append(pairs.count())
        return compare(docs, pairs, *columns)

    monkeypatch.setattr(lines, "_verified", counted)
    return counts


def test_crowded_lines_form_few_pairs(spark, monkeypatch):
    counts, rng = verified(monkeypatch), random.Random(9)
    head, tail = ("".join(rng.choice("abcdefgh ") for _ in range(50)) for _ in range(2))
    far = {i: head + "".join(rng.choice("klmnopqrst") for _ in range(14)) + tail for i in range(160)}
    assert [r["n_dropped"] for r in lines.dedup_lines(texts(spark, list(far.items()))).collect()] == [0] * 160
    near = {i: changed(rng, head + tail, 1, "klmnopqrst") for i in range(160)}
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(texts(spark, list(near.items()))).collect()}
    assert got == brute(near) and all(n < 1500 for n in counts)


def test_crowded_lines_match_brute_force(spark, monkeypatch):
    for name, value in (("CELL_LINES", 2), ("CELL_TEXTS", 1), ("PIVOT_LINES", 4)):
        monkeypatch.setattr(lines, name, value)
    counts, rng, docs = verified(monkeypatch), random.Random(10), {}
    for letters, length in (("ab", 31), ("abcdefé😀", 34), ("abc", 60)):
        base = "".join(rng.choice(letters) for _ in range(length))
        for _ in range(30):
            docs[len(docs)] = changed(rng, base, rng.randrange(7), letters)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(texts(spark, list(docs.items()))).collect()}
    want = brute(docs)
    assert got == want and 20 < sum(not t for t in want.values()) < 80 and sum(counts) < 200


def test_text_of_many_documents_is_not_met_by_a_broadcast(spark):
    line = "a line that stands in all of the documents"
    docs = spark.range(11_000).select(F.col("id").alias("doc_id"), F.lit(line).alias("text"))
    got = lines.dedup_lines(docs)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().sparkPlan().toString()
    assert got.where("n_dropped = 1").count() == 10_999
