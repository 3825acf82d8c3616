"""Line dedup across documents by a segment-partition edit join, with DataFrame operations only.

A line goes if its text stands earlier in the table, in the order of (document id, line number), or if
an earlier text of at least NEAR_CHARS characters lies within EDITS edits of it. Only the first
occurrence of each distinct line takes part in the join.

A line is cut into EDITS + 1 = 3 disjoint segments: two edits leave one of them untouched, so a line
within reach has that segment as a substring. Where it can stand follows from the lengths: the first
segment at the start, the last at the end (else an edit lies before or behind it and another segment is
untouched), the middle one at most one place off its own. Segment lengths depend on the length of the
line in steps of STEP, so most lines probe with five substrings. Substrings are compared as 64-bit
hashes. Of pairs that meet, those that share enough of eight finer pieces are verified by a banded
bit-parallel edit distance over code points.

A segment that more than CELL_LINES distinct lines share forms no pairs. Such lines meet by equal texts after
up to EDITS edits, tried only where a line leaves another one, as in a tree of errors (Cole, Gottlieb,
Lewenstein): in a cell of lines, one of them is the pivot, and a line that leaves it at some character goes on
without that character, with the pivot's in its place or before it, and with a wildcard there. Two lines of a
cell leave each other where one of them leaves the pivot, so if they are within reach, some of these texts are
equal or leave the pivot by the same character at the same place; those are the cells of the next round. The
pivot is the middle of the sorted lines, so a cell has at most about half of the lines of the one before,
and a line has a number of texts that grows with the logarithm of the group. Equal texts prove the distance, and
the least place of each text is enough, so no pairs are formed there but in cells of up to CELL_TEXTS texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import components, table

EDITS = 2
#: Shorter lines stay; lines below NEAR_CHARS go only if they are equal.
MIN_CHARS, NEAR_CHARS = 10, 30
STEP = 16
CELL_LINES, CELL_TEXTS = 50, 8
#: Lines of a cell, about, whose middle is the pivot.
PIVOT_LINES = 64
#: Stands for any character; lines have no line feeds.
WILD = "\n"
PIECES = 8
#: Rows of fixed width, rows that hold an array of line numbers, and characters, of a side that is broadcast (up to some 10 MB);
#: beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_LISTS, BROADCAST_CHARS = 300_000, 10_000, 4_000_000


def _small(df: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    return F.broadcast(df) if rows <= (BROADCAST_ROWS if most is None else most) else df


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of the same names; null ids are equal to each other."""
    named = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) if k == "id" else F.col(k) == F.col(f"_{k}") for k in keys]
    return left.join(named, same, how).drop(*[f"_{k}" for k in keys])


def _line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, line, chars, h1, h2): the lines that may go; the two hashes stand for the line."""
    rows = docs.select(docs[id_col].alias("id"), F.posexplode(F.split(docs[text_col], "\n", -1)).alias("pos", "line"))
    return rows.withColumn("chars", F.length("line")).where(F.col("chars") >= MIN_CHARS).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _places(chars: Column) -> list[tuple]:
    """(part, bucket, start, length) of the three segments of a line of so many characters, of the middle
    substrings one place off, and of all five as the next lower step cuts them (SEGMENTS: the first three).

    The lower step matters to a line of up to EDITS characters more than its own step begins with.
    """
    found = []
    bucket = chars - chars % STEP
    for size in (bucket, bucket - STEP):
        third = (size / 3).cast("int")
        found += [(1, size, F.lit(1), third), (3, size, chars - third + 1, third), (2, size, third + 1, third), (2, size, third, third), (2, size, third + 2, third)]
    return found


SEGMENTS = 3


def _keys(line: Column, chars: Column) -> Column:
    """Hashes of the substrings at _places; null where the lower step does not apply."""
    hashes = [F.xxhash64(F.lit(part), size, F.substring(line, start, length)) for part, size, start, length in _places(chars)]
    lower = (chars % STEP < EDITS) & (chars >= 2 * STEP)
    return F.array(*hashes[:5], *[F.when(lower, h) for h in hashes[5:]])


def _keyed(lines: DataFrame) -> DataFrame:
    """Rows (id, pos, chars, number, key) of lines with an array of keys; number is the place in the array."""
    return lines.select("id", "pos", "chars", F.posexplode("keys").alias("number", "key")).where("key is not null")


def _pairs(rows: DataFrame) -> DataFrame:
    """Candidates (earlier, later) among rows (id, pos, chars, number, key) that share a key, a segment of either."""
    x, y = rows.where(F.col("number") < SEGMENTS).alias("x"), rows.alias("y")
    near = (F.col("y.chars") - F.col("x.chars")).between(0, EDITS)
    a, b = F.struct("x.id", "x.pos"), F.struct("y.id", "y.pos")
    return x.join(y, (F.col("x.key") == F.col("y.key")) & near & (a != b)).select(F.least(a, b).alias("earlier"), F.greatest(a, b).alias("later")).distinct()


def let(value: Column, body) -> Column:
    """A name for a value that is used several times: the only element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def within_edits(left: Column, right: Column, k: int = EDITS) -> Column:
    """True if two strings are within k edits: a band of 2k + 1 diagonals, one bit each, in a 64-bit word."""
    m, n = F.length(left), F.length(right)
    mask = (1 << (2 * k + 1)) - 1

    def long(x):
        return F.lit(x).cast("long")

    def match(p, t, j):
        char = F.get(t, j - 1)
        bits = [F.when(F.get(p, j - k + b - 1) == char, long(1 << b)).otherwise(long(0)) for b in range(2 * k + 1)]
        found = bits[0]
        for bit in bits[1:]:
            found = found.bitwiseOR(bit)
        return found

    def with_match(both, s, j):
        return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["cost"].alias("cost"), match(both["p"], both["t"], j).alias("x"))

    def with_diagonal(s):
        vp, x = s["vp"], s["x"]
        d = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(s["vn"]).bitwiseAND(long(mask))
        return F.struct(vp.alias("vp"), s["vn"].alias("vn"), s["cost"].alias("cost"), d.alias("d"))

    def moved(s):
        vp, vn, d = s["vp"], s["vn"], s["d"]
        up = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp))).bitwiseAND(long(mask))
        down, shifted = d.bitwiseAND(vp), F.shiftright(d, 1)
        return F.struct(
            down.bitwiseOR(F.bitwise_not(shifted.bitwiseOR(up))).bitwiseAND(long(mask)).alias("vp"), shifted.bitwiseAND(up).alias("vn"),
            (s["cost"] + 1 - F.shiftright(d, 2 * k)).cast("long").alias("cost"),
        )

    def step(both):
        # The cost of the lowest diagonal never falls, and the end of the strings is at most 2k rows above it.
        return lambda s, j: F.when(s["cost"] > 3 * k, s).otherwise(let(let(with_match(both, s, j), with_diagonal), moved))

    start = F.struct(long(((1 << (k + 1)) - 1) << k).alias("vp"), long(0).alias("vn"), long(k).alias("cost"))
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def rest(s):
        # From the lowest diagonal of the band up to the one that ends both strings.
        beyond = F.lit(None).cast("long")
        for gap in range(-k, k + 1):
            beyond = F.when(m - n == gap, long(((1 << (2 * k)) - 1) & ~((1 << (gap + k)) - 1))).otherwise(beyond)
        return s["cost"] - F.bit_count(s["vp"].bitwiseAND(beyond)) + F.bit_count(s["vn"].bitwiseAND(beyond)) <= k

    p, t = (F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)) for s in (left, right))
    walked = let(F.struct(p.alias("p"), t.alias("t")), lambda both: F.aggregate(steps, start, step(both), rest))
    return F.when(F.abs(m - n) <= k, walked).otherwise(False)


def shares_pieces(left: Column, right: Column, k: int = EDITS) -> Column:
    """Whether all but k of PIECES equal pieces of a string stand in the other: k edits touch k pieces at most."""
    size = F.floor(F.length(left) / PIECES).cast("int")
    found = [F.contains(right, F.substring(left, F.lit(i) * size + 1, size)).cast("int") for i in range(PIECES)]
    return sum(found[1:], found[0]) >= PIECES - k


def near_lines(docs: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos) of the distinct lines that lie within reach of an earlier one. first: table of first occurrences."""
    keyed = _keyed(first.where("keys is not null"))
    sizes = table(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("number").alias("least")).where(f"n > 1 and least < {SEGMENTS}").select("key", "n"))
    rows = sizes.agg(F.count("*"), F.count(F.when(F.col("n") > CELL_LINES, 1))).first()
    met = table(keyed.join(_small(sizes, rows[0]), "key"))
    pairs = _pairs(met.where(F.col("n") <= CELL_LINES))
    if not rows[1]:
        return _verified(docs, table(pairs), id_col, text_col)
    near, more = _crowded(docs, met.where(F.col("n") > CELL_LINES), id_col, text_col)
    return _verified(docs, table(pairs.union(more).distinct()), id_col, text_col).union(near).distinct()


def _shared(a: Column, b: Column) -> Column:
    """Number of characters that two strings have in common at their start, by halving."""
    most = F.least(F.length(a), F.length(b))
    steps = F.sequence(F.floor(F.log2(most + 1)).cast("int"), F.lit(0), F.lit(-1))

    def step(at, k):
        size = F.pow(F.lit(2), k).cast("int")
        return F.when((at + size <= most) & (F.substring(a, at + 1, size) == F.substring(b, at + 1, size)), at + size).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _edited(w: Column, e: Column, s: Column, pivot: Column, at: Column) -> Column:
    """Texts after one edit more where a text leaves the pivot: an array of (w, e, s); wildcards are never edited."""
    char, want = F.substring(s, at + 1, F.lit(1)), F.substring(pivot, at + 1, F.lit(1))
    head, rest, tail = F.substring(s, F.lit(1), at), F.substring(s, at + 1, F.length(s)), F.substring(s, at + 2, F.length(s))
    here, there = (char != "") & (char != WILD), (want != "") & (char != WILD)

    def text(when, w, e, *parts):
        return F.when(when, F.struct(w.cast("int").alias("w"), e.cast("int").alias("e"), F.concat(*parts).alias("s")))

    found = F.array(text(here, w, e + 1, head, tail), text(there, w, e + 1, head, want, rest), text(here & there, w, e + 1, head, want, tail), text(here, w + 1, e, head, F.lit(WILD), tail))
    return F.filter(found, lambda x: x.isNotNull())


def _few(rows: DataFrame) -> DataFrame:
    """Candidates (earlier, later) among texts of small cells that have an edit left."""
    x, y = rows.alias("x"), rows.alias("y")
    spent, apart = F.col("x.w") + F.col("x.e") + F.col("y.e"), F.abs(F.length("x.s") - F.length("y.s"))
    a, b = F.struct("x.id", "x.pos"), F.struct("y.id", "y.pos")
    met = x.join(y, (F.col("x.cell") == F.col("y.cell")) & (a < b) & (spent + F.greatest(apart, F.lit(1)) <= EDITS))
    return met.select(a.alias("earlier"), b.alias("later")).distinct()


def _equal(seen: DataFrame) -> DataFrame:
    """(id, pos) of texts (id, pos, w, e, h1, h2) that an earlier line has too, within EDITS edits of both."""
    place, spent = F.struct("id", "pos"), F.col("w") + F.col("e")
    least = [F.min(F.when(F.col("e") <= k, place)).alias(f"least{k}") for k in range(EDITS + 1)]
    texts = table(seen.groupBy("h1", "h2").agg(*least, F.max(place).alias("last")).where(f"least{EDITS} < last").drop("last"))
    met = _joined(seen, _small(texts, texts.count(), BROADCAST_ROWS // 4), ["h1", "h2"])
    # A text leaves its partner the edits that it has not spent itself.
    first = F.lit(None).cast(texts.schema[f"least{EDITS}"].dataType)
    for k in range(EDITS + 1):
        first = F.when(spent == EDITS - k, F.col(f"least{k}")).otherwise(first)
    return table(met.where(first < place).select("id", "pos").distinct())


def _crowded(docs: DataFrame, hot: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, pos) of lines with an earlier one in reach, and candidates (earlier, later), among rows (id, pos, key) of crowded keys.

    A text (w, e, s) of a line has w wildcards and e edits of its own: two lines that share s are within w and both e.
    """
    tied = table(hot.groupBy("id", "pos").agg(F.min("key").alias("least"), F.collect_set("key").alias("keys")))
    # Keys that one line has are one cell, so that a line is in one cell only.
    roots = table(components(tied.select(F.col("least").alias("a"), F.explode("keys").alias("b")).distinct()))
    cells = tied.join(_small(roots, roots.count()), F.col("least") == F.col("node"), "left").select("id", "pos", F.coalesce("root", "least").alias("cell"))
    lines = _joined(_fetch(docs, tied.select("id", "pos"), id_col, text_col), cells, ["id", "pos"]).where(F.length("line") >= NEAR_CHARS)
    live = table(lines.select("cell", "id", "pos", F.lit(0).alias("w"), F.lit(0).alias("e"), F.col("line").alias("s")))

    place, w, e, s, pivot, at = F.struct("id", "pos"), *(F.col(c) for c in ("w", "e", "s", "pivot", "at"))
    hashed = ["id", "pos", "w", "e", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(1), "s").alias("h2")]
    columns = ["cell", "id", "pos", "w", "e", "s", "pivot"]
    seen, found = live.select(*hashed), []
    while True:
        # Texts that both have an edit of their own, or two wildcards, have none left: those need only be equal.
        sizes = live.groupBy("cell").agg(F.count("*").alias("n"), F.count(F.when(e == 0, 1)).alias("whole"), F.min(place).alias("a"), F.max(place).alias("b"))
        sizes = table(sizes.where("a < b and whole > 0").select("cell", "n", "whole"))
        rows = sizes.agg(F.count("*"), F.count(F.when(F.col("n") > CELL_TEXTS, 1))).first()
        met = table(live.join(_small(sizes, rows[0]), "cell"))
        found.append(_few(met.where(F.col("n") <= CELL_TEXTS)))
        if not rows[1]:
            break
        crowd = met.where(F.col("n") > CELL_TEXTS)
        drawn = F.xxhash64("s", "id", "pos")
        middle = F.sort_array(F.collect_list(F.when(F.pmod(drawn, F.col("whole")) < PIVOT_LINES, s)))
        pivots = crowd.where("e = 0").groupBy("cell").agg(middle.alias("some"), F.min_by("s", drawn).alias("one"))
        pivots = table(pivots.select("cell", F.coalesce(F.get("some", F.floor(F.size("some") / 2).cast("int")), "one").alias("pivot")))
        chars = pivots.agg(F.sum(F.length("pivot").cast("long"))).first()[0]
        led = table(crowd.join(_small(pivots, chars, BROADCAST_CHARS), "cell").select(*columns).withColumn("at", _shared(s, pivot)))
        once = led.where("w + e = 0").select("cell", "id", "pos", "pivot", F.inline(_edited(w, e, s, pivot, at))).select(*columns)
        once = table(once.withColumn("at", _shared(s, pivot)))
        led = led.union(once)
        twice = led.where("w + e = 1").select("id", "pos", F.inline(_edited(w, e, s, pivot, at)))
        seen = seen.union(table(once.select(*hashed).union(twice.select(*hashed))))
        char = F.substring(s, at + 1, F.lit(1))
        live = table(led.where(char != "").select(F.xxhash64("cell", "at", char).alias("cell"), "id", "pos", "w", "e", "s"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return _equal(seen), pairs


def _fetch(docs: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, line) of places (id, pos) of documents. Places that one id has many of, as repeated ids have, are
    never gathered: the lines of such documents are taken apart and meet their places one by one."""
    wanted = table(places.groupBy("id", F.floor(F.col("pos") / 4096).alias("part")).agg(F.collect_set("pos").alias("wanted")))
    ids = wanted.select("id").distinct()
    held = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    held = _joined(held, _small(ids, ids.count()), ["id"], "left_semi")
    met = _joined(held, _small(wanted, wanted.count(), BROADCAST_LISTS), ["id"])
    # A text is split once, not once per place.
    found = let(F.split("text", "\n", -1), lambda lines: F.transform("wanted", lambda at: F.struct(at.alias("pos"), F.get(lines, at).alias("line"))))
    return met.select("id", F.explode(found).alias("x")).select("id", "x.pos", "x.line").where("line is not null").distinct()


def _verified(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    places = pairs.select(F.explode(F.array("earlier", "later")).alias("x")).select("x.*").distinct()
    lines = table(_fetch(docs, places, id_col, text_col)).select(F.struct("id", "pos").alias("place"), "line")
    met = pairs.join(lines.select(F.col("place").alias("earlier"), F.col("line").alias("a")), "earlier")
    met = met.join(lines.select(F.col("place").alias("later"), F.col("line").alias("b")), "later")
    # Few rows with much work each: spread them whatever their bytes.
    met = met.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "earlier", "later")
    met = met.where(shares_pieces(F.col("a"), F.col("b")))
    return met.where(within_edits(F.col("a"), F.col("b"))).select("later.*").distinct()


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, dropped array<int>): the line numbers, from 0, that go from each document that loses any."""
    rows = _line_rows(docs, id_col, text_col)
    keys = F.when(F.col("chars") >= NEAR_CHARS, _keys(F.col("line"), F.col("chars")))
    held = rows.select("h1", "h2", F.struct("id", "pos", "chars", keys.alias("keys")).alias("x"))
    first = table(held.groupBy("h1", "h2").agg(F.min("x").alias("x"), F.count("*").alias("n")).select("h1", "h2", "n", "x.*"))
    near = table(near_lines(docs, first, id_col, text_col))
    near_rows = near.count()
    flagged = _joined(first, _small(near.withColumn("near", F.lit(True)), near_rows), ["id", "pos"], "left").where("n > 1 or near")
    gone = table(flagged.select("h1", "h2", F.col("id").alias("first_id"), F.col("pos").alias("first_pos"), F.coalesce("near", F.lit(False)).alias("near")))
    met = rows.select("id", "pos", "h1", "h2").join(_small(gone, gone.count()), ["h1", "h2"])
    # Null ids are equal to each other here: such rows count as one document.
    later = ~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("pos") == F.col("first_pos")))
    return met.where(F.col("near") | later).groupBy("id").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the remaining lines as text, and the columns n_lines and n_dropped.

    Lines end at line feeds. Lines under MIN_CHARS characters, blank ones among them, always stay. Null
    texts stay null with no lines. Documents of one id count as one document with the same lines
    dropped; a line that is repeated within a document goes too. Existing columns n_lines and n_dropped
    are replaced.
    """
    source = docs.drop("n_lines", "n_dropped")
    # Names that no column of the documents has.
    gone_id, dropped = (_free(source.columns, name) for name in ("gone_id", "dropped"))
    gone = table(dropped_lines(docs, id_col, text_col).select(F.col("id").alias(gone_id), F.col("dropped").alias(dropped)))
    # Sort-merge beyond that, whatever Spark takes the files for: else the texts move or not by how well a few numbers compress.
    rows = gone.count()
    side = _small(gone, rows, BROADCAST_LISTS) if rows <= BROADCAST_LISTS else gone.hint("merge")
    met = source.join(side, source[id_col].eqNullSafe(gone[gone_id]), "left")
    lines = F.split(source[text_col], "\n", -1)
    kept = let(lines, lambda held: F.transform(F.array_except(F.sequence(F.lit(0), F.size(held) - 1), F.col(dropped)), lambda at: F.get(held, at)))
    text = F.when(F.col(dropped).isNull(), source[text_col]).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(source[text_col].isNull(), 0).otherwise(F.size(lines))
    n_dropped = F.when(F.col(dropped).isNull(), 0).otherwise(F.size(dropped))
    columns = [(text if c == text_col else source[f"`{c}`"]).alias(c) for c in source.columns]
    return met.select(*columns, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def _free(taken: list[str], name: str) -> str:
    held = {c.lower() for c in taken}
    while name in held:
        name += "_"
    return name
