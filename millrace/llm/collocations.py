"""Phrase collocations, counted with broadcast double-array tries.

Texts become words once: numpy finds their ends by a table of byte classes, Arrow numbers the distinct ones, and
a table keeps one row per block of texts, with its words as numbers. All further passes read that table.

Level by level, as Apriori does, a phrase of k words stays a candidate only if its parts of k - 1 words are
frequent. What is frequent is bounded from above first: words, then phrases of two frequent words, and so on,
are counted by a 64-bit hash, so that phrases which collide only seem more frequent. The hashes that reach the
least count are kept as a bitmap of fixed size, by which the next level is filtered; false hits only add
candidates. Every frequent hash remembers one block that holds it, and that block spells the phrase out.

The candidates are dealt out to shards of about TRIE_PHRASES phrases, and a task builds one double-array trie
per shard, over languages and words written in two digits. Each trie is broadcast in turn. A task starts a state
at every word of a block and advances all of them at once, digit by digit; states without a child drop out. The
states that accept a candidate are counted by bincount, and the counts of the tasks are summed. These counts are
exact. Where a hash was seen more often than its phrase, others share it: they are spelled out by all blocks and counted too.

This reads all blocks as often as there are tries, and their number grows with the blocks. Beyond UNIT_PLACES places
one pass deals out what stands in the blocks instead: the shard of a phrase and of a place follow from the same hash, so that a
place meets one trie for each number of words. Places with the same words are sent once, with their number, and a
state is advanced for each of them in the same way.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import arrow_rows, blocks, table

WORDS = 3
#: Phrases of a trie, of which a task holds one; more phrases make more tries.
TRIE_PHRASES = 400_000
#: Distinct phrases that a task holds before it deals them out; places of which one copy of a trie gets the phrases. Up
#: to so many places the tries are broadcast in turn.
DEALT, UNIT_PLACES = 1_000_000, 20_000_000
#: A bitmap of hashes that is sent to the tasks has 2**BITMAP[0] to 2**BITMAP[1] bits (at most 16 MB), of these some
#: BITS_A_HASH per hash; beyond that more false hits add candidates.
BITMAP, BITS_A_HASH = (18, 27), 16
#: Distinct hashes that a task holds before it passes them on; bytes of the texts of a block; blocks of an Arrow batch.
HELD, BLOCK_BYTES, BATCH_BLOCKS = 200_000, 2 << 20, 2
DIGIT = 12
#: Families of at least so many children are placed one by one.
LARGE = 64

_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of some texts: `names` holds the distinct ones, `code` one number per word, `joined` whether
    the next word follows in the same piece, `text` the number of the text."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        # A line feed after every text, so that no word goes on in the next one.
        chars = np.full(len(data) + len(texts), 10, np.uint8)
        at = np.arange(len(data), dtype=np.int32)
        at += np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends))
        chars[at] = _LOWER[data]
        del at
        kind = _CLASS[chars]
        inside = kind == 0
        edges = np.diff(inside.view(np.int8), prepend=0)
        starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(stops - starts, out=offsets[1:])
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(chars[inside]))
        coded = words.dictionary_encode()
        self.names, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        self.joined = np.zeros(len(starts), bool)
        self.joined[:-1] = piece[1:] == piece[:-1]
        self.text = np.searchsorted(ends[:-1] - ends[0] + np.arange(len(texts)), starts, side="right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix (the splitmix64 finaliser), so that sums of hashes spread."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stored(values: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("x", values.type)])) as out:
        out.write_batch(pa.record_batch([values], names=["x"]))
    return sink.getvalue().to_pybytes()


def _read(stored) -> pa.Array:
    return pa.ipc.open_stream(stored).read_all().column("x").combine_chunks()


BLOCK = "block long, names binary, hashes binary, code binary, joined binary, langs binary, lang binary, words binary"


def encoded(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """One row per block of texts: `names` its distinct words and their `hashes`; per word a `code` and a bit
    `joined`; `langs` its languages and, per text, the number of its language in `lang` and its `words`."""

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        for number, part in enumerate(blocks(batches, 0, BLOCK_BYTES)):
            words, langs = Words(part.column(0)), part.column(1).fill_null("und").dictionary_encode()
            hashes = np.array([xxhash.xxh64_intdigest(x) for x in words.names.cast(pa.large_binary()).to_pylist()], np.uint64)
            values = [_stored(words.names), hashes.tobytes(), words.code.astype(np.int32).tobytes(), np.packbits(words.joined).tobytes(), _stored(langs.dictionary)]
            values += [langs.indices.to_numpy(zero_copy_only=False).astype(np.int32).tobytes(), np.bincount(words.text, minlength=part.num_rows).astype(np.int32).tobytes()]
            yield pa.record_batch([pa.array([first + number]), *[pa.array([v], pa.binary()) for v in values]], names=[c.split()[0] for c in BLOCK.split(", ")])

    texts = docs.select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    # Small row groups and batches: a task holds few texts and, in a later pass, few blocks at once.
    with arrow_rows(docs.sparkSession, 1000):
        return table(texts.mapInArrow(run, BLOCK), **{"parquet.block.size": str(8 << 20)})


class Block:
    """A block as read back, without the columns that were not read; `lang` is the number of the language of every word."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        def buffer(name):
            return batch.column(name)[row].as_buffer()

        self.number = batch.column("block")[row].as_py()
        self.langs, self.code = _read(buffer("langs")), np.frombuffer(buffer("code"), np.int32)
        self.names = _read(buffer("names")) if "names" in batch.schema.names else None
        self.hashes = np.frombuffer(buffer("hashes"), np.uint64) if "hashes" in batch.schema.names else None
        self.joined = np.unpackbits(np.frombuffer(buffer("joined"), np.uint8), count=len(self.code)).view(bool)
        self.lang = np.repeat(np.frombuffer(buffer("lang"), np.int32), np.frombuffer(buffer("words"), np.int32))


def read_blocks(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            yield Block(batch, row)


def levels(block: Block, bitmaps: list[np.ndarray], mask: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every level the places in a block where a phrase of so many words may be frequent, and its hash. All
    levels that have a bitmap are filtered by it; one more follows, of which only the parts are known."""
    keep = np.uint64(mask)
    of_word = block.hashes[block.code]
    of_lang = np.array([xxhash.xxh64_intdigest(x, 1) for x in block.langs.to_pylist()], np.uint64)
    found = [(np.arange(len(of_word)), mixed(of_lang[block.lang] + of_word) & keep)]
    for bitmap in bitmaps:
        at, h = found[-1]
        fit = frequent(bitmap, h)
        found[-1] = at, h = at[fit], h[fit]
        if len(found) == WORDS:
            break
        # Both parts of one word less must be frequent: the one that starts here and the one at the next word.
        begins = np.zeros(len(of_word) + 1, bool)
        begins[at] = True
        fit = block.joined[at + len(found) - 1] & begins[at + 1]
        at, h = at[fit], h[fit]
        found.append((at, mixed(h * np.uint64(0x9E3779B97F4A7C15) + of_word[at + len(found)]) & keep))
    return found


def frequent(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def at_block(h: np.ndarray, block) -> np.ndarray:
    """One hash for a phrase's hash in a block."""
    return mixed(h ^ mixed(np.asarray(block, np.int64).view(np.uint64) + np.uint64(1)))


class Tally:
    """Counts of hashes, each with the first block, and a bound on the distinct ones that are held."""

    def __init__(self, most: int):
        self.parts, self.size, self.most = [], 0, most

    def add(self, hashes: np.ndarray, block: int):
        """Counts to pass on, if there are too many."""
        h, n = np.unique(hashes, return_counts=True)
        self.parts.append((h, n, np.full(len(h), block)))
        self.size += len(h)
        if self.size > self.most:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])
            if self.size > self.most // 2:
                return self.flush()
        return None

    def merged(self):
        h, n, block = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        names, first, at = np.unique(h, return_index=True, return_inverse=True)
        return names, np.bincount(at, weights=n).astype(np.int64), block[first]

    def flush(self):
        out = self.merged() if self.parts else None
        self.parts, self.size = [], 0
        return out


def _hash_counts(held: DataFrame, bitmaps: list, least: int, mask: int) -> DataFrame:
    """(size, h, n, block) of the hashed phrases of len(bitmaps) + 1 words that reach the least count, collisions included."""
    sent, most, size = held.sparkSession.sparkContext.broadcast(bitmaps), HELD, len(bitmaps) + 1

    def batch(counts):
        h, n, block = counts
        return pa.record_batch({"h": pa.array(h.view(np.int64)), "n": pa.array(n.astype(np.int64)), "block": pa.array(block)})

    def run(batches):
        tally = Tally(most)
        for block in read_blocks(batches):
            over = tally.add(levels(block, sent.value, mask)[-1][1], block.number)
            if over is not None:
                yield batch(over)
        rest = tally.flush()
        if rest is not None:
            yield batch(rest)

    counts = held.drop("names").mapInArrow(run, "h long, n long, block long").groupBy("h").agg(F.sum("n").alias("n"), F.min("block").alias("block"))
    with arrow_rows(held.sparkSession, BATCH_BLOCKS):
        found = table(counts.where(F.col("n") >= least).select(F.lit(size).alias("size"), "h", "n", "block"))
    sent.destroy()
    return found


def _bitmap(hashes: DataFrame, count: int) -> np.ndarray:
    """The lowest bits of `count` hashes h as a bitmap, collected in parts of 4 KB; its size has a bound whatever the count."""
    bits = min(BITMAP[1], max(BITMAP[0], (count * BITS_A_HASH).bit_length()))
    place = F.col("h").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    parts = hashes.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts.toLocalIterator():
        out[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _spelled(held: DataFrame, bitmaps: list, wanted: DataFrame, mask: int, everywhere: bool) -> DataFrame:
    """(size, h, lang, phrase) of the wanted hashes (size, h, block), from their blocks or from all."""

    def where(batches):
        for b in batches:
            h = b.column("h").to_numpy().view(np.uint64)
            yield pa.record_batch([pa.array(at_block(h, 0 if everywhere else b.column("block").to_numpy()).view(np.int64))], names=["h"])

    sent = held.sparkSession.sparkContext.broadcast([*bitmaps, _bitmap(wanted.mapInArrow(where, "h long"), wanted.count())])

    def run(batches):
        *known, asked = sent.value
        for block in read_blocks(batches):
            for size, (at, h) in enumerate(levels(block, known, mask), 1):
                # Of every phrase one place; where hashes meet, phrases of several spellings.
                fit = frequent(asked, at_block(h, 0 if everywhere else block.number))
                at, h = at[fit], h[fit]
                if not everywhere:
                    h, first = np.unique(h, return_index=True)
                    at = at[first]
                names = [block.names.take(pa.array(block.code[at + k])) for k in range(size)]
                phrase = pc.binary_join_element_wise(*names, pa.scalar(" ", names[0].type)) if size > 1 else names[0]
                lang = block.langs.take(pa.array(block.lang[at]))
                yield pa.record_batch({"size": pa.array(np.full(len(at), size, np.int32)), "h": pa.array(h.view(np.int64)), "block": pa.array(np.full(len(at), block.number)), "lang": lang.cast(pa.string()), "phrase": phrase.cast(pa.string())})

    found, keys = held.mapInArrow(run, "size int, h long, block long, lang string, phrase string"), ["size", "h", "block"]
    if everywhere:
        found, keys = found.drop("block").distinct(), ["size", "h"]
    # The bitmap may let more through; the hashes themselves do not. A block has one phrase of a hash.
    with arrow_rows(held.sparkSession, BATCH_BLOCKS):
        phrases = table(found.join(wanted.select(*keys), keys, "left_semi").select("size", "h", "lang", "phrase"))
    sent.destroy()
    return phrases


def double_array(symbols: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, state of every row) of the trie of rows of symbols, of which the first `depth` count.

    The child of state s by symbol x is base[s] + x, if check[base[s] + x] is s; the root is state 0. Families
    of children are placed by falling size at drawn bases: large ones one by one, the others all at once,
    those that meet an occupied place again.
    """
    span = 1 << DIGIT
    node = np.zeros(len(symbols), np.int64)
    parents, letters, total = [], [], 1
    for level in range(symbols.shape[1]):
        rows = np.flatnonzero(depth > level)
        names, at = np.unique(node[rows] * span + symbols[rows, level], return_inverse=True)
        node[rows] = total + at
        parents.append(names // span)
        letters.append(names % span)
        total += len(names)
    parent, letter = np.concatenate(parents), np.concatenate(letters)
    count = np.bincount(parent, minlength=total)
    start = np.concatenate(([0], np.cumsum(count)))
    rng = np.random.default_rng(1)
    base, taken = np.zeros(total, np.int64), np.zeros(3 * len(parent) // 2 + 2 * span, bool)
    taken[0], end = True, 1
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    large = int(np.searchsorted(-count[order], -LARGE, side="right"))
    for p in order[:large]:
        own = letter[start[p] : start[p + 1]]
        for _ in range(8):
            tries = rng.integers(1, end + 1, 32)
            free = np.flatnonzero(~taken[tries[:, None] + own].any(axis=1))
            if len(free):
                base[p] = tries[free[0]]
                break
        else:
            base[p] = end
        end = max(end, base[p] + own[-1] + 1)
        if base[p] + 2 * span > len(taken):
            taken = np.concatenate((taken, np.zeros(len(taken) // 2 + 2 * span, bool)))
        taken[base[p] + own] = True
    left, rounds = order[large:], 0
    claim = np.empty(len(taken), np.int64)
    while len(left):
        # The largest of those that are left first, while there is room.
        some = left[: max(1000, len(left) // 4)]
        tries = rng.integers(1, len(taken) - span, len(some))
        size = count[some]
        owner = np.repeat(np.arange(len(some)), size)
        edge = np.arange(len(owner)) + np.repeat(start[some] - np.cumsum(size) + size, size)
        slots = tries[owner] + letter[edge]
        claim[slots] = owner
        bad = taken[slots] | (claim[slots] != owner)
        fits = np.bincount(owner, weights=bad, minlength=len(some)) == 0
        base[some[fits]] = tries[fits]
        taken[slots[fits[owner]]] = True
        left = np.concatenate((some[~fits], left[len(some) :]))
        rounds += 1
        if rounds % 200 == 0:
            taken = np.concatenate((taken, np.zeros(len(taken) // 2, bool)))
            claim = np.empty(len(taken), np.int64)
    # From numbers of nodes to places in the arrays.
    place = np.zeros(total, np.int64)
    place[1:] = base[parent] + letter
    check = np.full(len(taken) + span, -1, np.int32)
    check[place[1:]] = place[parent]
    bases = np.zeros(len(check), np.int32)
    bases[place] = base
    return bases, check, place[node]


def _digits(numbers: np.ndarray) -> np.ndarray:
    """Two digits of each number, the higher one first."""
    if len(numbers) and numbers.max() >= 1 << (2 * DIGIT):
        raise OverflowError("too many distinct words for one trie; lower TRIE_PHRASES")
    return np.stack((numbers >> DIGIT, numbers & ((1 << DIGIT) - 1)), axis=1)


#: A phrase has lang, phrase, size, hash and number; the row of the trie itself has the others.
BUILT = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("h", pa.int64()), ("number", pa.int32()), *[(n, pa.binary()) for n in ("words", "langs", "base", "check", "accepts")]])
BUILT_DDL = "shard int, lang string, phrase string, size int, h long, number int, words binary, langs binary, base binary, check binary, accepts binary"


def build(part: pa.Table) -> pa.Table:
    """The phrases of a shard with their numbers, and one more row that holds the trie."""
    lang, phrase, n = part.column("lang").combine_chunks(), part.column("phrase").combine_chunks(), part.num_rows
    langs, pieces = pc.unique(lang), pc.split_pattern(phrase, " ")
    size = pc.list_value_length(pieces).to_numpy()
    coded = pieces.flatten().dictionary_encode()
    symbols = np.zeros((n, 2 * (WORDS + 1)), np.int64)
    symbols[:, :2] = _digits(pc.index_in(lang, value_set=langs).to_numpy())
    row = np.repeat(np.arange(n), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    digits = _digits(coded.indices.to_numpy().astype(np.int64))
    symbols[row, 2 + 2 * place], symbols[row, 3 + 2 * place] = digits[:, 0], digits[:, 1]
    base, check, state = double_array(symbols, 2 * (size + 1))
    accepts = np.full(len(base), -1, np.int32)
    accepts[state] = np.arange(n)
    phrases = {"shard": part.column("shard"), "lang": lang, "phrase": phrase, "size": part.column("size"), "h": part.column("h"), "number": pa.array(np.arange(n, dtype=np.int32))}
    trie = {"shard": part.column("shard")[:1], "words": pa.array([_stored(coded.dictionary)]), "langs": pa.array([_stored(langs)]), **{k: pa.array([zlib.compress(v.tobytes(), 1)]) for k, v in (("base", base), ("check", check), ("accepts", accepts))}}
    return pa.concat_tables([pa.table({f.name: held.get(f.name, pa.nulls(rows, f.type)) for f in BUILT}, schema=BUILT) for held, rows in ((phrases, n), (trie, 1))])


class Trie:
    """A stored trie; the arrays are unpacked where it is used."""

    def __init__(self, words: bytes, langs: bytes, base: bytes, check: bytes, accepts: bytes):
        self.stored = words, langs, base, check, accepts

    def __getstate__(self):
        return self.stored

    def __setstate__(self, stored):
        self.stored = stored

    def __getattr__(self, name):
        if name not in ("words", "langs", "base", "check", "accepts", "phrases"):
            raise AttributeError(name)
        words, langs, *arrays = self.stored
        self.words, self.langs = _read(words), _read(langs)
        self.base, self.check, self.accepts = (np.frombuffer(zlib.decompress(x), np.int32) for x in arrays)
        self.phrases = int(self.accepts.max()) + 1
        return self.__dict__[name]

    def advance(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the states that have a child for their symbol (-1: none, else two digits), and the children."""
        at = np.flatnonzero(symbols >= 0)
        now = states[at]
        for shift in (DIGIT, 0):
            child = self.base[now] + ((symbols[at] >> shift) & ((1 << DIGIT) - 1))
            fit = self.check[child] == now
            at, now = at[fit], child[fit]
        return at, now

    def known(self, block) -> tuple[np.ndarray, np.ndarray]:
        """The state of every language of a block and the symbol of every one of its distinct words, -1 for none."""

        def codes(names, known):
            return pc.fill_null(pc.index_in(names.cast(known.type), value_set=known), -1).to_numpy()

        of_lang = codes(block.langs, self.langs)
        with_root, roots = self.advance(np.zeros(len(of_lang), np.int32), of_lang)
        root = np.full(len(of_lang), -1, np.int32)
        root[with_root] = roots
        return root, codes(block.names, self.words)

    def counts(self, block) -> np.ndarray:
        """How often each phrase stands in a block."""
        root, symbols = self.known(block)
        symbols = symbols[block.code]
        at = np.flatnonzero(symbols >= 0)
        states = root[block.lang[at]]
        at, states = at[states >= 0], states[states >= 0]
        out = np.zeros(self.phrases, np.int64)
        for level in range(WORDS):
            fit, states = self.advance(states, symbols[at + level])
            at, accepted = at[fit], self.accepts[states]
            out += np.bincount(accepted[accepted >= 0], minlength=self.phrases)
            on = block.joined[at + level]
            at, states = at[on], states[on]
        return out

    def sums(self, piece: Piece) -> np.ndarray:
        """How often each phrase stands at the places of a piece."""
        root, symbols = self.known(piece)
        states = root[piece.lang]
        at = np.flatnonzero(states >= 0)
        states = states[at]
        out = np.zeros(self.phrases, np.int64)
        for level in range(WORDS):
            fit, states = self.advance(states, symbols[piece.words[level, at]])
            at = at[fit]
            whole = piece.size[at] == level + 1
            accepted, n = self.accepts[states[whole]], piece.n[at[whole]]
            out += np.bincount(accepted[accepted >= 0], weights=n[accepted >= 0], minlength=self.phrases).astype(np.int64)
            at, states = at[~whole], states[~whole]
        return out


class Piece:
    """Phrases of some blocks as they are dealt out: per phrase the number `lang` of its language in `langs`, `words` (-1 for
    none after the last one), numbers in `names`, and `n`, the places it stands at."""

    def __init__(self, names: bytes, langs: bytes, rows: bytes):
        # No word holds a line feed.
        self.names, self.langs = pc.split_pattern(pa.array([zlib.decompress(names)], pa.large_binary()), "\n").flatten(), _read(langs)
        self.lang, *words, self.n = np.frombuffer(zlib.decompress(rows), np.int32).reshape(WORDS + 2, -1)
        self.words = np.array(words)
        self.size = (self.words >= 0).sum(axis=0)


def distinct(h: np.ndarray, rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal columns of `rows` with the same hash as one, with the sum of their `n`. Where others share the hash, some may stay apart."""
    order = np.argsort(h)
    h, rows = h[order], np.take(rows, order, axis=1)
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    for row in rows:
        new[1:] |= row[1:] != row[:-1]
    starts = np.flatnonzero(new)
    return h[starts], np.take(rows, starts, axis=1), np.add.reduceat(n[order], starts, dtype=np.int32) if len(starts) else n


class Dealer:
    """Phrases of the blocks of a task, counted until they are dealt out."""

    def __init__(self, most: int):
        self.parts, self.size, self.places, self.most = [], 0, 0, most

    def full(self) -> bool:
        # Numbers of places are sent in 32 bits; a block has fewer than 2**30.
        return self.size > self.most or self.places >= 1 << 30

    def add(self, block: Block, found: list[tuple[np.ndarray, np.ndarray]]):
        """The places and hashes of levels()."""
        at, h = (np.concatenate(x) for x in zip(*found, strict=True))
        rows = np.full((WORDS + 1, len(at)), -1, np.int32)
        rows[0] = block.lang[at]
        start = 0
        for size, (some, _) in enumerate(found, 1):
            for k in range(size):
                rows[k + 1, start : start + len(some)] = block.code[some + k]
            start += len(some)
        self.parts.append((block.names, block.langs, *distinct(h, rows, np.ones(len(at), np.int32))))
        self.size += len(self.parts[-1][2])
        self.places += len(at)

    def deal(self, shards: int):
        """(shard, names, langs, rows) for Piece."""
        if not self.size:
            return
        # One numbering of the words and languages of all blocks.
        names, langs = (pa.concat_arrays([p[i] for p in self.parts]).dictionary_encode() for i in (0, 1))
        new_name, new_lang = names.indices.to_numpy(), langs.indices.to_numpy()
        at_name = at_lang = 0
        for held, spoken, _, rows, _ in self.parts:
            rows[0] = new_lang[rows[0] + at_lang]
            rows[1:] = np.where(rows[1:] < 0, -1, new_name[rows[1:] + at_name])
            at_name, at_lang = at_name + len(held), at_lang + len(spoken)
        h, rows, n = distinct(np.concatenate([p[2] for p in self.parts]), np.concatenate([p[3] for p in self.parts], axis=1), np.concatenate([p[4] for p in self.parts]))
        self.parts, self.size, self.places = [], 0, 0
        shard = h.view(np.int64) % shards
        # Words in order compress.
        order = np.argsort(shard * len(names.dictionary) + rows[1])
        table, spoken = np.take(np.concatenate((rows, n[None])), order, axis=1), _stored(langs.dictionary)
        ends = np.searchsorted(shard[order], np.arange(shards + 1))
        number = np.full(len(names.dictionary) + 1, -1, np.int32)
        for k in np.flatnonzero(np.diff(ends)):
            some = table[:, ends[k] : ends[k + 1]].copy()
            # A place more for -1, the last one.
            here = np.zeros(len(number), bool)
            here[some[1:-1]] = True
            used = np.flatnonzero(here[:-1])
            number[used] = np.arange(len(used))
            some[1:-1] = number[some[1:-1]]
            yield int(k), zlib.compress(b"\n".join(names.dictionary.take(pa.array(used)).cast(pa.large_binary()).to_pylist()), 1), spoken, zlib.compress(some.tobytes(), 1)


def _counted(held: DataFrame, trie: Trie, shard: int) -> DataFrame:
    """(shard, number, n) of the phrases of a trie that stand in the blocks."""
    sent = held.sparkSession.sparkContext.broadcast(trie)

    def run(batches):
        total = None
        for block in read_blocks(batches):
            found = sent.value.counts(block)
            total = found if total is None else total + found
        if total is not None:
            number = np.flatnonzero(total)
            yield pa.record_batch({"shard": pa.array(np.full(len(number), shard, np.int32)), "number": pa.array(number.astype(np.int32)), "n": pa.array(total[number])})

    with arrow_rows(held.sparkSession, BATCH_BLOCKS):
        sums = table(held.drop("hashes").mapInArrow(run, "shard int, number int, n long").groupBy("shard", "number").agg(F.sum("n").alias("n")))
    sent.destroy()
    return sums


def _dealt(held: DataFrame, tries: DataFrame, shards: int, places: int, bitmaps: list, mask: int) -> DataFrame:
    """(shard, number, n) of the phrases of all tries that stand in the blocks, at about so many places.

    The phrases of a shard are counted by as many copies of its trie as their places ask for.
    """
    sent, most, copies = held.sparkSession.sparkContext.broadcast(bitmaps), DEALT, max(1, math.ceil(places / (shards * UNIT_PLACES)))
    names = ("names", "langs", "rows")

    def run(batches):
        dealer, copy = Dealer(most), TaskContext.get().partitionId()

        def batch(copy):
            for shard, *values in dealer.deal(shards):
                yield pa.record_batch({"unit": pa.array([shard * copies + copy % copies], pa.int32()), **{k: pa.array([v], pa.binary()) for k, v in zip(names, values, strict=True)}})

        for block in read_blocks(batches):
            dealer.add(block, levels(block, sent.value, mask))
            if dealer.full():
                yield from batch(copy)
                copy += 1
        yield from batch(copy)

    def match(pieces, tries):
        total = np.zeros(0, np.int64)
        if pieces.num_rows and tries.num_rows:
            trie = Trie(*(tries.column(k)[0].as_py() for k in ("words", "langs", "base", "check", "accepts")))
            total = sum(trie.sums(Piece(*(pieces.column(k)[i].as_py() for k in names))) for i in range(pieces.num_rows))
        number = np.flatnonzero(total)
        shard = tries.column("shard")[0].as_py() if tries.num_rows else 0
        return pa.table({"shard": pa.array(np.full(len(number), shard, np.int32)), "number": pa.array(number.astype(np.int32)), "n": pa.array(total[number])})

    pieces = held.mapInArrow(run, "unit int, names binary, langs binary, rows binary")
    copied = tries.where("base is not null").select("shard", "words", "langs", "base", "check", "accepts", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    copied = copied.withColumn("unit", (F.col("shard") * copies + F.col("copy")).cast("int")).drop("copy")
    with arrow_rows(held.sparkSession, BATCH_BLOCKS):
        found = pieces.groupBy("unit").cogroup(copied.groupBy("unit")).applyInArrow(match, "shard int, number int, n long")
        sums = table(found.groupBy("shard", "number").agg(F.sum("n").alias("n")))
    sent.destroy()
    return sums


def count_phrases(held: DataFrame, phrases: DataFrame, places: int, bitmaps: list, mask: int) -> DataFrame:
    """(size, h, lang, phrase, n): the phrases (size, h, lang, phrase) with their exact counts, by one trie after the other.
    `places` is about the number of places they stand at; `bitmaps` and `mask` are those of levels()."""
    shards = max(1, math.ceil(phrases.count() / TRIE_PHRASES))
    # By the hash that a place has, too.
    tries = table(phrases.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, BUILT_DDL))
    counts = _dealt(held, tries, shards, places, bitmaps, mask) if places > UNIT_PLACES else None
    for shard in range(shards if counts is None else 0):
        row = tries.where((F.col("shard") == shard) & F.col("base").isNotNull()).select("words", "langs", "base", "check", "accepts").first()
        if row is not None:
            some = _counted(held, Trie(*row), shard)
            counts = some if counts is None else counts.union(some)
    numbered = tries.where("base is null").select("shard", "number", "size", "h", "lang", "phrase")
    if counts is None:
        return numbered.select("size", "h", "lang", "phrase", F.lit(1).cast("long").alias("n"))
    return table(numbered.join(counts, ["shard", "number"]).select("size", "h", "lang", "phrase", "n"))


def phrase_counts(held: DataFrame, least: int, mask: int = 2**64 - 1) -> DataFrame:
    """(lang, phrase, size, n): every phrase of up to WORDS words that stands at least `least` times in the
    blocks, with its exact count. `mask` is for tests, to make hashes meet."""
    bitmaps, hashes = [], []
    for _ in range(WORDS):
        hashes.append(_hash_counts(held, bitmaps, least, mask))
        bitmaps.append(_bitmap(hashes[-1], hashes[-1].count()))
    wanted = hashes[0]
    for more in hashes[1:]:
        wanted = wanted.union(more)

    def counted(phrases, hashes):
        return count_phrases(held, phrases, hashes.agg(F.sum("n")).first()[0] or 0, bitmaps, mask)

    counts = counted(_spelled(held, bitmaps, wanted, mask, everywhere=False), wanted)
    # A hash that stands more often than its phrase has other phrases, too.
    seen = counts.groupBy("size", "h").agg(F.sum("n").alias("seen"))
    shared = table(wanted.join(seen, ["size", "h"], "left").where(F.coalesce("seen", F.lit(0)) < F.col("n")).select("size", "h", "n", "block"))
    if not shared.isEmpty():
        others = _spelled(held, bitmaps, shared, mask, everywhere=True).join(counts, ["size", "lang", "phrase"], "left_anti")
        counts = counts.union(counted(table(others.select("size", "h", "lang", "phrase")), shared))
    return table(counts.where(F.col("n") >= least).select("lang", "phrase", "size", "n"))


def _totals(held: DataFrame) -> DataFrame:
    """(lang, total): the words of every language."""

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                langs, lang, words = (b.column(n)[row].as_buffer() for n in ("langs", "lang", "words"))
                names = _read(langs)
                n = np.bincount(np.frombuffer(lang, np.int32), weights=np.frombuffer(words, np.int32), minlength=len(names))
                yield pa.record_batch({"lang": names, "total": pa.array(n.astype(np.int64))})

    return held.select("langs", "lang", "words").mapInArrow(run, "lang string, total long").groupBy("lang").agg(F.sum("total").alias("total"))


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the first `top` phrases of two or three words of each language.

    A-Z count as lower case. Texts end pieces at . , ; : ! ? and line breaks, words at spaces and tabs. a is the
    count of a phrase, at least `least`; l and r are the counts of its parts at the cut with the lowest score
    floor(1000000 * a * a / (l * r)), ties to the earlier cut; n is the number of words of the language. A phrase
    goes if its words stand together in a longer one that is at least `share` per cent as frequent. Order: score,
    then a, both descending, then the bytes of the phrase.

    Null texts count as empty, a null language as `und`. Repeated rows count each. Empty tables, or no phrase that
    is frequent enough, give no rows. Other columns are not read.
    """
    held = encoded(docs, lang_col, text_col)
    counts = phrase_counts(held, least)
    words = F.split("phrase", " ")

    def joined(start, length):
        return F.array_join(F.slice(words, start, length), " ")

    several = counts.where("size > 1").withColumnRenamed("n", "a")
    inside = several.where("size > 2").select("lang", F.explode(F.array(joined(1, 2), joined(2, 2))).alias("phrase"), F.col("a").alias("longer"))
    swallowed = several.where("size = 2").join(inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer")), ["lang", "phrase"])
    gone = swallowed.where(F.col("longer") * 100 >= F.col("a") * share).select("lang", "phrase")
    cuts = several.join(gone, ["lang", "phrase"], "left_anti").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"left": joined(F.lit(1), F.col("k")), "right": joined(F.col("k") + 1, F.col("size") - F.col("k"))})
    parts = counts.select("lang", F.col("phrase").alias("part"), "n")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.withColumnsRenamed({"lang": "_lang", "n": name}), (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("part"))).drop("_lang", "part")

    def wide(x):
        return F.col(x).cast("decimal(19,0)")

    # Products in 38 digits: a count below 10^16 cannot pass them.
    cuts = cuts.withColumn("up", (wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")).withColumn("down", (wide("l") * wide("r")).cast("decimal(38,0)"))
    scored = cuts.withColumn("score", F.expr("cast(up div down as long)"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.score", "x.l", "x.r")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # A language may hold most phrases: its first ones are found in shares, then among the first ones of these.
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lowest.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "share")
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    named = _totals(held).withColumnsRenamed({"lang": "_lang", "total": "n"})
    return first.join(named, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
