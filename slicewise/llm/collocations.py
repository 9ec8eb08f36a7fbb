"""Collocations by prefix-free parsing: n-grams are counted inside a dictionary of distinct chunks.

Method: the words of a text are cut where the OVERLAP words from a place on have a hash divisible by MODULUS, so cuts
depend on content alone. A chunk reaches from one cut to the OVERLAP words behind the next one; chunks overlap by these.
A phrase of at most OVERLAP + 1 words that begins before the next cut is therefore whole in its chunk, and a phrase is
counted in the chunk in which its first word is not part of the overlap at the end: once. Copies and repeated passages
give the same chunks, so the chunks become a dictionary with the number of times each was parsed; words and phrases are
counted once in each distinct chunk and weighted with that number. Where no cut comes for LONGEST words, one is made.

Phrases come in three passes over the dictionary, each pruned by the one before through a filter of a fixed number of
bits (whatever it lets through by chance is counted and then dropped, so counts are exact): words; pairs of words that
are frequent enough, by hash; phrases of which each pair of neighbours may be frequent enough. Only the last pass moves phrases.

Defined results: a null text is empty, a null lang is `und`. Text is lower-cased by A-Z only; pieces end at
`[.,;:!?\\x0A-\\x0D]`, words are `[^\\x20\\x09]+` of them. Repeated rows count as often as they occur. Scores are exact
whole numbers of up to 38 digits on the way. Ties: scores, counts, then phrases in byte order. Other columns are not
read. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrays
from .tables import stored

LEAST, SIZES, TOP = 100, 5, 2000
#: words by which chunks overlap, the share of places where they are cut, and the most words from cut to cut
OVERLAP, MODULUS, LONGEST = SIZES - 1, 32, 512
#: bits of the filters of frequent words and of frequent pairs
WORD_BITS, PAIR_BITS = 1 << 25, 1 << 27
#: bytes of chunks that a task looks at together
HELD = 3 << 20
_SPACE, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class Words:
    """The words of many rows: normal bytes (a space or, behind the end of a piece, a line break after each word).

    `start` and `end` are places in `data`, `ends` tells whether a word is the last one of its piece, `before` counts
    the words before each row.
    """

    def __init__(self, data: np.ndarray, rows: np.ndarray):
        stop = _STOP[data]
        inside = ~(stop | _SPACE[data])
        before = np.zeros_like(inside)
        before[1:] = inside[:-1]
        before[rows[:-1][rows[:-1] < len(data)]] = False
        first = inside & ~before
        letters = _LOWER[data][inside]
        at = np.flatnonzero(first[inside])
        n = len(at)
        self.start = at + np.arange(n)
        self.end = np.concatenate([at[1:], [len(letters)]]).astype(np.int64) + np.arange(n) if n else np.zeros(0, np.int64)
        self.data = np.full(len(letters) + n, 32, np.uint8)
        word = np.cumsum(first[inside]) - 1
        self.data[np.arange(len(letters)) + word] = letters
        places = np.flatnonzero(first)
        self.before = np.searchsorted(places, rows).astype(np.int64)
        # a piece ends behind a word if a stop comes before the next word, or the row ends
        stops = np.concatenate([[0], np.cumsum(stop)])
        self.ends = np.ones(n, bool)
        if n:
            self.ends[:-1] = stops[places[1:]] > stops[places[:-1]]
            self.ends[self.before[1:][self.before[1:] > self.before[:-1]] - 1] = True
        self.data[self.end[self.ends]] = 10

    def values(self, first: np.ndarray, last: np.ndarray) -> pa.LargeBinaryArray:
        """The bytes from each first word to the last one."""
        return gathered(self.data, self.start[first], self.end[last])

    def hashes(self) -> np.ndarray:
        n = len(self.start)
        at = np.concatenate([self.start, [len(self.data)]]).astype(np.int64)
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at), pa.py_buffer(self.clean())])
        return arrays.hashes(whole)

    def clean(self) -> np.ndarray:
        """The bytes with a space behind each word, the same for a word at any place."""
        data = self.data.copy()
        data[self.end] = 32
        return data


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.LargeBinaryArray:
    sizes = end - start
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    index = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], sizes)
    kept = np.ascontiguousarray(data[index])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])


def cuts(hashed: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, first word of the next chunk, end) of every chunk of rows whose words have these hashes."""
    n = len(hashed)
    with np.errstate(over="ignore"):
        window = np.zeros(max(0, n - OVERLAP + 1), np.uint64)
        for k in range(OVERLAP):
            window += hashed[k : n - OVERLAP + 1 + k] * _FACTORS[k % len(_FACTORS)]
    cut = np.zeros(n, bool)
    cut[: len(window)] = arrays.mixed(window) % np.uint64(MODULUS) == 0
    row = np.repeat(np.arange(len(before) - 1), np.diff(before))
    last = before[1:][row]
    cut &= np.arange(n) + OVERLAP <= last  # the words of a cut belong to one row
    cut[before[:-1][before[:-1] < before[1:]]] = True
    first = np.flatnonzero(cut)
    gap = np.diff(np.concatenate([first, [n]]))
    if (gap > LONGEST).any():
        # places from the cut before it on, so equal passages behind a cut are cut alike
        since = np.arange(n) - np.repeat(first, gap)
        first = np.flatnonzero(since % LONGEST == 0)
    following = np.concatenate([first[1:], [n]]).astype(np.int64)
    whole = last[first]
    end = np.where(following < whole, np.minimum(following + OVERLAP, whole), whole)
    return first, np.minimum(following, whole), end


def chunks(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, chunk, own): the chunks of all texts; phrases that begin in the first `own` words are theirs."""

    def run(batches):
        for batch in batches:
            for low, _, data, rows in arrays.pieces(batch.column(1)):
                w = Words(data, rows)
                if not len(w.start):
                    continue
                first, following, end = cuts(w.hashes(), w.before)
                row = np.searchsorted(w.before, first, side="right") - 1
                values = w.values(first, end - 1)
                langs = batch.column(0).take(pa.array(row + low))
                yield pa.RecordBatch.from_arrays(
                    [langs, values.cast(pa.binary()), pa.array((following - first).astype(np.int32))], ["lang", "chunk", "own"]
                )

    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return named.mapInArrow(run, "lang string, chunk binary, own int")


class Block:
    """Chunks of a task: their words, and which of them begin phrases, with what weight, in which language."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        values = table["chunk"].combine_chunks().cast(pa.large_binary())
        _, offsets, data = values.buffers()
        at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
        data = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
        self.words = Words(data, at - at[0])
        n = np.diff(self.words.before)
        self.row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(self.row)) - np.repeat(self.words.before[:-1], n)
        self.own = place < table["own"].to_numpy()[self.row]
        self.left = self.words.before[1:][self.row] - np.arange(len(self.row))
        self.times = table["times"].to_numpy()[self.row]
        langs = table["lang"].combine_chunks().dictionary_encode()
        self.langs, self.lang = langs.dictionary, langs.indices.to_numpy()[self.row]
        salts = arrays.hashes(self.langs.cast(pa.large_binary()))
        self.hashed = self.words.hashes()
        self.salt = salts[self.lang]

    def word_marks(self) -> np.ndarray:
        return word_mark(self.hashed, self.salt)

    def pair_marks(self) -> np.ndarray:
        """A hash of each word with the next one (in the same language); the last one has none of use."""
        after = np.roll(self.hashed, -1)
        return pair_mark(self.hashed, after, self.salt)

    def joined(self) -> np.ndarray:
        """Whether a word and the next one are in one piece and chunk."""
        return ~self.words.ends & (self.left > 1)

    def counted(self, first: np.ndarray, length: int) -> pa.RecordBatch:
        """(lang, phrase, f, size) of the phrases of `length` words at these words."""
        values = self.words.values(first, first + length - 1)
        codes, names = arrays.coded(values)
        both = codes.astype(np.int64) * len(self.langs) + self.lang[first]
        found, inverse = np.unique(both, return_inverse=True)
        f = np.zeros(len(found), np.int64)
        np.add.at(f, inverse, self.times[first])
        return pa.RecordBatch.from_arrays(
            [self.langs.take(pa.array(found % len(self.langs))), names.take(pa.array(found // len(self.langs))).cast(pa.binary()).cast(pa.string()),
             pa.array(f), pa.array(np.full(len(found), length, np.int32))], ["lang", "phrase", "f", "size"],
        )


def word_mark(hashed: np.ndarray, salt: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return arrays.mixed(hashed * _FACTORS[0] + salt)


def pair_mark(hashed: np.ndarray, after: np.ndarray, salt: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return arrays.mixed(hashed * _FACTORS[1] + arrays.mixed(after * _FACTORS[2] + salt))


def blocks(batches):
    """The chunks of a task, about HELD bytes at a time."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > HELD:
            yield Block(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield Block(pa.Table.from_batches(held))


def has(bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    at = marks & np.uint64(64 * len(bits) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def filter_of(marks: DataFrame, size: int) -> np.ndarray:
    """A bit for each mark (a 64-bit hash, as bigint): `size` bits, whatever the number of marks."""
    at = F.col("mark").bitwiseAND(F.lit(size - 1))
    cells = marks.select(F.shiftright(at, 6).cast("int").alias("cell"), F.expr("shiftleft(1L, cast(mark & 63 as int))").alias("bit"))
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[found.column("cell").to_numpy()] = found.column("bits").to_numpy()
    return bits.view(np.uint64)


_COUNTED = "lang string, phrase string, f bigint, size int"


def word_counts(dictionary: DataFrame) -> DataFrame:
    def run(batches):
        for block in blocks(batches):
            yield block.counted(np.flatnonzero(block.own), 1)

    counts = dictionary.mapInArrow(run, _COUNTED)
    return counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f"), F.min("size").alias("size"))


def marked_words(words: DataFrame) -> DataFrame:
    """(mark) of the rows of a table of words."""

    def run(batches):
        for batch in batches:
            ends = pc.binary_join_element_wise(batch.column(1).cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
            salt = arrays.hashes(batch.column(0).cast(pa.large_binary()))
            yield pa.RecordBatch.from_arrays([pa.array(word_mark(arrays.hashes(ends), salt).view(np.int64))], ["mark"])

    return words.select("lang", "phrase").mapInArrow(run, "mark bigint")


def marked_pairs(dictionary: DataFrame, words: np.ndarray, least: int) -> DataFrame:
    """(mark) of the pairs of frequent words that may be frequent enough."""
    shipped = dictionary.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for block in blocks(batches):
            known = has(shipped.value, block.word_marks())
            first = np.flatnonzero(block.own & block.joined() & known & np.roll(known, -1))
            found, inverse = np.unique(block.pair_marks()[first], return_inverse=True)
            f = np.zeros(len(found), np.int64)
            np.add.at(f, inverse, block.times[first])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(f)], ["mark", "f"])

    sums = dictionary.mapInArrow(run, "mark bigint, f bigint").groupBy("mark").agg(F.sum("f").alias("f"))
    return sums.where(F.col("f") >= least).select("mark")


def phrase_counts(dictionary: DataFrame, words: np.ndarray, pairs: np.ndarray, sizes: int) -> DataFrame:
    """The counts of all phrases of 2 to `sizes` words of which each word and pair may be frequent enough."""
    shipped = dictionary.sparkSession.sparkContext.broadcast((words, pairs))

    def run(batches):
        words, pairs = shipped.value
        for block in blocks(batches):
            known = has(words, block.word_marks())
            links = block.joined() & known & np.roll(known, -1) & has(pairs, block.pair_marks())
            run_on = block.own & links
            for length in range(2, sizes + 1):
                first = np.flatnonzero(run_on)
                if not len(first):
                    break
                yield block.counted(first, length)
                run_on &= np.roll(links, -(length - 1)) & (block.left > length)

    counts = dictionary.mapInArrow(run, _COUNTED)
    return counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f"), F.min("size").alias("size"))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first phrases."""
    parsed = chunks(docs, text, lang).groupBy("lang", "chunk", "own").agg(F.count("*").alias("times"))
    dictionary = stored(parsed, "dictionary")
    every = stored(word_counts(dictionary), "words")
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = every.where(F.col("f") >= least)
    words = filter_of(marked_words(frequent), WORD_BITS)
    pairs = filter_of(marked_pairs(dictionary, words, least), PAIR_BITS)
    phrases = phrase_counts(dictionary, words, pairs, SIZES).where(F.col("f") >= least)
    candidates = stored(phrases, "candidates")

    # counts of the two parts of each cut: a part is as frequent as the phrase, so it is a word or a candidate
    parts = frequent.unionByName(candidates).select("lang", F.col("phrase").alias("part"), F.col("f").alias("count"))
    split = candidates.select("lang", "phrase", "f", "size", F.split("phrase", " ").alias("w"))
    cut = split.select("lang", "phrase", "f", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size")
    cut = cut.select(
        "lang", "phrase", "f", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    cut = cut.join(parts.select("lang", F.col("part").alias("head"), F.col("count").alias("l")), ["lang", "head"])
    cut = cut.join(parts.select("lang", F.col("part").alias("rest"), F.col("count").alias("r")), ["lang", "rest"])
    above = "cast(1000 * cast(f as decimal(15, 0)) as decimal(19, 0)) * cast(n as decimal(18, 0))"
    below = "cast(l as decimal(18, 0)) * cast(r as decimal(18, 0))"
    cut = cut.join(totals, "lang").withColumn("score", F.expr(f"({above}) div ({below})"))
    best = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "n", "f")).alias("b"))

    # a phrase that occurs only inside a longer candidate goes
    inner = split.where("size > 2").select(
        "lang", "f", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("length")
    )
    inner = inner.select("lang", "f", "w", "length", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)).alias("from"))
    inner = inner.select("lang", "f", F.array_join(F.slice("w", F.col("from"), F.col("length")), " ").alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = best.join(around, ["lang", "phrase"], "left").where("around is null or around < b.f")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("b.f"), "phrase"))
    ranked = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("b.f").alias("a"), "b.l", "b.r", "b.n", "b.score")
