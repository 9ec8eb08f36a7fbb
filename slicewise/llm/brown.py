"""Language-model scores with a class-based bigram model whose classes come from exchange clustering.

Model: P(w | v) = P(c(w) | h(v)) * P(w | c(w)), with c(w) the class of a word and h(v) its class as history. Class
transitions are smoothed by ALPHA, word emissions by one count for each known word of a class and one for the unknown
word, so that the probabilities of all words known to a class and of the unknown word add up to one. A word that
training has not seen has, after a class, the chance of the unknown word of any class. Each text is a sentence: it
begins after an end token and has one at its end.

Classes of histories: the most frequent words of the training texts (at most CORE) are units of their own; each other
word is a history by the unit of its ending (a hash of its last three bytes, TAILS units). Starting from classes dealt
out by frequency, the training texts (written once as unit numbers) are counted in parallel as units against the classes
of their left and right neighbours; then each unit in turn moves to the class that gives the training texts the highest
likelihood, with the class matrix kept up to date. A round counts again, and the best classes of all rounds stay. The
counts of a round are a matrix of units by classes, which has the same size whatever the size of the corpus.

Classes of words: core words keep the class of their unit. Every other word of the training texts, however rare, is a
row with its counts after each class of history (at most CLASSES cells). Starting from the class of its ending, it moves
to the class that raises the likelihood most. The words of a few turns (each one in TURNS of them, by a hash) are moved in
parallel against the broadcast class matrix, which is then brought up to date by their sums. Where all these moves
together do not raise the likelihood, half as many turns are tried, where they do, twice as many come next. So each
occurrence in the training texts is predicted from an exchanged class; endings alone decide only for the history of
words outside the core.

Counts and classes are joined to the words of the texts: those of frequent words (at most FREQUENT, of at most LONGEST
bytes) from a broadcast where the text is read, those of the others by a join on the word.

Defined results: a null or empty text is one end token. Without any training text every word is unknown and the score
is the base score. Repeated rows and ids are scored each on its own; rows without an id are training rows that are not
held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .tables import frequent, stored

CLASSES, ALPHA, ROUNDS = 64, 0.1, 4
#: units that are one frequent word each, and units of other words by their ending
CORE, TAILS = 2048, 1024
#: most words in the broadcast list of counts, and most bytes of one of them
FREQUENT, LONGEST = 1 << 17, 48
#: distinct words that a task holds before it passes them on
HELD = 1 << 19
#: occurrences of words outside the core that a task holds before it adds them up
GATHERED = 1 << 20
#: turns in which the words outside the core move, how often each has its turn, and words that a task looks at at once
TURNS, SWEEPS, AT_ONCE = 64, 2, 1024
#: the end token, which no word can be
END = b""


def held_out(key: str, part: int = 7, rest: int = 2):
    """True for the rows whose crc32(id as text) leaves `rest`, false for all others."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(part)) == rest, F.lit(False))


def with_ends(values: pa.Array, before: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of each row and then an end token; (all of them, their number before each row)."""
    n = len(before) - 1
    row = np.repeat(np.arange(n), np.diff(before))
    order = np.full(len(values) + n, len(values), np.int64)
    order[np.arange(len(values)) + row] = np.arange(len(values))
    tokens = pa.concat_arrays([values, pa.array([END], pa.large_binary())]).take(pa.array(order))
    return tokens, before + np.arange(n + 1)


def flat(values: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all values in a row, where each begins in them and the last one ends)."""
    values = pa.array(values, pa.large_binary()) if isinstance(values, list) else values.cast(pa.large_binary())
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def places(values: pa.Array | list[bytes], listed: pa.Array) -> np.ndarray:
    """The place of each value in a list, or -1."""
    values = pa.array(values, pa.large_binary()) if isinstance(values, list) else values
    return pc.fill_null(pc.index_in(values, value_set=listed), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def endings(values: pa.Array | list[bytes]) -> np.ndarray:
    """The unit of each word by its last three bytes, counted from 0."""
    data, at = flat(values)
    code = np.zeros(len(at) - 1, np.uint64)
    for k in (3, 2, 1):
        inside = np.flatnonzero(at[1:] - k >= at[:-1])
        code[inside] = code[inside] * np.uint64(256) + data[at[1:][inside] - k]
    code += np.uint64(1)
    with np.errstate(over="ignore"):
        return (arrays.mixed(code * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(TAILS)).astype(np.int64)


class Units:
    """Unit of each word: its own, if it is of the core, or that of its ending."""

    def __init__(self, core: list[bytes]):
        self.core = {w: i for i, w in enumerate(core)}
        self.listed = pa.array(core, pa.large_binary())

    def of(self, values: pa.Array) -> np.ndarray:
        own = places(values, self.listed)
        tail = np.flatnonzero(own < 0)
        own[tail] = CORE + endings(values.take(pa.array(tail)))
        return own


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all texts, the end token among them."""

    def run(batches):
        held, size = [], 0

        def added():
            codes, distinct = arrays.coded(pa.concat_arrays([v for v, _ in held]))
            return distinct, np.bincount(codes, np.concatenate([n for _, n in held]), len(distinct)).astype(np.int64)

        def passed(values, n):
            return pa.RecordBatch.from_arrays([values.cast(pa.binary()), pa.array(n)], ["word", "n"])

        for batch in batches:
            held.append((pa.array([END], pa.large_binary()), np.array([batch.num_rows])))
            for _, _, data, rows in arrays.pieces(batch.column(0)):
                values, _ = arrays.words(data, rows)
                codes, distinct = arrays.coded(values)
                held.append((distinct, np.bincount(codes, minlength=len(distinct))))
                size += len(distinct)
                if size > 2 * HELD:
                    held = [added()]
                    size = len(held[0][0])
                    if size > HELD:
                        yield passed(*held[0])
                        held, size = [], 0
        if held:
            yield passed(*added())

    return texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def unit_texts(texts: DataFrame, core: list[bytes]) -> DataFrame:
    """(units): the unit numbers of many texts in a row, as 16-bit integers, each text between end tokens."""
    shipped = texts.sparkSession.sparkContext.broadcast(core)

    def run(batches):
        units = Units(shipped.value)
        for batch in batches:
            for _, _, data, rows in arrays.pieces(batch.column(0)):
                tokens, _ = with_ends(*arrays.words(data, rows))
                codes, distinct = arrays.coded(tokens)
                found = units.of(distinct)[codes]
                line = np.concatenate([[units.core[END]], found]).astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([line], pa.binary())], ["units"])

    return texts.mapInArrow(run, "units binary")


def neighbour_counts(lines: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units x classes of the left neighbours, units x classes of the right ones), counted over all texts."""
    count, many = len(classes), CLASSES
    shipped = lines.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        classes = shipped.value
        sums = np.zeros(2 * count * many, np.int64)
        for batch in batches:
            for line in batch.column(0):
                u = np.frombuffer(line.as_buffer(), "<u2").astype(np.int64)
                sums[: count * many] += np.bincount(u[1:] * many + classes[u[:-1]], minlength=count * many)
                sums[count * many :] += np.bincount(u[:-1] * many + classes[u[1:]], minlength=count * many)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["at", "n"])

    # at most 2 x units x classes rows, whatever the corpus
    found = lines.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(2 * count * many, np.int64)
    sums[found.column("at").to_numpy()] = found.column("n").to_numpy()
    left, right = sums.reshape(2, count, many)
    return left, right


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(matrix: np.ndarray) -> float:
    """The part of the training texts' log-likelihood that depends on the classes."""
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(0)).sum() - _xlogx(matrix.sum(1)).sum())


def class_matrix(right: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """How often a class follows a class."""
    matrix = np.zeros((CLASSES, CLASSES))
    np.add.at(matrix, classes, right)
    return matrix


def exchanged(left: np.ndarray, right: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Classes after each unit, frequent ones first, has moved to where the likelihood is highest."""
    classes = classes.copy()
    matrix = class_matrix(right, classes)
    every = np.arange(CLASSES)
    for u in np.argsort(-left.sum(1), kind="stable"):
        into, out = left[u].astype(float), right[u].astype(float)
        if not into.sum() and not out.sum():
            continue
        a = classes[u]
        matrix[:, a] -= into
        matrix[a, :] -= out
        matrix = np.maximum(matrix, 0)
        rows, columns = matrix.sum(1), matrix.sum(0)
        # joining class b adds `into` to its column and `out` to its row
        gain = (_xlogx(matrix + into[:, None]) - _xlogx(matrix)).sum(0)
        gain += (_xlogx(matrix + out[None, :]) - _xlogx(matrix)).sum(1)
        gain -= _xlogx(columns + into.sum()) - _xlogx(columns) + _xlogx(rows + out.sum()) - _xlogx(rows)
        b = a if gain[a] >= gain.max() - 1e-9 else int(every[gain.argmax()])
        matrix[:, b] += into
        matrix[b, :] += out
        classes[u] = b
    return classes


def cluster(lines: DataFrame, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, how often each unit follows a class), the best of ROUNDS rounds of exchanges."""
    classes = np.zeros(len(sizes), np.int64)
    classes[np.argsort(-sizes, kind="stable")] = np.arange(len(sizes)) % CLASSES
    best = None
    for step in range(ROUNDS + 1):
        left, right = neighbour_counts(lines, classes)
        value = likelihood(class_matrix(right, classes))
        if best is None or value > best[0]:
            best = (value, classes, left)
        elif step:
            break
        if step < ROUNDS:
            classes = exchanged(left, right, classes)
    return best[1], best[2]


def histories(tokens: np.ndarray, before: np.ndarray, end: int) -> np.ndarray:
    """The class before each token, given the classes of all tokens; texts begin after an end token."""
    previous = np.roll(tokens, 1)
    previous[before[:-1]] = end
    return previous


def cells(codes: np.ndarray, history: np.ndarray, times: np.ndarray, values: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(word, n, cells) of each code in `codes`, in their order; a cell is the 64-bit number times * CLASSES + history."""
    key, index = np.unique(codes.astype(np.int64) * CLASSES + history, return_inverse=True)
    n = np.bincount(index, times, len(key)).astype(np.int64)
    code = key // CLASSES
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    ends = np.append(starts, len(key)).astype(np.int32) * 8
    packed = (n * CLASSES + key % CLASSES).astype("<i8")
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
    total = np.add.reduceat(n, starts) if len(starts) else n
    return values.take(pa.array(code[starts])).cast(pa.binary()), pa.array(total), found


def uncelled(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, history, times) of each cell, and the first cell of each row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data, at = flat(column)
    packed = np.frombuffer(data.tobytes(), "<i8")
    return np.repeat(np.arange(len(column)), np.diff(at) // 8), packed % CLASSES, packed // CLASSES, at[:-1] // 8


def contexts(texts: DataFrame, core: list[bytes], classes: np.ndarray) -> DataFrame:
    """(word, n, cells, c) of each word outside the core: occurrences, those after each history, class of its ending.

    Tasks add up what they hold; a word's rows are then merged from a sorted partition, batch by batch, so neither step
    holds more than a bounded number of rows.
    """
    shipped = texts.sparkSession.sparkContext.broadcast((core, classes))
    names = ["word", "n", "cells"]

    def run(batches):
        core, classes = shipped.value
        units, held = Units(core), []

        def passed():
            if held:
                codes, distinct = arrays.coded(pa.concat_arrays([w for w, _ in held]))
                history = np.concatenate([h for _, h in held])
                yield pa.RecordBatch.from_arrays([*cells(codes, history, np.ones(len(codes)), distinct)], names)
                held.clear()

        for batch in batches:
            for _, _, data, rows in arrays.pieces(batch.column(0)):
                tokens, before = with_ends(*arrays.words(data, rows))
                codes, distinct = arrays.coded(tokens)
                unit = units.of(distinct)[codes]
                outside = np.flatnonzero(unit >= CORE)
                held.append((tokens.take(pa.array(outside)), histories(classes[unit], before, classes[0])[outside]))
                if sum(len(h) for _, h in held) >= GATHERED:
                    yield from passed()
        yield from passed()

    def merge(batches):
        _, classes = shipped.value
        last = None

        def rows(word, n, packed):
            c = classes[CORE + endings(word)]
            return pa.RecordBatch.from_arrays([word, n, packed, pa.array(c)], [*names, "c"])

        for batch in batches:
            table = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            if not table.num_rows:
                continue
            codes, distinct = arrays.coded(table.column("word").combine_chunks())
            row, history, times, _ = uncelled(table.column("cells"))
            word, n, packed = cells(codes[row], history, times, distinct)
            yield rows(word[:-1], n[:-1], packed[:-1])
            # the next batch may go on with the last word
            last = pa.RecordBatch.from_arrays([word[-1:], n[-1:], packed[-1:]], names)
        if last is not None:
            yield rows(*last.columns)

    found = texts.mapInArrow(run, "word binary, n bigint, cells binary")
    sorted_ = found.repartition("word").sortWithinPartitions("word")
    return sorted_.mapInArrow(merge, "word binary, n bigint, cells binary, c bigint")


def by_turn(words: DataFrame) -> DataFrame:
    """The rows written once to the shared folder, sorted by turn in each file, so that a turn reads few pages of it."""
    turn = F.pmod(F.crc32("word"), F.lit(TURNS)).cast("int")
    return stored(words.withColumn("turn", turn).sortWithinPartitions("turn"), "contexts")


def chosen(column: pa.Array, n: np.ndarray, own: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The class of each word at which the likelihood is highest, all other words staying where they are.

    Words of one class with the same cells, as most rare ones are, have the same answer, which is worked out once.
    """
    codes, _ = arrays.coded(column)
    _, first, again = np.unique(codes.astype(np.int64) * CLASSES + own, return_index=True, return_inverse=True)
    parts = [first[low : low + AT_ONCE] for low in range(0, len(first), AT_ONCE)]
    found = [_chosen(column.take(pa.array(p)), n[p], own[p], matrix) for p in parts]
    return np.concatenate([own[:0], *found])[again]


def _chosen(column: pa.Array, n: np.ndarray, own: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    row, history, times, starts = uncelled(column)
    each, totals = np.arange(len(own)), matrix.sum(0)
    rest = matrix[history]
    rest[np.arange(len(row)), own[row]] -= times
    gain = np.add.reduceat(_xlogx(rest + times[:, None]) - _xlogx(rest), starts)
    whole = np.repeat(totals[None, :], len(own), axis=0)
    whole[each, own] -= n
    gain -= _xlogx(whole + n[:, None]) - _xlogx(whole)
    return np.where(gain[each, own] >= gain.max(1) - 1e-9, own, gain.argmax(1))


def word_matrix(words: DataFrame, matrix: np.ndarray | None = None) -> np.ndarray:
    """How often a class follows a class of history, over all rows of `words`.

    With a class matrix, instead what it changes by when all these rows move to their best classes.
    """
    shipped = words.sparkSession.sparkContext.broadcast(matrix)

    def run(batches):
        matrix, sums = shipped.value, np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            row, history, times, _ = uncelled(batch.column(1))
            own = batch.column(2).to_numpy()
            if matrix is None:
                np.add.at(sums, history * CLASSES + own[row], times)
            else:
                new = chosen(batch.column(1), batch.column(0).to_numpy(), own, matrix)
                np.add.at(sums, history * CLASSES + new[row], times)
                np.subtract.at(sums, history * CLASSES + own[row], times)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["at", "n"])

    out = np.zeros(CLASSES * CLASSES)
    found = words.select("n", "cells", "c").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n"))
    for at, n in found.collect():  # at most CLASSES x CLASSES rows
        out[at] = n
    return out.reshape(CLASSES, CLASSES)


def moved(words: DataFrame, steps: list[np.ndarray | None]) -> DataFrame:
    """(word, n, cells, c) after the words of each turn have moved, by the class matrix that their turn found."""
    shipped = words.sparkSession.sparkContext.broadcast(steps)

    def run(batches):
        steps = shipped.value
        for batch in batches:
            c, turns = batch.column(3).to_numpy().copy(), batch.column(4).to_numpy()
            for turn, matrix in enumerate(steps):
                some = np.flatnonzero(turns == turn)
                if matrix is not None and len(some):
                    rows = batch.take(pa.array(some))
                    c[some] = chosen(rows.column(2), rows.column(1).to_numpy(), c[some], matrix)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(c)], ["word", "n", "cells", "c"])

    found = words.select("word", "n", "cells", "c", "turn")
    return found.mapInArrow(run, "word binary, n bigint, cells binary, c bigint")


def word_classes(
    texts: DataFrame, core: list[bytes], classes: np.ndarray, left: np.ndarray
) -> tuple[DataFrame, np.ndarray]:
    """((word, n, c) of every word of the texts, how often a class follows a class of history)."""
    spark, own = texts.sparkSession, len(core)
    words = by_turn(contexts(texts, core, classes))
    matrix = word_matrix(words)
    np.add.at(matrix.T, classes[:own], left[:own])
    value = likelihood(matrix)
    width = 1
    for _ in range(SWEEPS):
        steps: list[np.ndarray | None] = []
        while len(steps) < TURNS:
            now = min(width, TURNS - len(steps))
            turn = F.col("turn").between(len(steps), len(steps) + now - 1)
            # seen as if every class had already taken in words of any history, as many as may move now: else all
            # of them would rush into a class that is empty or small, which is the best one for each of them alone
            drawn = matrix + matrix.sum(1, keepdims=True) * now / TURNS
            changed = matrix + word_matrix(words.where(turn), drawn)
            better = likelihood(changed) > value
            if not better and now > 1:
                width = now // 2
                continue
            steps += [drawn if better else None] * now
            if better:
                matrix, value, width = changed, likelihood(changed), min(2 * now, TURNS // 4)
        words = by_turn(moved(words, steps))
    n = left[:own].sum(1)
    columns = [pa.array(core, pa.binary()), pa.array(n), pa.array(classes[:own])]
    listed = spark.createDataFrame(pa.Table.from_arrays(columns, ["word", "n", "c"])).where("n > 0")
    return words.select("word", "n", "c").unionByName(listed), matrix


def class_sizes(words: DataFrame) -> np.ndarray:
    """[occurrences, distinct words] of each class."""
    out = np.zeros((2, CLASSES))
    for c, n, d in words.groupBy("c").agg(F.sum("n"), F.count("*")).collect():
        out[:, c] = n, d
    return out


class Model:
    """What scoring needs besides the counts of words: all of fixed size."""

    def __init__(self, core: list[bytes], classes: np.ndarray, matrix: np.ndarray, sizes: np.ndarray):
        self.core, self.classes = core, classes
        step = (matrix + ALPHA) / (matrix + ALPHA).sum(axis=1, keepdims=True)
        emission = 1 / (sizes.sum(axis=0) + 1)
        self.known = np.log10(step * emission[None, :])  # still to add: log10 of the word's count + 1
        self.unknown = np.log10(step @ emission)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", held=held_out) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    rows = docs.select(key, text, held(key).alias("held_out"))
    train = rows.where(~F.col("held_out")).select(text)
    vocabulary = stored(word_counts(train), "words")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    vocabulary = vocabulary.where("n > 0")
    top = frequent(vocabulary, "n", CORE - 1, F.col("word") != F.lit(END))
    top = top.orderBy(F.desc("n"), "word").toArrow()
    core = [END, *top.column("word").to_pylist()]
    lines = stored(unit_texts(train, core), "units")
    sizes = np.zeros(CORE + TAILS, np.int64)
    sizes[: len(core)] = [total, *top.column("n").to_pylist()]
    classes, left = cluster(lines, sizes)
    words, matrix = word_classes(train, core, classes, left)
    model = Model(core, classes, matrix, class_sizes(words))
    list_ = frequent(words, "n", FREQUENT, F.length("word") <= LONGEST).toArrow()
    place = pa.array(list_.column("word").to_pylist(), pa.large_binary())
    # one place more, for words that are not in the list
    listed = np.array([[*list_.column(name).to_pylist(), 0] for name in ("n", "c")], np.int64)
    shipped = spark.sparkContext.broadcast((core, classes, model.known, place, listed))
    names = ["k", "held_out", "line", "tokens", "known", "base", "sure", "word", "times", "history"]
    kinds = [docs.schema[key].dataType.simpleString(), "boolean", "bigint", "bigint", "bigint", "double", "double",
             "binary", "bigint", "bigint"]

    def run(batches):
        from pyspark import TaskContext

        core, classes, chances, place, listed = shipped.value
        units = Units(core)
        line = TaskContext.get().partitionId() << 33
        for batch in batches:
            for low, high, data, at in arrays.pieces(batch.column(1)):
                tokens, before = with_ends(*arrays.words(data, at))
                codes, different = arrays.coded(tokens)
                previous = histories(classes[units.of(different)][codes], before, classes[0])
                found = places(different, place)[codes]
                counts, c = listed[:, found]
                sure = found >= 0
                gain = np.log10(counts + 1.0)
                value = np.where(sure, chances[previous, c] + gain, 0.0)
                n, lines = high - low, np.arange(line, line + high - low)
                line += n
                keys, held = batch.column(0).slice(low, n), batch.column(2).slice(low, n)
                known = arrays.row_sums(sure.astype(np.int64), before)
                alone = pa.array([b"\x20" + i.to_bytes(8, "big") for i in lines.tolist()], pa.binary())
                zero = pa.array(np.zeros(n, np.int64))
                columns = [keys, held, pa.array(lines), pa.array(np.diff(before)), pa.array(known)]
                columns += [pa.array(arrays.row_sums(np.where(sure, gain, 0.0), before)), pa.array(arrays.row_sums(value, before))]
                yield pa.RecordBatch.from_arrays([*columns, alone, zero, zero], names)
                rare = np.flatnonzero(~sure)
                if not len(rare):
                    continue
                row = np.searchsorted(before, rare, "right") - 1
                pair = (row * len(different) + codes[rare]) * CLASSES + previous[rare]
                pair, times = np.unique(pair, return_counts=True)
                history, pair = pair % CLASSES, pair // CLASSES
                row, code = pair // len(different), pair % len(different)
                zero, nothing = pa.array(np.zeros(len(pair), np.int64)), pa.array(np.zeros(len(pair)))
                columns = [keys.take(pa.array(row)), held.take(pa.array(row)), pa.array(lines[row]), zero, zero, nothing]
                columns += [nothing, different.take(pa.array(code)).cast(pa.binary()), pa.array(times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(history)], names)

    parts = rows.select(key, text, "held_out").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, kinds)))
    joined = parts.join(words, "word", "left").withColumn("c", F.coalesce("c", F.lit(CLASSES)))
    # CLASSES x (CLASSES + 1) rows, whatever the input; class number CLASSES is the unknown word
    chances = np.concatenate([model.known, model.unknown[:, None]], axis=1)
    history, c = np.divmod(np.arange(chances.size), CLASSES + 1)
    columns = [pa.array(history), pa.array(c), pa.array(chances.ravel())]
    table = spark.createDataFrame(pa.Table.from_arrays(columns, ["history", "c", "chance"]))
    joined = joined.join(F.broadcast(table), ["history", "c"])
    gain = F.log10(F.col("n") + 1.0)
    seen = F.col("n").isNotNull()
    nothing = F.lit(0.0)
    summed = joined.groupBy("k", "held_out", "line").agg(
        F.sum("tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(seen, F.col("times")).otherwise(F.lit(0))).alias("n_known"),
        F.sum(F.col("base") + F.when(seen, F.col("times") * gain).otherwise(nothing)).alias("gain"),
        F.sum(
            F.col("sure") + F.col("times") * (F.col("chance") + F.when(seen, gain).otherwise(nothing))
        ).alias("score"),
    )
    base = F.col("gain") - F.col("n_tokens") * F.lit(float(np.log10(total + 1 * (distinct + 1))))
    return summed.select(
        F.col("k").alias(key),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(int(total)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("score") if total else base).alias("score"),
    )
