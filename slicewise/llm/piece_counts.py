"""Token counts of whole texts without ids: each distinct pre-token is encoded once.

Method: texts are cut into pre-tokens that no piece of the model can cross; the distinct pre-tokens of all texts are
counted in pieces once; each document's pre-token frequencies are joined to these counts and summed. No list of ids
ever exists. Pre-tokens that are frequent in the corpus (a list of at most FREQUENT rows with at most LONGEST bytes
each) are looked up from a broadcast where the document is read, so that the join only sees the rare ones, and no
pre-token is hot in it.

Where a text may be cut: the model escapes a space as U+2581, and its pieces hold that mark only at their front or
alone, and hold no line feed. `Rules` checks both for the given model and falls back to fewer cuts: a cut that some
piece could cross is not made. The mark that the library puts before a text is a space before its first pre-token.

Defined results: null and empty texts have 0 bytes and 0 tokens. Rows with the same key are counted each on its own,
since a row's number within its task is part of the key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .tables import frequent, stored

#: most pre-tokens in the broadcast list, and most bytes of one of them
FREQUENT, LONGEST = 1 << 17, 48
#: distinct pre-tokens that a task holds before it passes them on
HELD = 1 << 19
MARK = "▁"


class Rules:
    """Where texts may be cut for a model, and how one pre-token is counted."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("the model has pieces that go on after a space; its texts cannot be cut at spaces")
        probe = self.model.encode("a \n  a", out_type=str)
        if probe[0][:1] != MARK or "".join(p for p in probe if p != "<0x0A>") != f"{MARK}a{MARK}{MARK}{MARK}a":
            raise ValueError("the model normalises white space; its texts cannot be cut before that")
        self.lines = not any("\n" in p for p in pieces)

    def starts(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Byte positions at which pre-tokens begin."""
        if not len(data):
            return np.zeros(0, np.int64)
        space = data == 0x20
        mark = np.zeros(len(data), bool)
        mark[:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        inner = np.zeros(len(data), bool)
        inner[2:] = mark[:-2]
        ends = space | inner
        begin = space | mark
        begin[1:] &= ~ends[:-1]
        if self.lines:
            begin |= data == 0x0A
        begin[rows[:-1][rows[:-1] < len(data)]] = True
        return np.flatnonzero(begin)

    def tokens(self, data: np.ndarray, rows: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """(all pre-tokens, number of them before each row) of texts that already begin with a space."""
        starts = self.starts(data, rows)
        at = np.concatenate([starts, [len(data)]]).astype(np.int64)
        buffers = [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))]
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), buffers)
        return found, np.searchsorted(starts, rows)

    def counts(self, values: list[bytes]) -> list[int]:
        """Pieces of each pre-token."""
        texts, less = [], []
        for v in values:
            text = v.decode("utf-8")
            own = text[:1] in (" ", MARK)
            rest = text[1:] if own else text
            # without its own mark the library adds one; a mark that stands alone is one piece
            texts.append(rest)
            less.append(0 if own and rest else -1 if own else 1)
        got = self.model.encode(texts, num_threads=1)
        return [len(g) - k for g, k in zip(got, less)]


def leading(texts: pa.Array) -> pa.Array:
    """Texts as the library sees them: a space before each that is not empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    space = pa.scalar(" ", pa.large_string())
    none = pa.scalar("", pa.large_string())
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), none, pc.binary_join_element_wise(space, texts, none))


def distinct_pieces(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """(piece, n, pieces): the distinct pre-tokens of all texts, how often they occur and how many pieces they have."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def cut(batches):
        rules = Rules(shipped.value)
        held: dict[bytes, int] = {}

        def passed():
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["piece", "n"]
            )
            held.clear()

        for batch in batches:
            for _, _, data, rows in arrays.pieces(leading(batch.column(0))):
                found, _ = rules.tokens(data, rows)
                codes, distinct = arrays.coded(found)
                for value, n in zip(distinct.to_pylist(), np.bincount(codes, minlength=len(distinct)).tolist()):
                    held[value] = held.get(value, 0) + n
                if len(held) > HELD:
                    yield from passed()
        yield from passed()

    def count(batches):
        rules = Rules(shipped.value)
        for batch in batches:
            values = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rules.counts(values), pa.int64())], ["piece", "n", "pieces"]
            )

    found = docs.select(text).mapInArrow(cut, "piece binary, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    return found.mapInArrow(count, "piece binary, n bigint, pieces bigint")


def count_tokens(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", limit: int = 4096):
    """(key, n_bytes, n_tokens, over_limit) of every row, for a sentencepiece model given as its file's content."""
    spark = docs.sparkSession
    table = stored(distinct_pieces(docs, model, text), "pieces")
    short = frequent(table, "n", FREQUENT, F.length("piece") <= LONGEST).select("piece", "pieces").toArrow()
    known = spark.sparkContext.broadcast(
        dict(zip(short.column("piece").to_pylist(), short.column("pieces").to_pylist()))
    )
    shipped = spark.sparkContext.broadcast(model)
    fields = [docs.schema[key].dataType.simpleString(), "bigint", "bigint", "bigint", "binary", "bigint"]
    names = ["k", "line", "n_bytes", "sure", "piece", "times"]

    def frequencies(batches):
        from pyspark import TaskContext

        rules, frequent_pieces = Rules(shipped.value), known.value
        line = TaskContext.get().partitionId() << 33
        for batch in batches:
            for low, high, data, rows in arrays.pieces(leading(batch.column(1))):
                found, before = rules.tokens(data, rows)
                codes, distinct = arrays.coded(found)
                values = distinct.to_pylist()
                pieces = np.array([frequent_pieces.get(v, -1) for v in values], np.int64)[codes]
                sure = arrays.row_sums(np.maximum(pieces, 0), before)
                rare = np.flatnonzero(pieces < 0)
                row = np.searchsorted(before, rare, "right") - 1
                pair, times = np.unique(row * np.int64(max(1, len(values))) + codes[rare], return_counts=True)
                row, code = pair // max(1, len(values)), pair % max(1, len(values))
                n, lines = high - low, np.arange(line, line + high - low)
                line += n
                keys = batch.column(0).slice(low, n)
                size = np.maximum(np.diff(rows) - 1, 0)
                # a row of its own for each document; its key in the join is no pre-token, as it is no UTF-8
                alone = pa.array([b"\xff" + i.to_bytes(8, "big") for i in lines.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(lines), pa.array(size), pa.array(sure), alone, pa.array(np.zeros(n, np.int64))],
                    names,
                )
                if len(pair):
                    none = np.zeros(len(pair), np.int64)
                    rest = distinct.take(pa.array(code)).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(row)), pa.array(lines[row]), pa.array(none), pa.array(none), rest,
                         pa.array(times.astype(np.int64))],
                        names,
                    )

    schema = ", ".join(f"{n} {t}" for n, t in zip(names, fields))
    parts = docs.select(key, text).mapInArrow(frequencies, schema)
    joined = parts.join(table.select("piece", "pieces"), "piece", "left")
    n = F.col("sure") + F.coalesce(F.col("times") * F.col("pieces"), F.lit(0))
    summed = joined.groupBy("k", "line").agg(F.sum("n_bytes").alias("n_bytes"), F.sum(n).alias("n_tokens"))
    return summed.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
