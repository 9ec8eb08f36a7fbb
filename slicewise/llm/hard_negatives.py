"""Hard negatives by exact scores: Four-Russians tables of the anchors, indexed with bit planes of the candidates.

Method: components become whole numbers floor(SCALE x). A candidate is kept as bit planes: for each bit of its numbers
(two's complement) and each group of eight dimensions one byte, its bits being those of the eight numbers. For an anchor
and a group, a table of 256 entries holds the sum of the anchor's numbers over every subset of the eight dimensions. So
a plane's part of the inner product is one lookup for each group; planes are added by doubling, from the sign down. The
scores are exact and full: every candidate is scored with every anchor.

Candidates are packed by tasks once and written. Anchors come in blocks of ANCHORS, whatever their number; a block is
broadcast and each task scores its candidates, keeping for every anchor the first POSITIVES rows of its label, and in a
second pass, for every positive, the first NEGATIVES rows of other labels whose scores lie in its window. What tasks
keep is merged by a window of a few rows from each task. No pair of an anchor and a candidate leaves a task otherwise.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part. An anchor's
positives and negatives are other rows, so a row that repeats an anchor's id and vector counts; ties go to the smaller
id, and rows that tie in both are alike in the result. Repeated anchors give results of their own. Shorter vectors count
as filled up with zeros. An anchor without positives, or a positive without negatives, gives no row; a positive with a
negative score has an empty window. Scores that may pass 64 bits are an error. An empty table gives an empty one. Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: the window of negatives, in percent of the positive's score
LOW, HIGH = 80, 100
#: anchors that are scored in one pass, those whose tables a task holds at once, and candidates scored at once
ANCHORS, HELD, ROWS = 8192, 256, 1024
_NONE = np.iinfo(np.int64).min


def numbers(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, x) of the rows that take part, components as whole numbers."""
    v = F.transform(vector, lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    wide = F.exists("v", lambda x: F.abs(x) >= F.lit(2.0**62 / SCALE))
    whole = F.transform("v", lambda x: F.floor(x * SCALE).cast("long"))
    checked = F.when(wide, F.raise_error(F.lit("a component passes 64 bits")).cast("array<bigint>")).otherwise(whole)
    return rows.where("id is not null and label is not null and v is not null").where(finite).select("id", "label", checked.alias("x"))


def planes(x: np.ndarray, bits: int) -> np.ndarray:
    """Bytes (rows, bits, groups) of whole numbers (rows, 8 * groups); byte bit i is dimension i of its group."""
    found = np.empty((len(x), bits, x.shape[1] // 8), np.uint8)
    for b in range(bits):
        found[:, b] = np.packbits(((x >> b) & 1).astype(np.uint8), axis=1, bitorder="little")
    return found


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    found = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    found[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy()
    return found


def packed(rows: DataFrame, width: int, bits: int) -> DataFrame:
    """(row, id, label, bytes) of the candidates."""

    def run(batches):
        for batch in batches:
            made = planes(matrix(batch.column(3), width), bits)
            kept = [p.tobytes() for p in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(kept, pa.binary())], ["row", "id", "label", "bytes"]
            )

    return rows.select("row", "id", "label", "x").mapInArrow(run, "row bigint, id bigint, label bigint, bytes binary")


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Tables (groups, 256, anchors): the sums of an anchor's numbers over the subsets of each group's dimensions."""
    n, width = anchors.shape
    tables = np.zeros((width // 8, 256, n), np.int64)
    for g in range(width // 8):
        for i in range(8):
            tables[g, 1 << i : 2 << i] = tables[g, : 1 << i] + anchors[:, 8 * g + i]
    small = np.abs(anchors.astype(np.float64)).sum(axis=1).max(initial=0) < 2**31
    return tables.astype(np.int32) if small else tables


def scores(tables: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
    """Inner products (candidates, anchors) by lookups and shifts."""
    n, bits, groups = bytes_.shape
    total = np.zeros((n, tables.shape[2]), np.int64)
    part = np.empty((n, tables.shape[2]), tables.dtype)
    step = np.empty_like(part)
    for b in range(bits - 1, -1, -1):
        part[:] = 0
        for g in range(groups):
            np.take(tables[g], bytes_[:, b, g], axis=0, out=step)
            part += step
        total <<= 1
        if b == bits - 1:  # the plane of the sign
            total -= part
        else:
            total += part
    return total


class _Best:
    """The first `most` (score, id) of each slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, most: int):
        self.most = most
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        #: scores that are still of use
        self.least = np.full(slots, _NONE)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = (np.concatenate(p) for p in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.concatenate([first, [len(slot)]])))
        last = place == self.most - 1
        self.least[slot[last]] = score[last]
        keep = place < self.most
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]


def _kept(best: _Best, anchor: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """(anchor, place, id, score) of what a task has kept."""
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor[best.slot]), pa.array(place[best.slot]), pa.array(best.id), pa.array(best.score)],
        ["anchor", "place", "id", "score"],
    )


_KEPT = "anchor bigint, place int, id bigint, score bigint"


def _blocks(batches, bits: int, groups: int):
    """(row, id, label, bytes) of at most ROWS candidates at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            row, ids, label = (part.column(k).to_numpy() for k in range(3))
            joined = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8)
            yield row, ids, label, joined.reshape(len(row), bits, groups)


def positives(candidates: DataFrame, anchors: tuple, bits: int, most: int) -> DataFrame:
    """The first rows with an anchor's label; place counts them from 0."""
    shipped = candidates.sparkSession.sparkContext.broadcast(anchors)
    groups = anchors[2].shape[1] // 8

    def run(batches):
        row, label, x = shipped.value
        best = [_Best(len(row[k : k + HELD]), most) for k in range(0, len(row), HELD)]
        tables = [subset_sums(x[k : k + HELD]) for k in range(0, len(row), HELD)] if len(row) <= 4 * HELD else None
        for theirs, ids, labels, bytes_ in _blocks(batches, bits, groups):
            for k, held in enumerate(best):
                low = k * HELD
                found = scores(tables[k] if tables else subset_sums(x[low : low + HELD]), bytes_)
                ok = (labels[:, None] == label[low : low + HELD]) & (theirs[:, None] != row[low : low + HELD])
                at, slot = np.nonzero(ok & (found >= held.least))
                held.add(slot, found[at, slot], ids[at])
        for k, held in enumerate(best):
            yield _kept(held, row[k * HELD : (k + 1) * HELD], np.zeros(len(held.least), np.int32))

    kept = candidates.mapInArrow(run, _KEPT)
    order = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    return kept.withColumn("place", order - 1).where(F.col("place") < most)


def negatives(candidates: DataFrame, anchors: tuple, found: tuple, bits: int, most: int) -> DataFrame:
    """The first rows of other labels whose score lies in the window of an anchor's positive."""
    shipped = candidates.sparkSession.sparkContext.broadcast((anchors, found))
    groups = anchors[2].shape[1] // 8

    def run(batches):
        (row, label, x), high = shipped.value
        places = high.shape[1]
        # the least score of the window: LOW * positive <= HIGH * negative
        low_score = -((-LOW * high) // HIGH)
        spans = [slice(k, k + HELD) for k in range(0, len(row), HELD)]
        best = [_Best(places * len(row[s]), most) for s in spans]
        for held, s in zip(best, spans):
            held.least[:] = low_score[s].ravel()
        tables = [subset_sums(x[s]) for s in spans] if len(row) <= 4 * HELD else None
        for _, ids, labels, bytes_ in _blocks(batches, bits, groups):
            for k, (held, s) in enumerate(zip(best, spans)):
                got = scores(tables[k] if tables else subset_sums(x[s]), bytes_)
                other = labels[:, None] != label[s]
                slots = held.least.reshape(-1, places)
                for p in range(places):
                    at, slot = np.nonzero(other & (got <= high[s, p]) & (got >= slots[:, p]))
                    held.add(slot * places + p, got[at, slot], ids[at])
        for held, s in zip(best, spans):
            yield _kept(held, np.repeat(row[s], places), np.tile(np.arange(places, dtype=np.int32), len(row[s])))

    kept = candidates.mapInArrow(run, _KEPT)
    order = F.row_number().over(W.partitionBy("anchor", "place").orderBy(F.desc("score"), "id"))
    return kept.withColumn("rank", order).where(F.col("rank") <= most)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); `is_anchor` is over `id`."""
    spark = vectors.sparkSession
    rows = numbers(vectors, key, vector, label).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "numbers")
    zero = F.lit(0).cast("bigint")
    top = F.greatest(F.coalesce(F.array_max("x"), zero), -F.coalesce(F.array_min("x"), zero))
    size = rows.agg(F.max(F.size("x")).alias("width"), F.max(top).alias("top"), F.count_if(is_anchor).alias("anchors")).first()
    width = -(-max(size["width"] or 0, 1) // 8) * 8
    bits = int(size["top"] or 0).bit_length() + 1
    if int(size["top"] or 0) ** 2 * width >= 1 << 63:
        raise ValueError("inner products may pass 64 bits")
    candidates = stored(packed(rows, width, bits), "planes")
    parts = -(-size["anchors"] // ANCHORS)
    chosen = rows.where(is_anchor).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(parts, 1))))
    results = []
    for block in range(parts):
        held = chosen.where(F.col("block") == block).select("row", "id", "label", "x").toArrow()
        if not held.num_rows:
            continue
        anchors = (held["row"].to_numpy(), held["label"].to_numpy(), matrix(held["x"], width))
        good = stored(positives(candidates, anchors, bits, n_positives), "positives")
        listed = good.select("anchor", "place", "score").toArrow()  # n_positives rows for each anchor of the block
        order = np.argsort(anchors[0], kind="stable")
        at = order[np.searchsorted(anchors[0], listed["anchor"].to_numpy(), sorter=order)]
        high = np.full((held.num_rows, n_positives), -1, np.int64)  # no score lies in the window of a negative one
        high[at, listed["place"].to_numpy()] = listed["score"].to_numpy()
        bad = negatives(candidates, anchors, high, bits, n_negatives)
        named = good.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        found = bad.select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        results.append(stored(found.join(named, ["anchor", "place"]), "negatives"))
    ids = rows.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not results:
        empty = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        return spark.createDataFrame([], empty)
    every = results[0]
    for more in results[1:]:
        every = every.unionByName(more)
    return every.join(ids, "anchor").select(*columns)
