"""Language identification with hyperdimensional profiles.

Method: each letter has a random vector of +1 and -1 (drawn from its code point). A letter trigram is bound by
multiplying its letters' vectors, permuted (rotated) by 2, 1 and 0 places; a document is the bundle (sum) of its
trigrams, a language the bundle of its training documents, each at unit length. The prediction is the language whose
prototype has the largest cosine with the document; that cosine, not below 0, is the score.

Letters are folded to lower case; what is not a letter separates words, and a word is framed by one separator on
either side. Bundles are summed as integers, so that the result does not depend on the order of tasks.

Defined results: `und` with score 0 for a null or empty text, one without letters, or where nothing was learned;
ties go to the name that sorts first; rows without an id count as held out; repeated rows are rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays

DIMENSIONS = 512
#: integer units of a document's unit vector in a prototype's sum
UNITS = 1 << 20
#: cells of one matrix of trigram counts
CELLS = 1 << 22
#: bytes of text that are bundled at once, each of which takes about a hundred bytes of memory
PIECE_BYTES = 1 << 19
UNDETERMINED = "und"
_UNSEEN = np.uint32(0xFFFFFFFF)


class Space:
    """Letter vectors and the bundles of texts."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.letter = np.full(0x110000, _UNSEEN, np.uint32)
        self.vectors: list[np.ndarray] = [self.drawn(0)]

    def drawn(self, code: int) -> np.ndarray:
        bits = np.random.Generator(np.random.PCG64(code)).integers(0, 2, self.dimensions)
        return (2 * bits - 1).astype(np.float32)

    def letters(self, codes: np.ndarray) -> np.ndarray:
        """Number of each code point's letter, 0 for what is none; upper case has the number of lower case."""
        got = self.letter[codes]
        if (got == _UNSEEN).any():
            for c in np.unique(codes[got == _UNSEEN]).tolist():
                low = chr(c).lower()
                low = ord(low) if len(low) == 1 else c
                if not unicodedata.category(chr(low)).startswith("L"):
                    self.letter[c] = 0
                    continue
                if self.letter[low] == _UNSEEN:
                    self.letter[low] = len(self.vectors)
                    self.vectors.append(self.drawn(low))
                self.letter[c] = self.letter[low]
            got = self.letter[codes]
        return got

    def bundles(self, data: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, end row, one vector per row)."""
        n = len(rows) - 1
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        ends = np.searchsorted(at, rows)
        found = self.letters(codes).astype(np.int64)
        row = np.repeat(np.arange(n), np.diff(ends))
        # one separator after each row, so that no trigram crosses to the next row
        spread = np.zeros(len(found) + n + 1, np.int64)
        spread[1 + np.arange(len(found)) + row] = found
        owner = np.zeros(len(spread), np.int64)
        owner[1 + np.arange(len(found)) + row] = row
        keep = np.ones(len(spread), bool)
        keep[1:] = (spread[1:] != 0) | (spread[:-1] != 0)
        spread, owner = spread[keep], owner[keep]
        if len(spread) < 3:
            yield 0, n, np.zeros((n, self.dimensions), np.float32)
            return
        a, b, c = spread[:-2], spread[1:-1], spread[2:]
        middle = b != 0
        owner = owner[1:-1][middle]
        size = len(self.vectors)
        gram = (a[middle] * size + b[middle]) * size + c[middle]
        vectors = np.stack(self.vectors)
        first = 0
        starts = np.searchsorted(owner, np.arange(n + 1))
        while first < n:
            # as many rows as keep rows x distinct trigrams within CELLS, at least one
            end, distinct = n, None
            while True:
                part = gram[starts[first] : starts[end]]
                distinct, code = numbered(part, size)
                if end == first + 1 or (end - first) * len(distinct) <= CELLS:
                    break
                end = max(first + 1, first + min((end - first) // 2, CELLS // max(1, len(distinct)) + 1))
            wide = max(1, len(distinct))
            index = (owner[starts[first] : starts[end]] - first) * wide + code
            out = np.zeros((end - first, self.dimensions), np.float32)
            step = max(1, CELLS // self.dimensions)
            counts = np.bincount(index, minlength=(end - first) * wide).astype(np.float32).reshape(end - first, wide)
            for low in range(0, len(distinct), step):
                g = distinct[low : low + step]
                bound = np.roll(vectors, 2, axis=1)[g // (size * size)]
                bound *= np.roll(vectors, 1, axis=1)[g // size % size]
                bound *= vectors[g % size]
                out += counts[:, low : low + step] @ bound
            yield first, end, out
            first = end


def numbered(grams: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct trigrams in order, number of each trigram among them); a table where the alphabet is small."""
    cells = size**3
    if cells > CELLS:
        return np.unique(grams, return_inverse=True)
    number = np.zeros(cells, np.int32)
    number[grams] = 1
    distinct = np.flatnonzero(number)
    number[distinct] = np.arange(len(distinct))
    return distinct, number[grams]


def held_out(key: str, part: int = 5):
    """True for the rows whose crc32(id as text) is divisible by `part`, and for those without an id."""
    crc = F.crc32(F.col(key).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(part)) == 0, F.lit(True))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict:
    """{language: prototype} of the rows with a language: one vector per language, whatever the number of rows."""

    def bundle(batches):
        space, sums = Space(dimensions), {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for low, _, data, rows in arrays.pieces(batch.column(0), PIECE_BYTES):
                for first, end, vectors in space.bundles(data, rows):
                    length = np.linalg.norm(vectors, axis=1)
                    unit = np.rint(vectors * (UNITS / np.maximum(length, 1e-9))[:, None]).astype(np.int64)
                    mine = np.array(names[low + first : low + end])
                    for name in set(mine.tolist()):
                        part = unit[mine == name].sum(axis=0)
                        sums[name] = sums[name] + part if name in sums else part
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * dimensions), pa.array(np.arange(dimensions)), pa.array(total)], ["l", "d", "v"]
            )

    parts = docs.where(F.col(lang).isNotNull()).select(text, lang).mapInArrow(bundle, "l string, d bigint, v bigint")
    rows = parts.groupBy("l", "d").agg(F.sum("v").alias("v"))
    found = rows.groupBy("l").agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("v")).collect()
    out = {}
    for row in sorted(found, key=lambda r: r["l"]):
        vector = np.array([x["v"] for x in row["v"]], np.float64)
        if vector.any():
            out[row["l"]] = (vector / np.linalg.norm(vector)).astype(np.float32)
    return out


def predict(docs: DataFrame, prototypes: dict, text: str = "text") -> DataFrame:
    """Rows of `docs` with lang_pred and score (columns of these names are replaced)."""
    names = list(prototypes)
    shipped = docs.sparkSession.sparkContext.broadcast(prototypes)
    rest = docs.drop("lang_pred", "score")
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*rest.schema.fields, *added])

    def run(batches):
        matrix = np.stack(list(shipped.value.values())) if names else None
        space = Space(matrix.shape[1] if names else 1)
        choices = np.array([*names, UNDETERMINED], object)
        for batch in batches:
            best = np.full(batch.num_rows, len(names))
            score = np.zeros(batch.num_rows)
            for low, _, data, rows in arrays.pieces(batch.column(batch.schema.get_field_index(text)), PIECE_BYTES):
                for first, end, vectors in space.bundles(data, rows) if names else ():
                    length = np.linalg.norm(vectors, axis=1)
                    cosine = vectors @ matrix.T / np.maximum(length, 1e-9)[:, None]
                    part = slice(low + first, low + end)
                    best[part] = np.where(length > 0, cosine.argmax(axis=1), len(names))
                    score[part] = np.where(length > 0, np.clip(cosine.max(axis=1), 0, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(choices[best].tolist(), pa.string()), pa.array(score)], names=schema.names
            )

    return rest.mapInArrow(run, schema)
