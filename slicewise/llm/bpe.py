"""BPE encoding and decoding of whole texts with a byte-level vocabulary.

Method: a segment tree over the ranks of adjacent pairs. A leaf holds (rank, position) of the pair that begins at
its symbol, an inner node the least of its two children; so the root is the leftmost pair of the lowest rank. A
merge changes three leaves (its own, that of the symbol it swallows, that of its predecessor), each with one walk to
the root. It ends when the root says that no pair can be merged. The trees of many pre-tokens of like length are
worked on together, as rows of one matrix.

Texts are cut into pre-tokens by the class of each code point, each distinct pre-token of a task is encoded once, and
the ids of a document are put together from theirs. Special tokens of the vocabulary that occur inside a text stand
for themselves, as the library has it by default.

Defined results: a null or empty text has no tokens; repeated rows give repeated results; any columns may stand
beside `text` and are kept, unless they bear the name of a result column, which is then replaced.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays

LETTER, NUMBER, SPACE, OTHER, SPECIAL, UNKNOWN = 1, 2, 3, 0, 5, 255
NONE = np.int64(1) << 62
#: cells of one matrix of trees
CELLS = 1 << 21
#: distinct pre-tokens kept by a task
KEPT = 1 << 18
#: bytes of text that are worked on at once
PIECE_BYTES = 1 << 20

# Code points with the property White_Space.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Endings that are tokens of their own after an apostrophe.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable}
    for k, b in enumerate(b for b in range(256) if b not in set(printable)):
        letters[chr(256 + k)] = b
    return letters


class Vocabulary:
    """Ids, merge ranks and special tokens of a tokenizer file, as arrays."""

    def __init__(self, source: str):
        spec = json.loads(source)
        letters, model = byte_letters(), spec["model"]
        ids = model["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        size = 1 + max(*ids.values(), *self.special.values())
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for content, i in self.special.items():
            self.bytes_of[i] = content
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_id[b] = ids[letter]
        self.width = np.int64(size)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] * size + ids[b] for a, b in pairs] or [-1], np.int64)
        made = np.array([ids[a + b] for a, b in pairs] or [0], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_at, self.made = keys[order], order.astype(np.int64), made

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, or NONE."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_at[at], NONE)


class Trees:
    """Segment trees of n rows with the same number of leaves."""

    def __init__(self, leaves: np.ndarray):
        n, width = leaves.shape
        self.width = width
        self.node = np.full((n, 2 * width), NONE, np.int64)
        self.node[:, width:] = leaves
        for i in range(width - 1, 0, -1):
            self.node[:, i] = np.minimum(self.node[:, 2 * i], self.node[:, 2 * i + 1])

    def root(self, rows: np.ndarray) -> np.ndarray:
        return self.node[rows, 1]

    def put(self, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        at = leaf + self.width
        self.node[rows, at] = value
        while self.width > 1 and at[0] > 1:
            at = at >> 1
            self.node[rows, at] = np.minimum(self.node[rows, 2 * at], self.node[rows, 2 * at + 1])


def merged(symbols: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids after all merges, row by row: (all ids in order, number of ids of each row)."""
    n, width = symbols.shape
    shift = np.int64(max(1, width.bit_length()))
    position = np.arange(width, dtype=np.int64)

    def leaf(rank, at):
        return np.where(rank == NONE, NONE, (rank << shift) | at)

    leaves = np.full((n, width), NONE, np.int64)
    if width > 1:
        known = position[None, :-1] + 1 < lengths[:, None]
        rank = np.where(known, vocabulary.ranks(symbols[:, :-1], symbols[:, 1:]), NONE)
        leaves[:, :-1] = leaf(rank, position[None, :-1])
    trees = Trees(leaves)
    following = np.broadcast_to(position + 1, (n, width)).copy()
    preceding = np.broadcast_to(position - 1, (n, width)).copy()
    live = position[None, :] < lengths[:, None]
    rows = np.arange(n)
    while True:
        top = trees.root(rows)
        rows, top = rows[top < NONE], top[top < NONE]
        if not len(rows):
            break
        i = top & ((np.int64(1) << shift) - 1)
        j = following[rows, i]
        symbols[rows, i] = new = vocabulary.made[top >> shift]
        live[rows, j] = False
        k = following[rows, j]
        following[rows, i] = k
        more = k < lengths[rows]
        preceding[rows[more], k[more]] = i[more]
        rank = np.where(more, vocabulary.ranks(new, symbols[rows, np.minimum(k, width - 1)]), NONE)
        trees.put(rows, i, leaf(rank, i))
        trees.put(rows, j, np.full(len(rows), NONE))
        p = preceding[rows, i]
        back = p >= 0
        if back.any():
            r, p = rows[back], p[back]
            trees.put(r, p, leaf(vocabulary.ranks(symbols[r, p], new[back]), p))
    return symbols[live], live.sum(axis=1)


def encode_pieces(values: list[bytes], vocabulary: Vocabulary) -> list[np.ndarray]:
    """Ids of each pre-token."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(values)
    lengths = np.array([len(v) for v in values], np.int64)
    widths = np.int64(1) << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64)
    for width in np.unique(widths):
        members = np.flatnonzero((widths == width) & (lengths > 0))
        step = max(1, CELLS // (2 * int(width)))
        for at in range(0, len(members), step):
            part = members[at : at + step]
            data = np.frombuffer(b"".join([values[k].ljust(int(width), b"\0") for k in part]), np.uint8)
            symbols = vocabulary.byte_id[data].reshape(len(part), int(width))
            ids, counts = merged(symbols, lengths[part], vocabulary)
            for k, got in zip(part, np.split(ids, np.cumsum(counts)[:-1])):
                out[k] = got
    return out


class Cutter:
    """Cuts texts into pre-tokens by the classes of their code points."""

    def __init__(self, special: dict[bytes, int]):
        self.special = sorted(special, key=len, reverse=True)
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.classes[WHITE] = SPACE

    def kinds(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.classes[codes]
        if (kinds == UNKNOWN).any():
            for c in np.unique(codes[kinds == UNKNOWN]):
                category = unicodedata.category(chr(c))[0]
                self.classes[c] = {"L": LETTER, "N": NUMBER}.get(category, OTHER)
            kinds = self.classes[codes]
        return kinds

    def specials(self, data: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
        """Byte ranges of special tokens, none of which crosses a row's end or another one."""
        text, found = data.tobytes(), []
        for token in self.special:
            at = text.find(token)
            while at >= 0:
                end = at + len(token)
                row = np.searchsorted(rows, at, "right")
                free = not any(a < end and at < b for a, b in found)
                inside = end <= rows[row] and free
                if inside:
                    found.append((at, end))
                at = text.find(token, end if inside else at + 1)
        return sorted(found)

    def starts(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Byte positions at which pre-tokens begin; rows and special tokens are never joined with others."""
        if not len(data):
            return np.zeros(0, np.int64)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kinds = self.kinds(codes).copy()
        n = len(codes)
        hard = np.zeros(n + 1, bool)
        hard[n] = True
        hard[np.searchsorted(at, rows[:-1][rows[:-1] < len(data)])] = True
        for a, b in self.specials(data, rows):
            low, high = np.searchsorted(at, [a, b])
            kinds[low:high] = SPECIAL
            hard[[low, high]] = True
        run = hard[:n].copy()
        run[1:] |= kinds[1:] != kinds[:-1]
        begin = run.copy()
        last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & ~hard[1:n])
        begin[last] = True
        begin[last[codes[last] == 0x20] + 1] = False
        quote = np.flatnonzero((codes == 0x27) & run & begin)
        quote = quote[quote + 1 < n]
        quote = quote[(kinds[quote + 1] == LETTER) & ~hard[quote + 1]]
        for ending in ENDINGS:
            fits = np.ones(len(quote), bool)
            for k, c in enumerate(ending, 1):
                place = np.minimum(quote + k, n - 1)
                fits &= (quote + k < n) & (codes[place] == ord(c))
                if k > 1:
                    fits &= ~run[place]
            hit = quote[fits]
            begin[hit + 1] = False
            rest = hit + len(ending) + 1
            rest = rest[rest < n]
            begin[rest[(kinds[rest] == LETTER) & ~run[rest]]] = True
        return at[begin]


class Encoder:
    """Pre-tokens of a task and their ids, each worked out once."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.cutter = vocabulary, Cutter(vocabulary.special)
        self.known: dict[bytes, tuple[bytes, int, bytes, bytes]] = {}

    def learn(self, values: list[bytes]) -> None:
        if len(self.known) > KEPT:
            self.known.clear()
        new = [v for v in values if v not in self.known and v not in self.vocabulary.special]
        parts = self.vocabulary.bytes_of
        for value, ids in zip(new, encode_pieces(new, self.vocabulary)):
            listed = ids.tolist()
            text = ",".join(map(str, listed)).encode()
            plain = b"".join([parts[i] for i in listed])
            self.known[value] = (text, len(listed), value if plain == value else plain, ids.astype(np.int32).tobytes())
        for content, i in self.vocabulary.special.items():
            self.known[content] = (str(i).encode(), 1, parts[i], np.array([i], np.int32).tobytes())

    def looked_up(self, data: np.ndarray, rows: np.ndarray) -> tuple[pa.Array, np.ndarray, list[tuple]]:
        """(code of each pre-token, number of pre-tokens before each row, what is known of each code)."""
        starts = self.cutter.starts(data, rows)
        bounds = np.concatenate([starts, [len(data)]]).astype(np.int64)
        tokens = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]
        )
        codes, distinct = arrays.coded(tokens)
        values = distinct.to_pylist()
        self.learn(values)
        return pa.array(codes), np.searchsorted(starts, rows), [self.known[v] for v in values]

    def texts(self, looked_up: tuple) -> Iterator[tuple[int, memoryview, memoryview]]:
        """(number of ids, ids joined by commas, decoded bytes) of each row."""
        codes, before, found = looked_up
        counts = np.array([f[1] for f in found], np.int64)[codes.to_numpy()] if found else np.zeros(0, np.int64)
        ids = pa.array([f[0] for f in found], pa.binary()).take(codes)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(before, pa.int32()), ids), b",")
        plain = pa.array([f[2] for f in found], pa.large_binary()).take(codes)
        _, offsets, content = plain.buffers()
        ends = np.frombuffer(offsets, np.int64)
        view = memoryview(content) if content is not None else memoryview(b"")
        sums = arrays.row_sums(counts, before)
        for k in range(len(before) - 1):
            yield int(sums[k]), joined[k].as_buffer(), view[ends[before[k]] : ends[before[k + 1]]]

    def lists(self, looked_up: tuple) -> pa.Array:
        """The ids of each row."""
        codes, before, found = looked_up
        ends = np.concatenate([[0], np.cumsum([f[1] for f in found])]).astype(np.int64)
        known = pa.array(np.frombuffer(b"".join([f[3] for f in found]), np.int32))
        ids = pa.LargeListArray.from_arrays(pa.array(ends), known).take(codes)
        return pa.ListArray.from_arrays(pa.array(ids.offsets.to_numpy()[before], pa.int32()), ids.values)


def encode(docs: DataFrame, source: str, text: str = "text", ids: bool = False, decode: bool = False):
    """Rows of `docs` with n_tokens, ids_sha256, decoded_sha256 and, if asked for, `ids` and the `decoded` text.

    `source` is the content of the tokenizer file; it is sent along with the tasks (a vocabulary is a fixed small
    model, not data). The digests are of the ids in decimal joined by commas and of the decoded bytes.
    """
    added = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    added += [("ids", T.ArrayType(T.IntegerType()))] if ids else []
    added += [("decoded", T.StringType())] if decode else []
    clash = {name for name, _ in added}
    names = [c for c in docs.columns if c not in clash]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(n, t) for n, t in added])
    shipped = docs.sparkSession.sparkContext.broadcast(source)

    def run(batches):
        encoder = Encoder(Vocabulary(shipped.value))
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for low, high, data, rows in arrays.pieces(column, PIECE_BYTES):
                n, digest, back, decoded = [], [], [], []
                got = encoder.looked_up(data, rows)
                for count, joined, plain in encoder.texts(got):
                    n.append(count)
                    digest.append(hashlib.sha256(joined).hexdigest())
                    back.append(hashlib.sha256(plain).hexdigest())
                    if decode:
                        decoded.append(bytes(plain).decode("utf-8", "replace"))
                columns = [batch.column(k).slice(low, high - low) for k in range(len(names))]
                columns += [pa.array(n, pa.int64()), pa.array(digest), pa.array(back)]
                columns += [encoder.lists(got)] if ids else []
                columns += [pa.array(decoded, pa.string())] if decode else []
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *[name for name, _ in added]])

    return docs.select(*names, F.col(text).alias("_text")).mapInArrow(run, schema)
