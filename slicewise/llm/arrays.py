"""Vectorised text helpers: words, hashes and dictionary codes of Arrow string columns.

Everything works on the UTF-8 bytes of many texts at once, in pieces of bounded size, inside a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text that are worked on at once; a longer text makes a piece of its own
PIECE_BYTES = 3 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words(data: np.ndarray, rows: np.ndarray, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of the rows: (binary array of all words, number of words before each row)."""
    if len(data) == 0:
        return pa.array([], pa.large_binary()), np.zeros(len(rows), np.int64)
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[0] = False
    cuts = rows[:-1][rows[:-1] < len(data)]
    before[cuts] = False
    first = inside & ~before
    packed = (_LOWER[data] if lower else data)[inside]
    starts = np.flatnonzero(first[inside])
    at = np.concatenate([starts, [len(packed)]]).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(packed))]
    )
    counts = np.concatenate([[0], np.cumsum(first)])
    return found, counts[rows]


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the values and the distinct values they stand for."""
    encoded = values.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = n + (n >> 1)  # follows the pieces, so that small ones need no large tables
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base & _MASK, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.multiply.accumulate(factors)
    return _POWERS["up"], _POWERS["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the finishing steps of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each binary value, the same in every process."""
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        plain = (sums[at[1:]] - sums[at[:-1]]) * down[at[:-1]]
        return mixed(plain + np.uint64(_BASE) * np.diff(at).astype(np.uint64))


def row_sums(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sums of the values of each row; `before` counts the values before each row."""
    sums = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return sums[before[1:]] - sums[before[:-1]]
