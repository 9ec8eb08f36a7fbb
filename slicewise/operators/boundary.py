"""Scanning across slice boundaries.

A scan works on *windows*: a buffer, the image offset of its first byte, and the half-open range
of offsets it owns. A match belongs to the window that owns its first byte, so each match of an
image is reported once although buffers overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bytes on either side of a boundary that a scan looks at; more than the longest match
MARGIN = 1024

_SLICE = {"offset", "data", "before", "after", "own_from", "own_to", "error"}


def id_columns(slices: DataFrame) -> list[str]:
    """Columns that name the image (and the path inside it); they are carried through a scan."""
    return [c for c in slices.columns if c not in _SLICE]


def windows(slices: DataFrame) -> DataFrame:
    """(ids, base, buffer, own_from, own_to) of any slice table, row by row, without a shuffle.

    Slices with `before`/`after` are scanned with that context, rows of `seams` inside their owned
    range, and plain slices by themselves (a match over a boundary is then not seen).
    """
    ids = id_columns(slices)
    if "own_from" in slices.columns:
        return slices.select(
            *ids, F.col("offset").alias("base"), F.col("data").alias("buffer"), "own_from", "own_to"
        )
    end = F.col("offset") + F.length("data")
    if "before" in slices.columns:
        empty = F.lit(b"")
        before = F.coalesce("before", empty)
        return slices.where(F.col("data").isNotNull()).select(
            *ids,
            (F.col("offset") - F.length(before)).alias("base"),
            F.concat(before, F.col("data"), F.coalesce("after", empty)).alias("buffer"),
            F.col("offset").alias("own_from"),
            end.alias("own_to"),
        )
    return slices.select(
        *ids,
        F.col("offset").alias("base"),
        F.col("data").alias("buffer"),
        F.col("offset").alias("own_from"),
        end.alias("own_to"),
    )


def seams(slices: DataFrame, n: int = MARGIN) -> DataFrame:
    """Windows that cover every boundary of a slice table that was stored without context.

    Only the strips around the boundaries are shuffled (4n bytes per slice), never the slices: a
    slice keeps the middle it can judge alone, and one window per boundary, built of 2n bytes on
    each side, owns the n bytes on each side. Every slice but the last of an image must be at
    least 2n bytes long; use `reslice` for others.
    """
    ids = id_columns(slices)
    size = F.length("data")
    head = F.least(F.lit(n), size.cast("int"))
    head = F.when(size < 2 * n, size).otherwise(head)
    tail = F.when(size < 2 * n, F.lit(0)).otherwise(F.lit(n))
    end = F.col("offset") + size
    # A slice shorter than 2n is the last one: the boundary before it owns all of it.
    middle = slices.where(size > 2 * n).select(
        *ids,
        "offset",
        "data",
        (F.col("offset") + n).alias("own_from"),
        (end - n).alias("own_to"),
    )
    strips = slices.select(
        *ids,
        F.inline(
            F.array(
                F.struct(
                    F.col("offset").alias("seam"),
                    F.lit(None).cast("binary").alias("left"),
                    F.lit(0).alias("left_own"),
                    F.substring("data", F.lit(1), F.lit(2 * n)).alias("right"),
                    head.alias("right_own"),
                ),
                F.struct(
                    end.alias("seam"),
                    F.substring(F.col("data"), F.greatest(size - 2 * n, F.lit(0)) + 1, F.lit(2 * n)).alias("left"),
                    tail.alias("left_own"),
                    F.lit(None).cast("binary").alias("right"),
                    F.lit(0).alias("right_own"),
                ),
            )
        ),
    )
    joined = strips.groupBy(*ids, "seam").agg(
        F.max("left").alias("left"),
        F.max("left_own").alias("left_own"),
        F.max("right").alias("right"),
        F.max("right_own").alias("right_own"),
    )
    left = F.coalesce("left", F.lit(b""))
    boundary = joined.select(
        *ids,
        (F.col("seam") - F.length(left)).alias("offset"),
        F.concat(left, F.coalesce("right", F.lit(b""))).alias("data"),
        (F.col("seam") - F.col("left_own")).alias("own_from"),
        (F.col("seam") + F.col("right_own")).alias("own_to"),
    )
    return middle.unionByName(boundary.where("own_from < own_to"))


def reslice(slices: DataFrame, size: int = 65536, overlap: int = MARGIN) -> DataFrame:
    """Contiguous pieces of any width as slices of `size` bytes with their context.

    All bytes are shuffled once, keyed by (image, range); a group holds at most size + 2 * overlap
    bytes, however large its image is.
    """
    ids = id_columns(slices)
    end = F.col("offset") + F.length("data")
    first = F.call_function("div", F.greatest(F.col("offset") - overlap, F.lit(0)), F.lit(size).cast("long"))
    last = F.call_function("div", end - 1 + overlap, F.lit(size).cast("long"))
    pieces = slices.where(F.length("data") > 0).select(
        *ids, "offset", "data", F.explode(F.sequence(first, last)).alias("range")
    )
    low = F.greatest(F.col("offset"), F.col("range") * size - overlap)
    high = F.least(end, (F.col("range") + 1) * size + overlap)
    cut = F.substring(F.col("data"), (low - F.col("offset") + 1).cast("int"), (high - low).cast("int"))
    pieces = pieces.where(low < high).select(*ids, "range", low.alias("low"), cut.alias("piece"))
    grouped = pieces.groupBy(*ids, "range").agg(
        F.array_sort(F.collect_list(F.struct("low", "piece"))).alias("parts")
    )
    joined = grouped.select(
        *ids,
        "range",
        F.get("parts", F.lit(0))["low"].alias("base"),
        F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["piece"])).alias("buffer"),
    )
    start = F.col("range") * size
    lead = (start - F.col("base")).cast("int")
    return joined.where(start < F.col("base") + F.length("buffer")).select(
        *ids,
        F.greatest(start, F.col("base")).alias("offset"),
        _between("buffer", F.greatest(lead, F.lit(0)), F.lit(size) + F.least(lead, F.lit(0))).alias("data"),
        _between("buffer", F.lit(0), F.greatest(lead, F.lit(0))).alias("before"),
        _between("buffer", lead + size, F.lit(overlap)).alias("after"),
    )


def _between(buffer: str, start: Column, length: Column) -> Column:
    return F.substring(F.col(buffer), start + 1, length)


def with_overlap(slices: DataFrame, n: int = MARGIN) -> DataFrame:
    """A slice table made safe to scan over its boundaries; see `seams`."""
    return seams(slices, n)


def own(matches: DataFrame) -> DataFrame:
    """Drop matches whose first byte another window owns."""
    position = F.col("position")
    return matches.where((position >= F.col("own_from")) & (position < F.col("own_to")))
