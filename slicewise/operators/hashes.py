"""Block hashes and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digest import BLOCK, block_md5
from .boundary import id_columns

#: largest sub-count kept per (hash, source)
CLIP = 65535


def block_hashes(slices: DataFrame, size: int = BLOCK) -> DataFrame:
    """(ids, block_md5, offset) of every whole block; an incomplete block at the end has none.

    Slices must start at multiples of `size`, which is checked; any but the last one of an image should
    be as wide as a multiple, or the blocks over its end are missed. One generator inside a code-generated stage; the
    slice is referenced by its rows, not copied.
    """
    ids = id_columns(slices)
    aligned = F.when(F.col("offset") % size == 0, F.col("offset"))
    offset = F.coalesce(aligned, F.raise_error(F.lit(f"a slice does not start at a multiple of {size}")).cast("long"))
    blocks = slices.where(F.length("data") >= size).select(
        *ids,
        offset.alias("offset"),
        "data",
        F.explode(F.expr(f"sequence(0, cast(length(data) div {size} as int) - 1)")).alias("k"),
    )
    return blocks.select(
        *ids,
        block_md5(F.substring(F.col("data"), F.col("k") * size + 1, F.lit(size))).alias("block_md5"),
        (F.col("offset") + F.col("k") * size).alias("offset"),
    )


def hash_counts(blocks: DataFrame, source: str = "image", clip: int = CLIP) -> DataFrame:
    """How often each hash was seen in each source, clipped, and whether clipping happened."""
    counts = blocks.groupBy("block_md5", source).agg(F.count("*").alias("seen"))
    return counts.select(
        "block_md5",
        source,
        F.least("seen", F.lit(clip).cast("long")).alias("sub_count"),
        (F.col("seen") > clip).alias("clipped"),
    )


def hash_totals(blocks: DataFrame, source: str = "image") -> DataFrame:
    """How often each hash was seen in all, and in how many sources."""
    per_source = blocks.groupBy("block_md5", source).agg(F.count("*").alias("seen"))
    return per_source.groupBy("block_md5").agg(
        F.sum("seen").alias("total"), F.count("*").alias("sources")
    )
