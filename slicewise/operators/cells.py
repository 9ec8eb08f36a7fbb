"""Keyed tables: cells (row_key, family, qualifier, value) on Parquet.

A put is a folder of the table with a name of its own, so it never touches the cells of others; a
later put of the same (row_key, family, qualifier) hides the earlier one when the table is read.
Putting again under the same name replaces that put alone, which makes a retried put harmless.
"""

from __future__ import annotations

import re
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digest import SHARD_BYTES, shard
from .manifest import merged_puts

# Column family of all tables; the layouts below join their parts with commas.
KEY = ("row_key", "family", "qualifier")
FAMILY = "f"


def _cells(df: DataFrame, row: Column, qualifier: Column, value: Column) -> DataFrame:
    return df.select(
        row.alias("row_key"),
        F.lit(FAMILY).alias("family"),
        qualifier.alias("qualifier"),
        value.alias("value"),
    )


def _pair(first: str, second: str) -> Column:
    return F.concat_ws(",", F.col(first).cast("string"), F.col(second).cast("string"))


def cells_email_to_image(features: DataFrame) -> DataFrame:
    """address → (image, offset)"""
    return _cells(features, F.col("feature"), _pair("image", "offset"), F.lit(""))


def cells_image_to_email(features: DataFrame) -> DataFrame:
    """(email, image, offset) → address, with its context as value"""
    row = F.concat_ws(",", F.lit("email"), F.col("image").cast("string"), F.col("offset").cast("string"))
    return _cells(features, row, F.col("feature"), F.col("context"))


def cells_media_to_block(blocks: DataFrame, k: int = SHARD_BYTES) -> DataFrame:
    """image ‖ offset range → (block, offset)"""
    row = F.concat(F.col("image").cast("string"), shard(F.col("offset"), k).cast("string"))
    return _cells(blocks, row, _pair("block_md5", "offset"), F.lit(""))


def cells_block_to_media(blocks: DataFrame) -> DataFrame:
    """block → (image, offset)"""
    return _cells(blocks, F.col("block_md5"), _pair("image", "offset"), F.lit(""))


def cells_artifacts_by_image(features: DataFrame) -> DataFrame:
    """(email, image) → offset, with the address as value"""
    row = F.concat_ws(",", F.lit("email"), F.col("image").cast("string"))
    return _cells(features, row, F.col("offset").cast("string"), F.col("feature"))


def rows_by_class(artifacts: DataFrame) -> DataFrame:
    """artifact → (filename, file_offset, recursion_path), to be stored by artifact_class"""
    return artifacts.select(
        "artifact_class",
        "artifact",
        F.col("stream_name").alias("filename"),
        F.col("offset").alias("file_offset"),
        F.col("recursion_prefix").alias("recursion_path"),
    )


def keyed_put(cells: DataFrame, table: str, batch: int | None = None, put: str | None = None) -> None:
    """Put cells into the table; a put of a higher `batch` wins, of equal ones the put whose name sorts last.

    `put` names the put: the same name again replaces it (also by nothing, if there are no cells this
    time). Without a name it gets one that no other put has; without a batch, the time in microseconds.
    The name of a put that `compaction` has merged is not used again: the cells go in beside it.
    """
    batch = time.time_ns() // 1000 if batch is None else batch
    name = re.sub(r"[^A-Za-z0-9-]", "-", put or uuid.uuid4().hex)
    if put is not None and name in merged_puts(cells.sparkSession, table)[0]:
        name = f"{name}-again-{uuid.uuid4().hex}"
    rows = collapse(cells).withColumn("batch", F.lit(batch).cast("long"))
    rows.sortWithinPartitions(*KEY).write.mode("overwrite").parquet(f"{table.rstrip('/')}/put={name}")


def latest(puts: DataFrame) -> DataFrame:
    """The current value of each cell; combined map-side before its shuffle."""
    put = F.coalesce("origin", "put") if "origin" in puts.columns else F.col("put")
    return puts.groupBy(*KEY).agg(F.max_by("value", F.struct("batch", put.alias("put"))).alias("value"))


def upsert(current: DataFrame, put: DataFrame) -> DataFrame:
    """Cells after a put, without a table: the put wins."""
    both = current.withColumn("batch", F.lit(0)).unionByName(put.withColumn("batch", F.lit(1)))
    return both.groupBy(*KEY).agg(F.max_by("value", F.struct("batch", "value")).alias("value"))


def compact(puts: DataFrame, table: str, buckets: int = 200) -> None:
    """Write the current cells into a new table directory, range-partitioned and sorted by key."""
    (
        latest(puts)
        .withColumn("batch", F.lit(0).cast("long"))
        .repartitionByRange(buckets, *KEY)
        .sortWithinPartitions(*KEY)
        .write.mode("errorifexists")
        .parquet(f"{table.rstrip('/')}/put=compacted")
    )


def save_bucketed(cells: DataFrame, name: str, buckets: int = 200) -> None:
    """Save as a catalog table bucketed and sorted by row key, for joins without a shuffle."""
    cells.write.mode("errorifexists").bucketBy(buckets, "row_key").sortBy("row_key").saveAsTable(name)


def collapse(cells: DataFrame) -> DataFrame:
    """One cell per key; of several values of one put the greatest is taken."""
    return cells.groupBy(*KEY).agg(F.max("value").alias("value"))


def row_filter(
    cells: DataFrame,
    eq: dict[str, str] | None = None,
    lt: dict[str, str] | None = None,
    prefix: dict[str, str] | None = None,
) -> DataFrame:
    """Cells whose columns are equal to, less than or begin with a value; all reach the scan.

    Strings compare by their UTF-8 bytes.
    """
    conditions = [F.col(c) == v for c, v in (eq or {}).items()]
    conditions += [F.col(c) < v for c, v in (lt or {}).items()]
    conditions += [F.col(c).startswith(v) for c, v in (prefix or {}).items()]
    return cells.where(reduce(lambda a, b: a & b, conditions)) if conditions else cells
