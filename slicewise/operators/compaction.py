"""Keyed tables that are read and put to while their puts are merged.

A manifest in the table's folder `_manifest` names the puts that a compacted one stands for; readers take the newest
manifest and leave those puts out by partition pruning, so what a read merges is one sorted put and those that came
after it. Old puts stay until `vacuum`, for readers that began under an older manifest.

A compacted cell keeps the batch and the put it came from, so later puts win or lose as they would have against the
original ones. A put repeated under its name after it was merged goes into the table beside what it wrote first: its
cells win, and those it no longer has stay. A compaction takes in the puts that are complete when it begins; run it
where no put of the same table is being written (after a micro-batch). Of two at once, one fails and leaves no trace in
what is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.rawimage import open_filesystem
from .cells import KEY
from .manifest import ENTRIES, MANIFEST, inside, merged_puts

STORED = "row_key string, family string, qualifier string, value string, batch bigint, origin string, put string"


def live_puts(spark: SparkSession, table: str) -> DataFrame:
    """The cells of all puts that no compacted put stands for."""
    merged, _ = merged_puts(spark, table)
    puts = spark.read.schema(STORED).parquet(table)
    return puts.where(~F.col("put").isin(merged)) if merged else puts


def compact_live(spark: SparkSession, table: str, partitions: int = 200) -> int:
    """Merge the live puts into one, sorted by key, under a new manifest; the number of puts merged.

    Each task merges a range of keys, after a map-side combine; nothing but names of puts is on the driver. With fewer
    than two live puts nothing is written.
    """
    _, version = merged_puts(spark, table)
    cells = live_puts(spark, table)
    names = [r.put for r in cells.select("put").distinct().collect()]
    if len(names) < 2:
        return 0
    into = f"compacted-{version + 1:08d}-{uuid.uuid4().hex[:8]}"
    newest = F.struct("batch", F.coalesce("origin", "put").alias("origin"), "value")
    won = cells.where(F.col("put").isin(names)).groupBy(*KEY).agg(F.max(newest).alias("won"))
    rows = won.select(*KEY, "won.value", "won.batch", "won.origin")
    rows.repartitionByRange(partitions, *KEY).sortWithinPartitions(*KEY).write.parquet(inside(table, f"put={into}"))
    entries = spark.createDataFrame([(n, into, version + 1) for n in names], ENTRIES)
    entries.coalesce(1).write.mode("errorifexists").json(inside(table, MANIFEST, f"v={version + 1:08d}"))
    return len(names)


def vacuum(spark: SparkSession, table: str) -> list[str]:
    """Delete the folders of merged puts, once no reader of an older manifest is left; the names deleted.

    The manifest stays, so that a put repeated later under the name of a merged one is still known as such.
    """
    from pyarrow import fs

    filesystem, inner = open_filesystem(table)
    there = {f.base_name for f in filesystem.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.Directory}
    gone = [name for name in merged_puts(spark, table)[0] if f"put={name}" in there]
    for name in gone:
        filesystem.delete_dir(f"{inner.rstrip('/')}/put={name}")
    return gone
