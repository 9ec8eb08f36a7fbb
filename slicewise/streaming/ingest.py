"""Incremental ingest of new slice files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.boundary import MARGIN
from ..operators.cells import cells_email_to_image, keyed_put
from ..operators.compaction import compact_live
from ..operators.scanners import scan_email
from ..sources.rawstream import TRIGGER_BYTES, RawStreamSource

SLICE_SCHEMA = "image string, offset bigint, data binary, before binary, after binary"


def email_cells(slices: DataFrame) -> DataFrame:
    return cells_email_to_image(scan_email(slices))


def ingest_stream(
    spark: SparkSession,
    src: str,
    table: str,
    checkpoint: str,
    to_cells: Callable[[DataFrame], DataFrame] = email_cells,
    max_files: int = 1000,
) -> StreamingQuery:
    """Scan the slice files that are new under `src` and put their cells, then stop.

    The checkpoint remembers the files taken in. A micro-batch puts its cells under the name of the
    checkpoint and its number: run again after a failure it replaces what it had written, and streams
    with other checkpoints have other puts.
    """
    name = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:24]

    slices = spark.readStream.schema(SLICE_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(src)

    def put(batch: DataFrame, number: int) -> None:
        keyed_put(to_cells(batch), table, put=f"{name}-{number}")

    return (
        slices.writeStream.foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_raw(
    spark: SparkSession,
    path: str,
    table: str,
    checkpoint: str,
    to_cells: Callable[[DataFrame], DataFrame] = email_cells,
    trigger_bytes: int = TRIGGER_BYTES,
    compact_every: int | None = None,
    **options,
) -> None:
    """Scan what is new of the raw images under `path` and put its cells, then stop; `options` as in `rawstream`.

    Each micro-batch takes in at most `trigger_bytes`, so a large image goes in over several of them. What was taken in
    is known from the checkpoint folder. With `compact_every`, the table's puts are merged after so many micro-batches;
    then no other job may put into it meanwhile.
    """
    name = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:24]
    RawStreamSource.register(spark)
    arriving = spark.readStream.format("rawstream").option("path", path).option("log", f"{checkpoint.rstrip('/')}/admitted")
    for key, value in {"overlap": MARGIN, "triggerBytes": trigger_bytes, **options}.items():
        arriving = arriving.option(key, value)

    def put(batch: DataFrame, number: int) -> None:
        keyed_put(to_cells(batch), table, put=f"{name}-{number}")
        if compact_every and (number + 1) % compact_every == 0:
            compact_live(spark, table)

    stream = arriving.load().writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
