"""Buffers that no run of a stream has seen before, by digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUFFER_SCHEMA = "image string, offset bigint, data binary"


def first_sights(buffers: DataFrame) -> DataFrame:
    """The first buffer of each content. In a stream the digests are keyed state, which the checkpoint keeps for later runs."""
    digested = buffers.withColumn("digest", F.md5("data"))
    return digested.dropDuplicates(["digest"])


def unseen_stream(
    spark: SparkSession,
    src: str,
    table: str,
    checkpoint: str,
    schema: str = BUFFER_SCHEMA,
    columns: dict[str, Column] | None = None,
    max_files: int = 1000,
) -> StreamingQuery:
    """Append the buffers that arrived under `src` and whose content is new to `table`, then stop.

    Digests live in the state store under the checkpoint, dealt over the shuffle partitions; it holds 16 bytes and a key
    for each content ever seen, on the executors and in the checkpoint, never on the driver. A run that is ended before
    its commit is done again with the same files and the state before it, and the sink takes each batch once.
    """
    buffers = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(src)
    fresh = first_sights(buffers)
    for name, value in (columns or {}).items():
        fresh = fresh.withColumn(name, value)
    return (
        fresh.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
