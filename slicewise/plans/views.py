"""The driver tables seen as this package's inputs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.boundary import MARGIN
from ..operators.scanners import scan
from ..operators.stitching import Within
from ..session import new_folder
from ..sources.files import chunk
from ..sources.tables import spread

#: slices of the documents are narrow, so that most documents have several
SLICE = 8192
#: what Spark's writers leave beside the image files of `raw_document_files`
MARKS = "_*;.*"
#: words of the documents as a second class of artifacts
WORD = "[A-Za-z]{5,}"
WORDS = Within(WORD, "A-Za-z")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(table(spark, sf_dir, name))


def document_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, data): each document is a media image."""
    docs = text_table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("image"), F.encode("text", "UTF-8").alias("data"))


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = text_table(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").alias("image"), F.encode("html", "UTF-8").alias("data"))


def document_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, length) of the documents; only the lengths leave the scan."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("image"), F.octet_length("text").cast("long").alias("length"))


def page_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").alias("image"), F.octet_length("html").cast("long").alias("length"))


def slices(spark: SparkSession, sf_dir: str, size: int = SLICE, overlap: int = MARGIN) -> DataFrame:
    return chunk(document_images(spark, sf_dir), "image", "data", size, overlap)


def plain_slices(spark: SparkSession, sf_dir: str, size: int = SLICE) -> DataFrame:
    return chunk(document_images(spark, sf_dir), "image", "data", size)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, artifact, offset) of the words of all documents, of any length."""
    found = scan(plain_slices(spark, sf_dir), {"word": WORDS})
    return found.select("image", F.col("feature").alias("artifact"), "offset")


def event_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, artifact, offset) with user, event type and event number."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("image"), F.col("event_type").alias("artifact"), F.col("event_id").alias("offset")
    )


def progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a progress log."""
    events = table(spark, sf_dir, "events")
    size = F.round(F.col("value") * 100).cast("long").cast("string")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH-mm-ss"), F.lit(".tsv "), size)
    return events.select(line.alias("value"))


def executor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of an executor log: views start a task, clicks finish one."""
    text = (
        F.when(F.col("event_type") == "view", " INFO Executor: Running task ")
        .when(F.col("event_type") == "click", " INFO Executor: Finished task ")
        .otherwise(" INFO BlockManager: some other line of the log ")
    )
    line = F.concat(F.date_format("ts", "yy/MM/dd HH:mm:ss"), text, F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select(line.alias("value"))


def packed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document packed by gzip behind four other bytes."""

    def pack(batches: Iterator) -> Iterator:
        import gzip

        import pyarrow as pa

        for batch in batches:
            packed = [b"IMG:" + gzip.compress(d, mtime=0) for d in batch["data"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["image"], pa.array(packed, pa.binary())], names=["image", "data"])

    return document_images(spark, sf_dir).mapInArrow(pack, "image bigint, data binary")


#: offsets between the documents of one medium
DOCUMENT_BYTES = 1 << 24


def media_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a source as the contents of one medium, each at an offset of its own."""
    docs = text_table(spark, sf_dir, "documents")
    parts = chunk(docs, F.struct("source", "doc_id"), F.encode("text", "UTF-8"), SLICE, MARGIN)
    return parts.select(
        F.col("image.source").alias("image"),
        (F.col("image.doc_id") * DOCUMENT_BYTES + F.col("offset")).alias("offset"),
        "data",
        "before",
        "after",
    )


def raw_document_files(spark: SparkSession, sf_dir: str) -> str:
    """A new folder of image files that hold the documents, a line break behind each.

    Every task writes the documents it has, by source, so no source passes through one task.
    """
    path = new_folder(spark, "images")
    docs = text_table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    docs.select("source", "text").write.partitionBy("source").text(path)
    return path


def source_of(image: str = "image") -> Column:
    """The source a file of `raw_document_files` belongs to."""
    return F.regexp_extract(image, "/source=([^/]*)/", 1)
