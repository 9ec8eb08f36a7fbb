"""Whole-file input, file listings, input limits and slicing of binary columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import key_ranges, running_sum
from ..session import stored as kept
from .rawimage import SLICE_BYTES, ByteRange, ImageListSource, RawImageReader, RawImageSource, open_filesystem


#: most bytes of a file in one row
WHOLE_BYTES = (1 << 31) - 1
#: bytes of absent slices that one task reads
TASK_BYTES = 1 << 27


def read_raw(spark: SparkSession, path: str, **options) -> DataFrame:
    """Slices of the files under `path`; options as in `rawimage`."""
    RawImageSource.register(spark)
    reader = spark.read.format("rawimage").option("path", path)
    reader = reader.option("minTasks", spark.sparkContext.defaultParallelism)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def image_name(path: str) -> str:
    """The beginning of the names that images below a path have."""
    return open_filesystem(path)[1].rstrip("/")


def whole_files(spark: SparkSession, path: str, exclude: str = "") -> DataFrame:
    """One row per file that is not empty, named as by `read_raw` and `list_images`.

    For files that fit a row (2 GB); a larger one is an error, it goes through `read_raw`.
    """
    parts = read_raw(spark, path, sliceBytes=WHOLE_BYTES, exclude=exclude)
    whole = F.when(F.col("offset") == 0, F.col("data")).otherwise(F.raise_error(F.lit("a file does not fit a row")))
    return parts.select("image", F.length("data").cast("long").alias("length"), whole.alias("data"))


def list_images(spark: SparkSession, path: str, exclude: str = "") -> DataFrame:
    """Names and sizes only; no file is opened."""
    spark.dataSource.register(ImageListSource)
    return spark.read.format("imagelist").option("path", path).option("exclude", exclude).load()


def read_absent(
    spark: SparkSession, path: str, stored: DataFrame, size: int = SLICE_BYTES, overlap: int = 0, exclude: str = ""
) -> DataFrame:
    """The slices of the files under `path` that are not among `stored` (image, offset), which has slices of this size.

    Only names and offsets are compared and shuffled; then each task opens the files for the slices it is to read, and
    reads neighbouring ones together. The number of tasks follows the bytes to be read, TASK_BYTES each, as the names that
    stand for them are few. Several paths have to be of one file system.
    """
    listed = list_images(spark, path, exclude).where("length > 0")
    step = F.lit(size).cast("long")
    wanted = listed.select("image", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step)).alias("offset"))
    absent = kept(wanted.join(stored.select("image", "offset"), ["image", "offset"], "left_anti"), "absent")
    n = absent.count()
    tasks = max(1, min(n, spark.sparkContext.defaultParallelism), -(-n * size // TASK_BYTES))
    ordered = absent.repartitionByRange(tasks, "image", "offset").sortWithinPartitions("image", "offset")
    options = {"path": path, "slicebytes": size, "overlap": overlap}

    def read(batches: Iterator) -> Iterator:
        reader = RawImageReader(options)
        for batch in batches:
            ranges: list[ByteRange] = []
            for row in batch.to_pylist():
                stop = min(row["offset"] + size, row["length"])
                if ranges and (ranges[-1].image, ranges[-1].stop) == (row["image"], row["offset"]):
                    ranges[-1].stop = stop
                else:
                    ranges.append(ByteRange(reader.paths[0], row["image"], row["offset"], stop, row["length"]))
            for r in ranges:
                for part in reader.read_range(r):
                    yield part.drop_columns(["error"])

    return ordered.mapInArrow(read, "image string, offset bigint, data binary, before binary, after binary")


def chunk(
    df: DataFrame, image: str | Column, data: str | Column, size: int = SLICE_BYTES, overlap: int = 0
) -> DataFrame:
    """Slices of a binary column; with `overlap`, the bytes around each slice come along."""
    image = F.col(image) if isinstance(image, str) else image
    data = F.col(data) if isinstance(data, str) else data
    whole = df.select(image.alias("image"), data.alias("whole")).where(F.length("whole") > 0)
    parts = whole.select(
        "image",
        "whole",
        F.explode(F.expr(f"sequence(0, cast((length(whole) - 1) div {size} as int))")).alias("k"),
    )
    start = F.col("k") * size
    columns = ["image", start.cast("long").alias("offset"), F.substring("whole", start + 1, size).alias("data")]
    if overlap:
        lead = F.least(start, F.lit(overlap))
        columns.append(F.substring(F.col("whole"), start - lead + 1, lead).alias("before"))
        columns.append(F.substring(F.col("whole"), start + size + 1, F.lit(overlap)).alias("after"))
    return parts.select(*columns)


def limit_images(
    images: DataFrame,
    n: int | None = None,
    max_bytes: int | None = None,
    include: str | None = None,
    exclude: str | None = None,
) -> DataFrame:
    """Restrict a listing: by name, by byte budget in name order, by number of names."""
    if include is not None:
        images = images.where(F.col("image").contains(include))
    if exclude is not None:
        images = images.where(~F.col("image").contains(exclude))
    if max_bytes is not None:
        ranges = key_ranges(images, "image")
        summed = running_sum(images, ["image"], {"bytes_so_far": F.col("length")}, ranges)
        images = summed.where(F.col("bytes_so_far") <= max_bytes).drop("bytes_so_far")
    if n is not None:
        images = images.orderBy("image").limit(n)
    return images


def order_splits(splits: DataFrame) -> DataFrame:
    """Byte ranges in the order path, start, length."""
    return splits.orderBy("image", "start", "length")


def union_all(*frames: DataFrame) -> DataFrame:
    """One input out of several, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b), frames)
