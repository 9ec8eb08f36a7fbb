"""Byte histograms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: groups held by a task before it emits what it has counted
GROUPS_HELD = 1024


def byte_histogram(slices: DataFrame, by: Sequence[str] = ("image",)) -> DataFrame:
    """Partial counts (by, byte, n), summed up inside each task.

    Exploding each byte into a row would be 64 Ki rows per slice; counting an Arrow batch with
    numpy and emitting at most 256 rows per group and task leaves next to nothing to shuffle.
    """
    by = list(by)
    fields = [slices.schema[c] for c in by]
    schema = T.StructType([*fields, T.StructField("byte", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def emit(held, types):
            for key, counts in held.items():
                present = np.flatnonzero(counts)
                arrays = [pa.array([v] * len(present), t) for v, t in zip(key, types)]
                arrays += [pa.array(present.astype("int32")), pa.array(counts[present])]
                yield pa.RecordBatch.from_arrays(arrays, names=[*by, "byte", "n"])

        held: dict[tuple, np.ndarray] = {}
        types: list = []
        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            keys = zip(*[batch[c].to_pylist() for c in by]) if by else iter([()] * batch.num_rows)
            for key, data in zip(keys, batch["data"]):
                if not data.is_valid:
                    continue
                counts = np.bincount(np.frombuffer(data.as_buffer(), np.uint8), minlength=256)
                held[key] = held[key] + counts if key in held else counts
            if len(held) > GROUPS_HELD:
                yield from emit(held, types)
                held = {}
        yield from emit(held, types)

    return slices.select(*by, "data").mapInArrow(count, schema)


def histogram_total(histogram: DataFrame) -> DataFrame:
    return histogram.groupBy("byte").agg(F.sum("n").alias("n"))


def histogram_by_image(histogram: DataFrame) -> DataFrame:
    """Counts per image and, as image NULL, of all images together; one job."""
    return (
        histogram.groupBy("image", "byte").agg(F.sum("n").alias("n"))
        .rollup("byte", "image").agg(F.sum("n").alias("n"), F.grouping("byte").alias("g"))
        .where("g = 0")
        .select("image", "byte", "n")
    )


def histogram_report(total: DataFrame, newline: bool = True) -> DataFrame:
    """The report of one histogram as a text: pairs for all 256 bytes, then the total.

    One pair per line, or all pairs on one line. The input has 256 rows at most, so the report is
    built by one aggregate.
    """
    every = total.sparkSession.range(256).select(F.col("id").cast("int").alias("byte"))
    filled = every.join(total, "byte", "left").select("byte", F.coalesce("n", F.lit(0)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("byte", "n")))
    texts = F.transform(pairs, lambda p: F.concat_ws(" ", p["byte"].cast("string"), p["n"].cast("string")))
    body = F.concat(F.array_join(texts, "\n"), F.lit("\n")) if newline else F.concat(
        F.array_join(texts, " "), F.lit(" \n")
    )
    end = F.lit("") if newline else F.lit("\n")
    return filled.agg(F.concat(body, F.lit("total: "), F.sum("n").cast("string"), end).alias("report"))


def total_bytes(images: DataFrame) -> DataFrame:
    return images.agg(F.sum("length").alias("total_bytes"))


def read_only_pass(slices: DataFrame) -> DataFrame:
    """Reads all slices and only counts them: the cost of input without scanning."""
    return slices.agg(
        F.count("*").alias("slices"), F.sum(F.length("data").cast("long")).alias("bytes")
    )
