"""Writers and report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape
from .joins import not_ingested


def feature_line() -> Column:
    return F.concat_ws("\t", F.col("offset").cast("string"), escape(F.col("feature")), escape(F.col("context")))


def feature_lines(features: DataFrame) -> DataFrame:
    """(image, line) with line = offset, feature and context, escaped and tab-separated."""
    return features.select(F.col("image").cast("string").alias("image"), feature_line().alias("line"))


def write_features(features: DataFrame, path: str) -> None:
    """Text files, one directory per image; each task writes what it found, nothing is shuffled."""
    feature_lines(features).write.mode("errorifexists").partitionBy("image").text(path)


def write_append(features: DataFrame, path: str, first: bool = False) -> None:
    """Append feature lines, each to the folder of its image; the first call of a run refuses a target that exists."""
    mode = "errorifexists" if first else "append"
    feature_lines(features).write.mode(mode).partitionBy("image").text(path)


def artifact_lines(artifacts: DataFrame) -> DataFrame:
    """`class image path<TAB>artifact<TAB>context` of (artifact_class, image, path, feature, context)."""
    head = F.concat_ws(" ", "artifact_class", F.col("image").cast("string"), F.col("path").cast("string"))
    line = F.concat_ws("\t", head, escape(F.col("feature")), escape(F.col("context")))
    return artifacts.select(line.alias("line"))


def write_slices(slices: DataFrame, path: str, done: DataFrame | None = None) -> None:
    """Append slices, leaving out images listed in `done` (those the table already holds)."""
    if done is not None:
        slices = not_ingested(slices, done)
    slices.write.mode("append").option("compression", "snappy").partitionBy("image").parquet(path)


def complete_images(stored: DataFrame, listing: DataFrame, size: int) -> DataFrame:
    """Images of `listing` (image, length) of which all slices of this size are stored; no bytes are read for it.

    Offsets are made distinct before they are counted, so slices stored twice do not stand in for others.
    """
    held = stored.select("image", "offset").distinct().groupBy("image").agg(F.count("*").alias("held"))
    both = listing.join(held, "image", "left")
    return both.where(F.coalesce("held", F.lit(0)) >= F.ceil(F.col("length") / size)).select("image")


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    artifacts.write.mode("errorifexists").partitionBy("artifact_class").parquet(path)


def save_artifacts(artifacts: DataFrame, table: str) -> None:
    artifacts.write.mode("errorifexists").partitionBy("artifact_class").saveAsTable(table)


def reshard(df: DataFrame, n: int = 500) -> DataFrame:
    """The same rows in n even partitions."""
    return df.repartition(n)


def consume(df: DataFrame) -> None:
    """Run the plan and drop its rows."""
    df.write.format("noop").mode("overwrite").save()


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))
