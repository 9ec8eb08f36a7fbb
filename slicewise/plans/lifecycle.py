"""The jobs a user runs end to end: image files in, tables and reports out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators import sinks
from ..operators.boundary import MARGIN
from ..operators.cells import cells_block_to_media, cells_media_to_block, keyed_put
from ..operators.hashes import block_hashes
from ..operators.histogram import byte_histogram, histogram_report, histogram_total
from ..operators.scanners import scan, scan_email, to_artifacts
from ..sources.files import read_absent, read_raw
from ..sources.tables import read_slices


def features_of_images(spark: SparkSession, path: str, out: str) -> None:
    """Scan all images under `path` and write feature text, one directory per image; one job."""
    sinks.write_features(scan_email(read_raw(spark, path, overlap=MARGIN)), out)


def histogram_of_images(spark: SparkSession, path: str) -> DataFrame:
    """The byte histogram report of all images together."""
    return histogram_report(histogram_total(byte_histogram(read_raw(spark, path), by=())))


def artifacts_of_images(spark: SparkSession, path: str, out: str, patterns: dict | None = None) -> None:
    """The artifact table of all images under `path`."""
    sinks.write_artifacts(to_artifacts(scan(read_raw(spark, path, overlap=MARGIN), patterns)), out)


def slices_of_images(spark: SparkSession, path: str, out: str, done: DataFrame | None = None) -> None:
    """Copy images to a slice table with the context that boundary-safe scans need."""
    slices = read_raw(spark, path, overlap=MARGIN).drop("error")
    sinks.write_slices(slices, out, done)


def complete_slices(spark: SparkSession, path: str, out: str, **options) -> None:
    """Bring the slice table up to all slices of the images under `path`, whatever of them it holds.

    For runs that ended between the commits of their files, and for images that came later: what is stored is
    neither read nor written again. `options` are those of `read_absent`; slices keep the size they were stored with.
    """
    try:
        stored = read_slices(spark, out)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        stored = spark.createDataFrame([], "image string, offset bigint")
    sinks.write_slices(read_absent(spark, path, stored, **{"overlap": MARGIN, **options}), out)


def block_tables(spark: SparkSession, path: str, hashes: str, media: str, blocks: str, put: str | None = None) -> None:
    """Hash all blocks once into a table, and derive both keyed tables from it.

    `put` names the puts into the keyed tables, so that a run that failed can be repeated; without a
    name every run adds its cells to those of others.
    """
    block_hashes(read_raw(spark, path).drop("before", "after", "error")).write.mode("errorifexists").parquet(hashes)
    stored = spark.read.parquet(hashes)
    keyed_put(cells_media_to_block(stored), media, put=put)
    keyed_put(cells_block_to_media(stored), blocks, put=put)
