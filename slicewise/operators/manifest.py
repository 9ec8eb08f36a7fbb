"""Which puts of a keyed table a compacted put stands for."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_manifest"
ENTRIES = "put string, merged_into string, version bigint"


def inside(table: str, *parts: str) -> str:
    return "/".join([table.rstrip("/"), *parts])


def manifest(spark: SparkSession, table: str) -> DataFrame:
    """(put, merged_into, version) of all manifests of a table; no rows if it was never compacted."""
    try:
        return spark.read.schema(ENTRIES).json(inside(table, MANIFEST))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRIES)


def merged_puts(spark: SparkSession, table: str) -> tuple[list[str], int]:
    """The names of the puts that readers leave out, and the newest version (0 if there is none).

    One short text for each put ever merged: they stay known after a vacuum, so that a repeated put is told from a new one.
    """
    rows = manifest(spark, table).select("put", "version").collect()
    return sorted({r.put for r in rows if r.put is not None}), max((r.version for r in rows), default=0)
