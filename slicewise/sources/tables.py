"""Readers of the tables this package writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cells import latest
from ..operators.compaction import live_puts

#: columns that stand in folder names, and are text whatever they look like
NAMES = ("image", "artifact_class", "put")


def spread(df: DataFrame) -> DataFrame:
    """The table dealt out evenly, if the session asks for it by `slicewise.spread` (a number of partitions).

    A file of one row group is read by one task, which would also do all scanning. That is worth a
    shuffle for small tables only, so it is the caller's choice and never depends on the table.
    """
    parts = int(df.sparkSession.conf.get("slicewise.spread", "0"))
    return df.repartition(parts) if parts else df


def _read(spark: SparkSession, path: str, fmt: str, skip_corrupt: bool) -> DataFrame:
    def reader():
        return spark.read.format(fmt).option("ignoreCorruptFiles", skip_corrupt)

    found = reader().load(path).schema
    text = [T.StructField(f.name, T.StringType()) if f.name in NAMES else f for f in found.fields]
    return reader().schema(T.StructType(text)).load(path)


def read_slices(spark: SparkSession, path: str, fmt: str = "parquet", skip_corrupt: bool = False) -> DataFrame:
    """The slice table; `fmt="avro"` works where Spark's Avro package is on the class path."""
    return _read(spark, path, fmt, skip_corrupt)


def read_artifacts(spark: SparkSession, path: str, fmt: str = "parquet", skip_corrupt: bool = False) -> DataFrame:
    return _read(spark, path, fmt, skip_corrupt)


def scan_cells(spark: SparkSession, table: str, family: str | None = None) -> DataFrame:
    """Current cells of a keyed table, restricted to one column family if given."""
    puts = live_puts(spark, table)
    if family is not None:
        puts = puts.where(F.col("family") == family)
    return latest(puts)


def parse_cells(df: DataFrame, column: str | Column) -> DataFrame:
    """`row,family,qualifier,value` text as cells; commas after the third belong to the value."""
    text = F.col(column) if isinstance(column, str) else column
    parts = df.select(F.split(text, ",", 4).alias("parts"))
    names = ("row_key", "family", "qualifier", "value")
    return parts.select(*[F.get("parts", F.lit(i)).alias(name) for i, name in enumerate(names)])
