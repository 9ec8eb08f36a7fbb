"""A Bloom filter of the keys of a table: built by tasks, kept beside the table, shipped after a check of its size.

The number of bits follows from a count of the keys and the error rate asked for. Tasks set bits of 64-bit cells, cells
of several tasks are joined by a bitwise or, and the filter is a table (cell, bits) of its own; two filters of one shape
are united in the same way. A lookup sends it to the tasks that read the wanted rows, where it drops most rows without a
partner before anything is shuffled; what it lets through by mistake finds nothing in the join behind it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: largest filter that is sent to every task
SHIPPED_BYTES = 64 << 20
SMALLEST_BITS = 1 << 10


@dataclass
class Bloom:
    """A filter: its table (cell, bits), its number of bits (a power of two) and of places for a key."""

    cells: DataFrame
    bits: int
    places: int

    def save(self, path: str) -> None:
        shape = self.cells.select("cell", F.col("bits"), F.lit(self.bits).cast("long").alias("size"), F.lit(self.places).alias("places"))
        shape.write.mode("overwrite").parquet(path)

    def union(self, other: Bloom) -> Bloom:
        if (self.bits, self.places) != (other.bits, other.places):
            raise ValueError("filters of different shapes cannot be united")
        return Bloom(_merged(self.cells.unionByName(other.cells)), self.bits, self.places)


def _merged(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cell").agg(F.bit_or("bits").alias("bits"))


def _places(key: str | Column, bits: int, places: int) -> Column:
    """The bits of a key: two hashes of it, combined."""
    low = F.lit((1 << 44) - 1)  # sums of the places stay within 64 bits
    one = F.xxhash64(key).bitwiseAND(low)
    two = F.xxhash64(F.lit(1), key if isinstance(key, Column) else F.col(key)).bitwiseAND(low)
    return F.array(*[(one + two * k).bitwiseAND(F.lit(bits - 1)) for k in range(places)])


def shape(keys: int, error: float) -> tuple[int, int]:
    """(bits, places) for so many keys: the least power of two that keeps to the error rate."""
    wanted = max(SMALLEST_BITS, math.ceil(-keys * math.log(error) / math.log(2) ** 2))
    bits = 1 << (wanted - 1).bit_length()
    return bits, max(1, min(16, round(bits / max(keys, 1) * math.log(2))))


def bloom_filter(table: DataFrame, key: str, error: float = 0.01, keys: int | None = None) -> Bloom:
    """The filter of a table's keys; `keys` is their number where it is known, null keys are in none."""
    if keys is None:
        keys = table.where(F.col(key).isNotNull()).count()
    bits, places = shape(keys, error)
    at = table.where(F.col(key).isNotNull()).select(F.explode(_places(key, bits, places)).alias("at"))
    cells = at.select(F.shiftright("at", 6).alias("cell"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bits"))
    return Bloom(_merged(cells), bits, places)


def load_bloom(spark: SparkSession, path: str) -> Bloom:
    saved = spark.read.parquet(path)
    first = saved.select("size", "places").first()
    bits, places = (first["size"], first["places"]) if first else (SMALLEST_BITS, 1)
    return Bloom(saved.select("cell", "bits"), bits, places)


def maybe_in(rows: DataFrame, key: str, bloom: Bloom) -> DataFrame:
    """The rows whose key may be in the filter; all rows where the filter is too large to be sent."""
    if bloom.bits // 8 > SHIPPED_BYTES:
        return rows
    import numpy as np
    import pandas as pd

    cells = bloom.cells.toArrow()  # at most SHIPPED_BYTES / 8 of them
    words = np.zeros(bloom.bits // 64, np.int64)
    words[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    shipped = rows.sparkSession.sparkContext.broadcast(words)

    def known(places):
        at = np.stack(places.to_numpy()) if len(places) else np.zeros((0, 1), np.int64)
        return pd.Series((shipped.value[at >> 6] >> (at & 63) & 1).astype(bool).all(axis=1))

    known.__annotations__ = {"places": pd.Series, "return": pd.Series}
    check = F.pandas_udf(known, "boolean")
    return rows.where(F.col(key).isNotNull()).where(check(_places(key, bloom.bits, bloom.places)))


def filtered_lookup(wanted: DataFrame, table: DataFrame, key: str, bloom: Bloom) -> DataFrame:
    """The wanted rows with their rows of the table, most of the others dropped before the join."""
    return maybe_in(wanted, key, bloom).join(table, key)
