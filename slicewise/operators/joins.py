"""Equi-joins that stay even when a few keys hold a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a key with more than 1/SHARES of all rows is split, so at most SHARES keys are
SHARES = 100_000
#: a key with no more rows than this is never split
SMALL_GROUP = 1 << 17


def hot_keys(counts: DataFrame, key: str, shares: int = SHARES, small: int = SMALL_GROUP) -> DataFrame:
    """(key, pieces) of the keys that one task should not hold, of counts (key, n)."""
    share = F.greatest(counts.agg(F.sum("n")).scalar() / F.lit(shares), F.lit(float(small)))
    hot = counts.select(key, "n", share.alias("share")).where(F.col("n") > F.col("share"))
    return hot.select(key, F.ceil(F.col("n") / F.col("share")).cast("int").alias("_pieces"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: Sequence[str],
    counts: DataFrame | None = None,
    shares: int = SHARES,
    small: int = SMALL_GROUP,
) -> DataFrame:
    """Inner equi-join on `key`, with the rows of a hot key of `left` spread over several tasks.

    The pieces of a hot key are told apart by a hash of `spread`; the matching rows of `right` are
    repeated once per piece. `counts` (key, n) gives the rows per key of `left` where they are
    known already. There are at most `shares` hot keys, each with more than 1 / shares of all rows,
    so their list fits the driver and a broadcast. A key of at most `small` rows is one task's work.
    """
    if counts is None:
        counts = left.groupBy(key).agg(F.count("*").alias("n"))
    hot = hot_keys(counts, key, shares, small)
    found = hot.collect()
    listed = F.broadcast(left.sparkSession.createDataFrame(found, hot.schema))
    pieces = F.coalesce("_pieces", F.lit(1))
    salted = left.join(listed, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), pieces).cast("int"))
    repeated = right.join(listed, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return salted.drop("_pieces").join(repeated.drop("_pieces"), [key, "_salt"]).drop("_salt")


def not_ingested(images: DataFrame, done: DataFrame, on: str = "image") -> DataFrame:
    """Rows of `images` whose name is not among those already taken in."""
    return images.join(done.select(on), on, "left_anti")


def lookup(table: DataFrame, keys: DataFrame | Sequence, on: str) -> DataFrame:
    """Rows of `table` with one of the keys: a pushed-down filter for values, a semi-join for a table."""
    if isinstance(keys, DataFrame):
        return table.join(keys.select(on), on, "left_semi")
    return table.where(F.col(on).isin(list(keys)))
