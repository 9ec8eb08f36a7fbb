"""Throughput series from logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_sum

# Mean gigabytes per input split of two recorded runs (bytes / splits / 10^9).
GB_PER_SPLIT_100_IMAGES = 10220928331776 / 76201 / 10**9
GB_PER_SPLIT_ALL_IMAGES = 130018265483776 / 970124 / 10**9
#: seconds whose series one task orders
RANGE_SECONDS = 3600


def _range(t: str) -> Column:
    return F.call_function("div", F.col(t).cast("long"), F.lit(RANGE_SECONDS).cast("long"))


def log_counters(lines: DataFrame, prefixes: Sequence[str], line: str = "value") -> DataFrame:
    """Sums of the numbers behind each of the given line beginnings, in one row."""
    text = F.col(line)
    sums = []
    for prefix in prefixes:
        number = F.substring(text, len(prefix) + 1, 20).try_cast("long")
        name = prefix.rstrip(": ")
        sums.append(F.coalesce(F.sum(F.when(text.startswith(prefix), number)), F.lit(0)).alias(name))
    return lines.agg(*sums)


def throughput(log: DataFrame, bucket_s: int = 10, gb_per_split: float = GB_PER_SPLIT_100_IMAGES) -> DataFrame:
    """GB per second started and finished, per time bucket that has an event."""
    bucket = F.call_function("div", F.col("t"), F.lit(bucket_s).cast("long")) * bucket_s
    events = log.where(F.col("event").isin("started", "finished"))
    counts = events.groupBy(bucket.alias("bucket")).agg(
        F.count_if(F.col("event") == "started").alias("started"),
        F.count_if(F.col("event") == "finished").alias("finished"),
    )
    rate = gb_per_split / bucket_s
    return counts.select(
        "bucket",
        "started",
        "finished",
        (F.col("started") * F.lit(rate)).alias("started_gb_s"),
        (F.col("finished") * F.lit(rate)).alias("finished_gb_s"),
    )


def cumulative_throughput(buckets: DataFrame, gb_per_split: float = GB_PER_SPLIT_100_IMAGES) -> DataFrame:
    """GB started and finished up to each bucket."""
    sums = {"started_sum": F.col("started"), "finished_sum": F.col("finished")}
    rows = running_sum(buckets.select("bucket", "started", "finished"), ["bucket"], sums, _range("bucket"))
    return rows.select(
        "bucket",
        (F.col("started_sum") * F.lit(gb_per_split)).alias("started_gb"),
        (F.col("finished_sum") * F.lit(gb_per_split)).alias("finished_gb"),
    )


def cumulative_bytes(log: DataFrame) -> DataFrame:
    """Bytes processed up to each second of the log, seconds counted from its first line."""
    per_second = log.groupBy("t").agg(F.sum("bytes").alias("bytes"))
    first = log.agg(F.min("t")).scalar()
    rows = running_sum(per_second, ["t"], {"total_bytes": F.col("bytes")}, _range("t"))
    return rows.select((F.col("t") - first).alias("seconds"), "total_bytes")


def order_buckets(buckets: DataFrame) -> DataFrame:
    return buckets.orderBy("bucket")
