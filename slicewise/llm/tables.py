"""Written intermediate tables in the shared folder, and bounded lists of frequent keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder

#: steps per doubling in the histogram that finds the least count of a frequent key
STEPS = 16


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back, so no executor's loss repeats the work."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frequent(counts: DataFrame, n: str, most: int, where: Column | None = None) -> DataFrame:
    """The keys of `counts` with the largest `n`: at most `most` rows, whatever the size of the table.

    A histogram of log2(n) with a fixed number of steps gives the least count for which no more than `most` keys
    are left, so neither a sort nor a task that sees all keys is needed.
    """
    rows = counts.where(where) if where is not None else counts
    step = F.floor(F.log2(F.col(n).cast("double")) * STEPS)
    total, least = 0, None
    for step_value, keys in sorted(rows.groupBy(step).count().collect(), reverse=True):
        total += keys
        if total > most:
            break
        least = step_value
    return rows.where(step >= F.lit(least)) if least is not None else rows.where(F.lit(False))
