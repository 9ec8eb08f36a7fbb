"""Running sums and neighbours along an order, without gathering a whole group in one task.

A window over one image (or over a whole table) puts all its rows in one task. Both helpers work
on ranges instead: a window inside each range, one over the few range summaries, and an equi-join
that carries the summary into its range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: number of ranges that `key_ranges` cuts a key space into
RANGES = 256


def key_ranges(df: DataFrame, key: str, ranges: int = RANGES) -> Column:
    """A column numbering ranges of `key`, ascending with it.

    The split points are keys picked by hash order, at most `ranges` of them on the driver. Any
    split points give right results; these only keep the ranges even.
    """
    picked = df.select(key).where(F.col(key).isNotNull()).distinct()
    picked = picked.orderBy(F.xxhash64(key), key).limit(ranges)
    points = sorted(row[0] for row in picked.collect())
    if not points:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(p) for p in points]), lambda p: p <= F.col(key)))


def running_sum(
    df: DataFrame, order: Sequence[str], sums: dict[str, Column], bucket: Column
) -> DataFrame:
    """Add running totals along `order`; `bucket` must ascend with it.

    Rows of equal order values would tie, so `order` must be unique.
    """
    rows = df.select("*", bucket.alias("_bucket"), *[v.alias(f"_{n}") for n, v in sums.items()])
    inside = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_bucket").agg(*[F.sum(f"_{n}").alias(f"_t_{n}") for n in sums])
    carried = totals.select(
        "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums]
    )
    local = rows.select("*", *[F.sum(f"_{n}").over(inside).alias(f"_l_{n}") for n in sums])
    joined = local.join(carried, "_bucket")
    return joined.select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums]
    )


def neighbours(
    df: DataFrame, group: Sequence[str], order: Sequence[str], values: Sequence[str], bucket: Column
) -> DataFrame:
    """Add `prev` and `next`, the structs of `values` of the rows before and after in each group.

    `bucket` numbers ranges that ascend with `order`, so that a group is spread over many tasks.
    """
    value = F.struct(*values)
    rows = df.select("*", bucket.alias("_bucket"), value.alias("_value"))
    keys = [*group, "_bucket"]
    inside = Window.partitionBy(*keys).orderBy(*order)
    local = rows.select(
        "*", F.lag("_value").over(inside).alias("_prev"), F.lead("_value").over(inside).alias("_next")
    )
    edges = rows.groupBy(*keys).agg(
        F.min_by("_value", F.struct(*order)).alias("_first"), F.max_by("_value", F.struct(*order)).alias("_last")
    )
    across = Window.partitionBy(*group).orderBy("_bucket")
    carried = edges.select(
        *keys, F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_behind")
    )
    joined = local.join(carried, keys)
    return joined.select(
        *df.columns,
        F.coalesce("_prev", "_before").alias("prev"),
        F.coalesce("_next", "_behind").alias("next"),
    )
