"""The keys with the highest counts, exactly, without counting every key.

Each task keeps a Misra-Gries summary of at most `size` counters: where more keys come in, the largest count that does
not fit is taken from all of them, and summed up as the task's error. Summaries add up: a key's counter is never above
its count and never below by more than the errors of all tasks, which are at most rows / size together. Keys whose
counter and error do not reach the k-th best counter cannot be among the first k. The rest are counted exactly in a second pass,
of which only they are shuffled.

Where the k-th best counter is not above the error (k keys do not stand out), the summary is doubled up to MOST counters;
after that, keys are counted in full, as then no summary of a fixed size could tell them apart.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

#: counters of a task for each key asked for, and at most
COUNTERS, MOST = 64, 1 << 18
#: candidates that are sent to every task; more of them are joined by a shuffle
BROADCAST_ROWS = 1 << 17


def summaries(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(key, low, error) of the counters of every task; the row without a key has the task's error."""
    kind = rows.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("low", T.LongType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        target, held, error = to_arrow_schema(schema), None, 0
        for batch in batches:
            counted = pc.value_counts(batch.column(0).drop_null())
            new = pa.table({"key": counted.field("values"), "low": counted.field("counts")})
            both = new if held is None else pa.concat_tables([held, new])
            held = both.group_by("key").aggregate([("low", "sum")]).rename_columns(["key", "low"])
            if held.num_rows > size:
                low = held["low"].to_numpy()
                taken = int(np.partition(low, held.num_rows - size - 1)[held.num_rows - size - 1])
                error += taken
                held = held.set_column(1, "low", pc.subtract(held["low"], taken)).filter(pa.array(low > taken))
        if held is not None:
            n = held.num_rows
            keys, low = held["key"].combine_chunks().cast(target.field(0).type), held["low"].combine_chunks().cast(pa.int64())
            yield pa.RecordBatch.from_arrays([keys, low, pa.array([0] * n, pa.int64())], schema=target)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, target.field(0).type), pa.array([0]), pa.array([error])], schema=target)

    return rows.select(key).mapInArrow(run, schema)


def top_counts(rows: DataFrame, key: str, k: int, size: int | None = None) -> DataFrame:
    """(key, total) of the k keys with the highest counts; ties go to smaller keys. Null keys do not count."""
    size = size or k * COUNTERS
    while size <= MOST:
        kept = stored(summaries(rows, key, size), "summaries")
        error = kept.agg(F.sum("error").alias("e")).first()["e"] or 0
        lows = kept.where("key is not null").groupBy("key").agg(F.sum("low").alias("low"))
        best = lows.orderBy(F.desc("low")).limit(k).select("low").collect()
        if not error:  # every counter is a count
            return lows.select(F.col("key").alias(key), F.col("low").alias("total")).orderBy(F.desc("total"), key).limit(k)
        if len(best) == k and best[-1]["low"] > error:
            least = best[-1]["low"] - error
            candidates = stored(lows.where(F.col("low") >= least).select(F.col("key").alias(key)), "candidates")
            few = candidates.count() <= BROADCAST_ROWS
            counted = rows.join(F.broadcast(candidates) if few else candidates.hint("shuffle_hash"), key, "left_semi")
            return _first(counted, key, k)
        size *= 2
    return _first(rows.where(F.col(key).isNotNull()), key, k)


def _first(rows: DataFrame, key: str, k: int) -> DataFrame:
    totals = rows.groupBy(key).agg(F.count("*").alias("total"))
    return totals.orderBy(F.desc("total"), key).limit(k)
