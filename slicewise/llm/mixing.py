"""Mixing sources to target weights by Pfair scheduling; DataFrame functions on all rows.

Method: the documents of each source, in a pseudo-random order of their own, are cut into blocks of `block` documents.
With weight w (the weights of the sources that still have blocks add up to 1), block k of a source is released at slot
floor(k / w) and due by slot ceil((k + 1) / w). Earliest deadline first gives each slot to a released block. At every
slot, each source has had less than one block more or less than its weight asks for, however long the table: weights
are exact fractions (a float is one, too), never rounded.

When a source has no blocks left, the next phase goes on with the others at their weights relative to each other; so
every document has exactly one place, and the first phase is the longest stretch that can keep to all the weights.

The schedule is a table with a row for each block. The driver works it out slot by slot from counts and weights and
writes it in pieces of PIECE rows: it holds a number for each source and one piece, and takes time in proportion to
the blocks. The number of sources has no bound.

Documents are numbered within their source over buckets of the hash of id and text: a count per bucket, a running sum
over the buckets, a row number inside each. A source that holds most rows has the more buckets, not a larger task.
The blocks of a bucket are brought to it, so its documents are dealt once.

Defined results: a null source is a source of its own; a source without a weight, or with a weight that is not
positive, is an error, as its documents would have no place; an empty table gives an empty one; equal rows get
different places; the last block of a source may be short; a deadline beyond the range of its type is the end of it.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import new_folder
from .tables import stored

#: documents in a block
BLOCK = 16
#: rows of the schedule that are written at once
PIECE = 1 << 18
#: documents in a bucket, on average, as long as there are no more buckets than this
BUCKET_ROWS, MOST_BUCKETS = 1000, 1 << 16
PLACES = ("phase", "slot", "place", "release", "deadline")
SCHEDULE = "_s string, _k long, phase int, slot long, release long, deadline long"
_LAST = (1 << 63) - 1


def whole_weights(weights: Mapping) -> dict:
    """Whole numbers in exactly the ratios of the weights."""
    if any(not w or w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*{w.denominator for w in exact.values()})
    return {s: int(w * scale) for s, w in exact.items()}


def schedule(blocks: Mapping, parts: Mapping) -> Iterator[tuple]:
    """(source, block, phase, slot, release, deadline) of all blocks by slot: earliest deadline first.

    Ties go to the source with the larger weight, then to the one that sorts first. So the first blocks of a phase's
    sources are due in one order that is known beforehand, and a phase costs its own slots only, not all sources.
    """
    order = sorted((s for s, n in blocks.items() if n > 0), key=lambda s: (-parts[s], s is not None, s))
    size, share = [blocks[s] for s in order], [parts[s] for s in order]
    left, total, head = list(size), sum(share), len(order)
    after, before = [*range(1, head + 1), 0], [head, *range(head)]  # a ring of the sources that have blocks
    start = phase = 0
    while after[head] != head:
        waiting: list[tuple[int, int, int]] = []  # (release, source, block of the phase)
        ready: list[tuple[int, int, int, int]] = []  # (deadline, source, block of the phase, release)
        fresh = after[head]
        for slot in itertools.count():
            while waiting and waiting[0][0] <= slot:
                release, i, k = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(k + 1) * total // share[i]), i, k, release))
            first = (-(-total // share[fresh]), fresh, 0, 0) if fresh != head else None
            if first and (not ready or first < ready[0]):
                deadline, i, k, release = first
                fresh = after[fresh]
            else:
                deadline, i, k, release = heapq.heappop(ready)
            yield order[i], size[i] - left[i], phase, start + slot, start + release, start + deadline
            left[i] -= 1
            if not left[i]:
                break
            heapq.heappush(waiting, ((k + 1) * total // share[i], i, k + 1))
        after[before[i]], before[after[i]] = after[i], before[i]
        total -= share[i]
        start, phase = start + slot + 1, phase + 1


def period(parts: Mapping) -> dict:
    """{source: slots of its blocks} in the sum of `parts` slots, after which the schedule repeats."""
    slots: dict = {s: [] for s in parts}
    more = {s: n + 1 for s, n in parts.items()}  # no source ends a phase
    for s, _, _, slot, _, _ in itertools.islice(schedule(more, parts), sum(parts.values())):
        slots[s].append(slot)
    return slots


def stored_schedule(spark: SparkSession, blocks: Mapping, parts: Mapping) -> DataFrame:
    """The schedule as a table in the shared folder."""
    path, rows = new_folder(spark, "schedule"), schedule(blocks, parts)
    # of the JVM's own rows: a list of Python's would start workers on the executors, which then stay
    empty = [F.lit(None).cast(part.split()[1]).alias(part.split()[0]) for part in SCHEDULE.split(", ")]
    spark.range(0).select(*empty).write.parquet(path)
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [part.split()[0] for part in SCHEDULE.split(", ")]
    while piece := list(itertools.islice(rows, PIECE)):
        columns = list(zip(*piece))
        columns[-1] = [min(deadline, _LAST) for deadline in columns[-1]]
        table = pa.table([pa.array(c, t) for c, t in zip(columns, types)], names)
        spark.createDataFrame(table).write.mode("append").parquet(path)
    return spark.read.schema(SCHEDULE).parquet(path)


def mix(docs: DataFrame, weights: Mapping | float, block: int = BLOCK, key="doc_id", source="source", text="text"):
    """`docs` with phase, slot, place (in the block), release and deadline; the mixture is the order (slot, place).

    `weights` gives each source its share, or one exponent a: the share goes with (number of documents) ** a.
    """
    rest = docs.drop(*PLACES)
    kept = rest.columns
    named = F.when(F.col(source).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source)))
    hashed = rest.withColumn("_h", F.xxhash64(key, text)).withColumn("_s", named)
    total = hashed.count()
    buckets = min(MOST_BUCKETS, max(1, -(-total // BUCKET_ROWS)))
    hashed = hashed.withColumn("_b", F.pmod(F.shiftrightunsigned("_h", 20), F.lit(buckets)))
    sizes = stored(hashed.groupBy("_s", "_b").agg(F.count("*").alias("_n")), "bucket-sizes")
    found = {r["_s"]: r["n"] for r in sizes.groupBy("_s").agg(F.sum("_n").alias("n")).collect()}
    if isinstance(weights, Mapping):
        weights = {"" if s is None else f"={s}": w for s, w in weights.items()}
    else:
        weights = {s: float(n) ** weights for s, n in found.items()}
    if missing := [s[1:] if s else None for s in found if s not in weights]:
        raise ValueError(f"no weight for {missing[:5]}")
    parts = whole_weights({s: weights[s] for s in found})
    plan = stored_schedule(docs.sparkSession, {s: -(-n // block) for s, n in found.items()}, parts)
    upto = F.sum("_n").over(W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.withColumn("_before", F.coalesce(upto, F.lit(0)))
    ends = [F.floor(x / block) for x in (F.col("_before"), F.col("_before") + F.col("_n") - 1)]
    blocks = starts.select("_s", "_b", "_before", F.explode(F.sequence(*ends)).alias("_k")).join(plan, ["_s", "_k"])
    entry = F.struct("_k", "phase", "slot", "release", "deadline")
    own = blocks.groupBy("_s", "_b").agg(
        F.first("_before").alias("_before"), F.array_sort(F.collect_list(entry)).alias("_plan")
    )
    inside = F.row_number().over(W.partitionBy("_s", "_b").orderBy("_h", key)) - 1
    numbered = hashed.withColumn("_i", inside).join(own, ["_s", "_b"])
    number = F.col("_before") + F.col("_i")
    at = (F.floor(number / block) - F.get("_plan", F.lit(0))["_k"]).cast("int")
    placed = numbered.withColumn("_at", F.get("_plan", at))
    return placed.select(
        *kept,
        F.col("_at.phase").alias("phase"),
        F.col("_at.slot").alias("slot"),
        (number % block).cast("int").alias("place"),
        F.col("_at.release").alias("release"),
        F.col("_at.deadline").alias("deadline"),
    )
