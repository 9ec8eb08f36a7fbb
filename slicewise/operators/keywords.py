"""Scanning for the keywords of a table: an Aho-Corasick automaton over slices.

Every occurrence counts, also inside another keyword. The table of keywords is checked for its size first. Up to SHARD_BYTES of
them make one automaton, which is shipped once to every worker; a larger table is dealt into shards by hash, each with
an automaton of at most about that size, and the slices are read once for each shard. So neither the driver nor a task ever holds
more than a shard, and no slice is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boundary import MARGIN, id_columns, seams, windows

#: bytes of keywords in one automaton, with KEYWORD_COST bytes counted for each keyword besides its own
SHARD_BYTES, KEYWORD_COST = 16 << 20, 32

_BUILT: dict[str, object] = {}


def automaton(shipped):
    """The automaton of a broadcast list of keywords, built once in a worker."""
    import ahocorasick

    if shipped.id not in _BUILT:
        _BUILT.clear()
        built = ahocorasick.Automaton()
        for k, word in enumerate(shipped.value):
            built.add_word(word.decode("latin-1"), (k, len(word)))
        built.make_automaton()
        _BUILT[shipped.id] = built
    return _BUILT[shipped.id]


class _Shipped:
    """A broadcast with a name that its workers share."""

    def __init__(self, broadcast, name: str):
        self.broadcast, self.id = broadcast, name

    @property
    def value(self):
        return self.broadcast.value


def scan_keywords(slices: DataFrame, keywords: DataFrame, keyword: str = "keyword", context: int = MARGIN) -> DataFrame:
    """(ids, offset, keyword) of every place of every keyword; a match belongs to the slice of its first byte.

    Keywords are text (as UTF-8) or bytes, null and empty ones count for nothing, repeated ones once. Slices with context
    must carry at least the longest keyword of it, of which `context` bytes are assumed; the boundaries of slices without
    context are read through `seams`.
    """
    spark = slices.sparkSession
    as_text = isinstance(keywords.schema[keyword].dataType, T.StringType)
    listed = keywords.select(F.col(keyword).cast("binary").alias("w")).where(F.length("w") > 0).distinct()
    size = listed.agg(F.max(F.length("w")).alias("longest"), F.sum(F.length("w") + KEYWORD_COST).alias("bytes")).first()
    longest, shards = size["longest"] or 1, -(-(size["bytes"] or 0) // SHARD_BYTES) or 1
    if "before" in slices.columns or "own_from" in slices.columns:
        if longest > context:
            raise ValueError(f"a keyword of {longest} bytes is longer than the context of {context}")
    else:
        slices = seams(slices, longest)
    ids = id_columns(slices)
    rows = windows(slices).select(*ids, "base", "buffer", "own_from", "own_to")
    schema = T.StructType([*[rows.schema[c] for c in ids], T.StructField("offset", T.LongType()), T.StructField("keyword", T.BinaryType())])
    found = None
    for shard in range(shards):
        part = listed.where(F.pmod(F.xxhash64("w"), F.lit(shards)) == shard)
        words = [bytes(r.w) for r in part.collect()]
        if words:
            shipped = _Shipped(spark.sparkContext.broadcast(words), uuid.uuid4().hex)
            hits = rows.mapInArrow(_finder(shipped, len(ids), schema), schema)
            found = hits if found is None else found.unionByName(hits)
    found = spark.createDataFrame([], schema) if found is None else found
    return found.withColumn("keyword", F.col("keyword").cast("string")) if as_text else found


def _finder(shipped: _Shipped, n_ids: int, schema: T.StructType):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target, built, words = to_arrow_schema(schema), automaton(shipped), shipped.value
        for batch in batches:
            row, offset, word = [], [], []
            base, buffer, low, high = (batch.column(n_ids + k) for k in range(4))
            for n in range(batch.num_rows):
                start, own_from, own_to = base[n].as_py(), low[n].as_py(), high[n].as_py()
                for last, (k, length) in built.iter(buffer[n].as_py().decode("latin-1")):
                    at = start + last - length + 1
                    if own_from <= at < own_to:
                        row.append(n)
                        offset.append(at)
                        word.append(words[k])
            taken = [batch.column(k).take(pa.array(row, pa.int64())) for k in range(n_ids)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(offset, pa.int64()), pa.array(word, pa.binary())], schema=target)

    return run
