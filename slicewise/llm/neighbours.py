"""Approximate nearest neighbours by inner product over shifted space-filling curves.

Method: vectors get one more component so that the largest inner product is the smallest distance; ORDERINGS random
projections onto AXES axes, each with a shift of its own, are put into cells and ordered along a Hilbert curve. Spark
range-partitions every ordering by its keys, which gives each vector a rank in it. A query looks at the vectors whose
rank is within a window of its own, in every ordering; the windows' candidates are scored exactly, in double
precision, block by block, and the best of all blocks are merged.

The window is measured, not guessed: for at most PROBES queries the true neighbours are found by comparing them with
all vectors, and the window is the distance of ranks that reaches REACH of these neighbours in their best ordering. So
it is narrow where the vectors have structure. Where they have none (directions without any preference in many
dimensions), no ordering keeps neighbours together, and the window covers a large share of all ranks: the search is
then no cheaper than comparing everything. That is a property of such data, and recall comes first.

Equal vectors are one candidate with the smallest ids it stands for (as many as can be asked for), so that a vector
that is very common takes no more room than another.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without an id; of several vectors with one id the least counts; of vectors of different lengths those of the most
common length (the shortest of such); ties go to the smaller id; fewer candidates than asked for are all returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import stored

ORDERINGS, AXES, BITS = 4, 8, 7
#: candidates in a block, and most queries that meet a block in one task
BLOCK, MEET = 1024, 4096
#: queries that measure the window, and the share of their true neighbours it must reach
PROBES, REACH = 64, 0.96


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of cell coordinates (n x axes, below 2^bits)."""
    x = cells.astype(np.int64).copy()
    axes = x.shape[1]
    # undo the rotations and reflections of all levels, from the coarsest on
    for level in range(bits - 1, 0, -1):
        mask = (1 << level) - 1
        for i in range(axes):
            upper = (x[:, i] >> level) & 1 == 1
            swap = np.where(upper, 0, (x[:, 0] ^ x[:, i]) & mask)
            x[:, 0] ^= np.where(upper, mask, swap)
            x[:, i] ^= swap
    # Gray code across the axes
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, axes - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[:, i] >> level) & 1)
    return key


def matrix(column: pa.Array) -> np.ndarray:
    """A list column, all of one length, as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of scores the places of the k best: highest score, then smallest id."""
    out = []
    for row in scores:
        places = np.arange(len(row))
        if len(row) > k:
            least = np.partition(row, len(row) - k)[len(row) - k]
            places = np.flatnonzero(row >= least)
        order = np.lexsort((ids[places], -row[places]))
        out.append(places[order][:k])
    return out


@dataclass(frozen=True)
class Curves:
    """Projections, their scales and shifts: everything a task needs for the keys."""

    largest: float  # squared norm
    projections: np.ndarray  # orderings x (dimensions + 1) x axes
    centre: np.ndarray
    spread: np.ndarray
    shifts: np.ndarray

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest - (vectors**2).sum(1), 0))
        wide = np.concatenate([vectors, rest[:, None]], axis=1)
        return np.einsum("nd,oda->noa", wide, self.projections)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """One key per ordering for each vector."""
        z = (self.projected(vectors) - self.centre) / self.spread
        share = 1 / (1 + np.exp(-1.702 * np.clip(z, -30, 30)))  # about the share of vectors below
        cells = np.floor((share + self.shifts) / 2 * (1 << BITS)).astype(np.int64).clip(0, (1 << BITS) - 1)
        return np.stack([hilbert(cells[:, o], BITS) for o in range(cells.shape[1])], axis=1)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) of the vectors that take part, one for each id."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    fits = F.col(key).isNotNull() & v.isNotNull() & F.coalesce(finite & some, F.lit(False))
    kept = rows.where(fits).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(v).alias("vec"))
    sizes = kept.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return kept.where(F.size("vec") == F.lit(sizes["d"] if sizes else 0))


def curves(classes: DataFrame, dimensions: int, seed: int = 7) -> Curves:
    """Random projections, scaled by the mean and spread of all vectors along them."""
    rng = np.random.default_rng(seed)
    projections = rng.standard_normal((ORDERINGS, dimensions + 1, AXES))
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    largest = classes.agg(F.max(norm)).first()[0] or 0.0
    shape = (ORDERINGS, AXES)
    plain = Curves(largest, projections, np.zeros(shape), np.ones(shape), np.zeros(shape))

    def sums(batches):
        total = np.zeros((3, ORDERINGS * AXES))
        for batch in batches:
            p = plain.projected(matrix(batch.column(0))).reshape(batch.num_rows, -1)
            total += [np.full(p.shape[1], len(p)), p.sum(0), (p**2).sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array(range(total.shape[1])), *map(pa.array, total)], ["i", "n", "s", "q"])

    found = classes.select("vec").mapInArrow(sums, "i bigint, n double, s double, q double").groupBy("i")
    rows = sorted(found.agg(F.sum("n"), F.sum("s"), F.sum("q")).collect())
    n, s, q = np.array([r[1:] for r in rows]).T.reshape(3, *shape)
    spread = np.sqrt(np.maximum(q / n - (s / n) ** 2, 1e-12))
    return Curves(largest, projections, s / n, spread, rng.random(shape))


def ranks(classes: DataFrame, plan: Curves) -> DataFrame:
    """(o, c, rank): the rank of each class in every ordering, by range partitions and their sizes."""

    def keyed(batches):
        for batch in batches:
            keys = plan.keys(matrix(batch.column(1)))
            n = batch.num_rows
            o = np.tile(np.arange(ORDERINGS, dtype=np.int32), n)
            c = batch.column(0).take(pa.array(np.repeat(np.arange(n), ORDERINGS)))
            yield pa.RecordBatch.from_arrays([pa.array(o), c, pa.array(keys.reshape(-1))], ["o", "c", "key"])

    rows = classes.select("c", "vec").mapInArrow(keyed, "o int, c bigint, key bigint")
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.repartitionByRange(parts, "o", "key", "c").sortWithinPartitions("o", "key", "c")
    dealt = stored(dealt.select("o", "c", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")), "curve")
    sizes = dealt.groupBy("o", "p").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    before = F.sum("n").over(W.partitionBy("o").orderBy("p").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("o", "p", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return dealt.join(starts, ["o", "p"]).select("o", "c", (F.col("m") - F.col("first") + F.col("before")).alias("rank"))


def window(classes: DataFrame, places: DataFrame, queries: DataFrame, k: int) -> int:
    """The distance of ranks that reaches REACH of the true neighbours of some queries."""
    some = queries.orderBy(F.xxhash64("c"), "c").limit(PROBES).join(classes, "c").select("c", "vec").toArrow()
    probes, ids = matrix(some.column("vec")), some.column("c").to_numpy()

    def compare(batches):
        for batch in batches:
            other = batch.column(0).to_numpy()
            scores = probes @ matrix(batch.column(1)).T
            scores[ids[:, None] == other[None, :]] = -np.inf
            for q, found in enumerate(best(scores, other, k)):
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, ids[q])), pa.array(other[found]), pa.array(scores[q][found])], ["q", "c", "s"]
                )

    near = classes.select("c", "vec").mapInArrow(compare, "q bigint, c bigint, s double").where("q != c")
    order = W.partitionBy("q").orderBy(F.desc("s"), "c")
    near = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("q", "c")
    mine = places.join(near.select(F.col("q").alias("c")).distinct(), "c", "left_semi").select("o", F.col("c").alias("q"), F.col("rank").alias("from"))
    apart = near.join(places, "c").join(mine, ["q", "o"]).groupBy("q", "c").agg(F.min(F.abs(F.col("rank") - F.col("from"))).alias("d"))
    got = apart.agg(F.percentile("d", REACH)).first()[0]
    return int(np.ceil(got or 0)) + 1


def search(rows: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that fits `is_query` (a condition on `id`)."""
    spark = rows.sparkSession
    vectors = stored(usable(rows, key, vector), "vectors")
    numbered = vectors.withColumn("r", F.row_number().over(W.partitionBy("vec").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = numbered.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = stored(classes.select(F.col("ids")[0].alias("c"), "ids", "vec"), "classes")
    asked = stored(vectors.where(is_query).join(classes.select("c", "vec"), "vec").select("id", "c"), "asked")
    queries = stored(asked.select("c").distinct(), "queries")
    head = classes.select(F.size("vec")).first()
    if head is None or queries.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total, n_queries = classes.count(), queries.count()
    places = stored(ranks(classes, curves(classes, head[0])), "ranks")
    reach = window(classes, places, queries, k)
    blocks = -(-total // BLOCK)
    parts = max(1, -(-n_queries * min(total, 2 * reach + BLOCK) // (total * MEET)))
    side = F.xxhash64("c", "o") % parts
    asking = places.join(queries, "c", "left_semi").withColumn("part", F.abs(side).cast("int"))
    low = F.greatest(F.floor((F.col("rank") - reach) / BLOCK), F.lit(0))
    high = F.least(F.floor((F.col("rank") + reach) / BLOCK), F.lit(blocks - 1))
    asking = asking.withColumn("block", F.explode(F.sequence(low, high))).join(classes.select("c", "vec"), "c")
    offered = places.withColumn("block", F.floor(F.col("rank") / BLOCK)).join(classes, "c")
    offered = offered.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found_schema = "c bigint, ids array<bigint>, scores array<double>"

    def meet(asked_rows: pa.Table, block: pa.Table) -> pa.Table:
        """The k + 1 best of one block for each query that looks at it."""
        c = asked_rows.column("c").to_numpy()
        ids, scores = [], []
        if len(c) and block.num_rows:
            lists = block.column("ids").combine_chunks()
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            every = lists.flatten().to_numpy()
            plain = matrix(asked_rows.column("vec")) @ matrix(block.column("vec")).T
            first = block.column("c").to_numpy()
            for row, near in zip(plain, best(plain, first, k + 1)):
                at = np.flatnonzero(np.isin(owner, near))
                order = at[np.lexsort((every[at], -row[owner[at]]))][: k + 1]
                ids.append(every[order])
                scores.append(row[owner[order]])
        else:
            c = c[:0]
        return pa.table([pa.array(c), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], ["c", "ids", "scores"])

    def merge(part: pa.Table) -> pa.Table:
        """The k + 1 best of all blocks and orderings."""
        ids = part.column("ids").combine_chunks().flatten().to_numpy()
        scores = part.column("scores").combine_chunks().flatten().to_numpy()
        ids, first = np.unique(ids, return_index=True)
        order = np.lexsort((ids, -scores[first]))[: k + 1]
        lists = [pa.array([ids[order]], pa.list_(pa.int64())), pa.array([scores[first][order]], pa.list_(pa.float64()))]
        return pa.table([part.column("c").slice(0, 1), *lists], ["c", "ids", "scores"])

    sides = ["o", "block", "part"]
    left = asking.select(*sides, "c", "vec").toDF(*sides, "c", "vec").groupBy(*sides)
    right = offered.select(*sides, "c", "ids", "vec").toDF(*sides, "c", "ids", "vec").groupBy(*sides)
    found = left.cogroup(right).applyInArrow(meet, found_schema)
    merged = found.groupBy("c").applyInArrow(merge, found_schema)
    pairs = F.arrays_zip("ids", "scores")
    own = F.slice(F.filter(pairs, lambda x: x["ids"] != F.col("id")), 1, k)
    listed = asked.join(merged, "c").select("id", F.posexplode(own).alias("p", "x"))
    return listed.select(
        F.col("id").alias("query_id"),
        (F.col("p") + 1).cast("int").alias("rank"),
        F.col("x.ids").alias("vec_id"),
        F.col("x.scores").alias("score"),
    )
