"""Near copies by MinHash: universal hash minima, banding, verification, alternating large-star and small-star.

Method: a set of word shingles is reduced to the minima of BANDS * ROWS hash functions x -> a x + b mod 2**64 of a
universal family. Sets that agree in all ROWS minima of one band meet in a bucket. Two sets of similarity J share none
with probability (1 - J**ROWS)**BANDS, at 85 percent 7e-8. Pairs are first compared by signatures (a pair at
the threshold fails by more than six standard deviations with probability 1e-9), then confirmed on their full sets.

Equal sets are one class from the start, known by two independent digests. No bucket is expanded into all its pairs at
once: in each of TRIES rounds the members of a bucket meet one hub, links are confirmed, components merged, and only
members outside the next hub's component meet it. After that, pairs that are still in different components are formed
and confirmed, however many there are. A pair that is left out is in one component already.

Links are reduced by alternating large-star and small-star steps, every one of them written to the shared folder, until
each vertex has one edge, to the least vertex of its component.

Defined results: a document without words (or null) has 0 shingles and no links, its component is its own id, it is
kept; one with fewer words than a shingle has one shingle, the whole sequence. Ids may repeat: rows are told apart by
content, and all rows with a component's smallest id are kept. A row without an id gets the smallest id of its
component (null if it has none) and is not kept. Other columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .jaccard import digests, parity_maps, shingle_sets
from .tables import stored

WORDS, PERCENT = 5, 85
#: minima of a signature
BANDS, ROWS = 28, 5
#: rounds in which the members of a bucket meet one hub
TRIES = 2
#: 64-bit numbers of the folded parity map of a set, and of the lowest bits of its minima
FOLDS, LOWS = 8, 2
MAP = [f"p{k}" for k in range(FOLDS)]
LOW = [f"m{k}" for k in range(LOWS)]
#: bits of the filter that tells which sets are needed
FILTER_BITS = 1 << 25
_RNG = np.random.Generator(np.random.PCG64(20240229))
_A = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_MIX = _RNG.integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1)


def minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The upper halves of the minima of every hash function, a row for each set; sets must not be empty."""
    found = np.empty((len(starts) - 1, BANDS * ROWS), np.uint32)
    if len(found):
        x = values.view(np.uint64)
        with np.errstate(over="ignore"):
            for k in range(BANDS * ROWS):
                found[:, k] = np.minimum.reduceat(x * _A[k] + _B[k], starts[:-1]) >> np.uint64(32)
    return found


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit name of the bucket of each band."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        sums = (parts * _MIX).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
        return arrays.mixed(sums * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def agreements_wanted(percent: int) -> int:
    """Agreeing minima that a pair at the threshold misses by chance once in 1e9."""
    k, p = BANDS * ROWS, percent / 100
    return math.floor(k * p - 6 * math.sqrt(k * p * (1 - p)))


def differences_allowed(percent: int) -> int:
    """The like for the lowest bits of the first 128 minima, which agree by chance in one of two cases."""
    p = (1 - percent / 100) / 2
    return math.ceil(128 * p + 6 * math.sqrt(128 * p * (1 - p)))


def sketches(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, n, v1, v2, LOW, MAP, sig) per row: size and digests of its set; a task gives each signature once."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for low, high, data, rows in arrays.pieces(batch.column(1)):
                values, starts = shingle_sets(data, rows, words)
                sizes, k = np.diff(starts), high - low
                v1, v2 = digests(values, starts, 1), digests(values, starts, 2)
                chosen = []
                for i, name in enumerate(zip(v1.tolist(), v2.tolist())):
                    if sizes[i] and name not in seen:
                        seen.add(name)
                        chosen.append(i)
                at = np.concatenate([[0], np.cumsum(sizes[chosen])]).astype(np.int64)
                kept = np.concatenate([values[starts[i] : starts[i + 1]] for i in chosen]) if chosen else values[:0]
                found = minima(kept, at)
                sig, bits = [None] * k, np.zeros((k, LOWS + FOLDS), np.int64)
                for j, i in enumerate(chosen):
                    sig[i] = found[j].tobytes()
                bits[chosen, :LOWS] = np.packbits((found[:, : 64 * LOWS] & 1).astype(np.uint8), axis=1).view(np.int64)
                wide = parity_maps(kept, at)
                for f in range(FOLDS):
                    bits[chosen, LOWS + f] = np.bitwise_xor.reduce(wide[:, f::FOLDS], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, k), pa.array(sizes.astype(np.int64)), pa.array(v1), pa.array(v2),
                     *[pa.array(np.ascontiguousarray(b)) for b in bits.T], pa.array(sig, pa.binary())],
                    ["id", "n", "v1", "v2", *LOW, *MAP, "sig"],
                )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, " + "".join(f"{x} bigint, " for x in ("n", "v1", "v2", *LOW, *MAP)) + "sig binary"
    return docs.select(key, text).mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    width = BANDS * ROWS
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, width)


def dealt(classes: DataFrame) -> DataFrame:
    """(key, c) of the buckets of every class."""

    def run(batches):
        for batch in batches:
            keys = band_keys(_matrix(batch.column(1)))
            names = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(names)], ["key", "c"])

    return classes.select("c", "sig").mapInArrow(run, "key bigint, c bigint")


def by_signature(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow the similarity."""
    least = agreements_wanted(percent)

    def run(batches):
        for batch in batches:
            same = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(axis=1)
            yield batch.select([0, 1]).filter(pa.array(same >= least))

    one = classes.select(F.col("c").alias("a"), "n", "sig")
    two = classes.select(F.col("c").alias("b"), F.col("n").alias("n2"), F.col("sig").alias("sig2"))
    met = pairs.join(one, "a").join(two, "b").where(100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
    return met.select("a", "b", "sig", "sig2").mapInArrow(run, "a bigint, b bigint")


def wanted_sets(docs: DataFrame, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """(c, shingles) of the classes in `wanted` (c, v1, v2).

    A filter of FILTER_BITS bits, built by tasks and of that size whatever the number of sets, goes to the tasks that
    read the documents; what it lets through by chance joins with nothing.
    """
    cells = wanted.select(
        F.floor(F.pmod("v1", F.lit(FILTER_BITS)) / 64).cast("int").alias("cell"),
        F.expr(f"shiftleft(1L, cast(pmod(v1, {FILTER_BITS}) % 64 as int))").alias("bit"),
    )
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[found.column("cell").to_numpy()] = found.column("bits").to_numpy()
    shipped = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        bits, seen = shipped.value.view(np.uint64), set()
        for batch in batches:
            for _, _, data, rows in arrays.pieces(batch.column(0)):
                values, starts = shingle_sets(data, rows, words)
                v1, v2 = digests(values, starts, 1), digests(values, starts, 2)
                at = v1 % FILTER_BITS
                keep = (bits[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1
                chosen = []
                for k in np.flatnonzero(keep & (np.diff(starts) > 0)).tolist():
                    if (name := (int(v1[k]), int(v2[k]))) not in seen:
                        seen.add(name)
                        chosen.append(k)
                sets = pa.array([values[starts[k] : starts[k + 1]] for k in chosen], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(v1[chosen]), pa.array(v2[chosen]), sets], ["v1", "v2", "shingles"])

    sets = docs.select(text).mapInArrow(run, "v1 bigint, v2 bigint, shingles array<bigint>")
    return sets.join(wanted, ["v1", "v2"]).select("c", "shingles").dropDuplicates(["c"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("c").alias("a"), F.col("shingles").alias("left"))
    two = sets.select(F.col("c").alias("b"), F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right")).cast("long")
    total = (F.size("left") + F.size("right")).cast("long")
    met = pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("i"), total.alias("t"))
    return met.where(100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("a", "b")


def large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a vertex is linked with the least one among the vertex and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its lesser neighbours are linked with the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def star_components(links: DataFrame) -> DataFrame:
    """(c, label): every vertex of the links (a, b) but the least of its component, with that least one."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        twice = edges.groupBy("u").agg(F.count("*").alias("k")).where("k > 1").select("u")
        inner = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u")
        if twice.unionByName(inner).isEmpty():
            return edges.select(F.col("u").alias("c"), F.col("v").alias("label"))
        edges = stored(small_star(stored(large_star(edges), "edges")), "edges")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (c, label) after the links (a, b) join their components."""
    if links.isEmpty():
        return labels
    of_a = links.join(labels.toDF("a", "la"), "a", "left").withColumn("la", F.coalesce("la", "a"))
    of_b = of_a.join(labels.toDF("b", "lb"), "b", "left").withColumn("lb", F.coalesce("lb", "b"))
    moved = star_components(of_b.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    old = labels.join(moved.toDF("label", "to"), "label", "left").select("c", F.coalesce("to", "label").alias("label"))
    # a label that moves may be a class without a row of its own, and so may a class that only now has a link
    new = moved.join(labels.select("c"), "c", "left_anti")
    return stored(old.unionByName(new), "labels")


def class_labels(docs: DataFrame, classes: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """(c, label) of the classes that are linked with a lesser one."""
    spread = dealt(classes)
    several = spread.groupBy("key").agg((F.min("c") != F.max("c")).alias("several")).where("several").select("key")
    entries = stored(spread.join(several, "key"), "buckets")
    inside = classes.join(entries.select("c").distinct(), "c", "left_semi")
    signed = stored(inside.select("c", "n", *LOW, *MAP, "sig"), "signatures")
    sets = stored(wanted_sets(docs, text, words, inside.select("c", "v1", "v2")), "sets")
    spark = docs.sparkSession
    labels = spark.createDataFrame([], "c bigint, label bigint")
    tried = spark.createDataFrame([], "a bigint, b bigint")

    def placed() -> DataFrame:
        """(key, c, label) of the buckets whose members are not all in one component."""
        rows = entries.join(labels, "c", "left").select("key", "c", F.coalesce("label", "c").alias("label"))
        open_keys = rows.groupBy("key").agg((F.min("label") != F.max("label")).alias("open")).where("open")
        return stored(rows.join(open_keys.select("key"), "key"), "placed")

    def linked(pairs: DataFrame) -> DataFrame:
        near = stored(by_signature(pairs, signed, percent), "near")
        return stored(confirmed(near, sets, percent), "links")

    for turn in range(TRIES):
        rows = placed()
        if rows.isEmpty():
            return labels
        order = F.struct((F.xxhash64("c", F.lit(turn)) if turn else F.col("c")).alias("place"), "c", "label")
        hubs = rows.groupBy("key").agg(F.min(order).alias("hub")).select("key", F.col("hub.c").alias("hub"), F.col("hub.label").alias("at"))
        met = rows.join(hubs, "key").where("label <> at").select(F.least("hub", "c").alias("a"), F.greatest("hub", "c").alias("b"))
        fresh = stored(met.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionByName(fresh)
        labels = merged(labels, linked(fresh))
    # whatever is left: members of one bucket in different components. At least as many shingles differ as bits of the
    # parity maps; pairs that these or the minima's lowest bits rule out are never formed.
    rows = placed().join(signed.select("c", "n", *LOW, *MAP), "c")
    other = rows.select("key", *[F.col(x).alias(f"{x}_2") for x in ("c", "label", "n", *LOW, *MAP)])
    minima_apart, apart = (
        sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"{x}_2"))) for x in bits), F.lit(0)) for bits in (LOW, MAP)
    )
    fits = (100 * F.least("n", "n_2") >= percent * F.greatest("n", "n_2")) & (
        (100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("n_2"))
    )
    open_pairs = rows.join(other, "key").where(
        (F.col("c") < F.col("c_2")) & (F.col("label") != F.col("label_2")) & fits & (minima_apart <= differences_allowed(percent))
    )
    left = open_pairs.select(F.col("c").alias("a"), F.col("c_2").alias("b")).distinct()
    return merged(labels, linked(stored(left.join(tried, ["a", "b"], "left_anti"), "pairs")))


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT):
    """(key, n_shingles, component_id, kept) of every row: the component by its smallest id."""
    rows = stored(sketches(docs, key, text, words).withColumn("row", F.monotonically_increasing_id()), "sketches")
    # the row numbers are those of the written table; a class is named by the first row that gives its signature
    firsts = rows.where("sig is not null").groupBy("v1", "v2").agg(F.min("row").alias("c"))
    names = stored(firsts, "names")
    named = rows.where("sig is not null").join(names.select("c"), F.col("row") == F.col("c"))
    classes = stored(named.select("c", "n", "v1", "v2", *LOW, *MAP, "sig"), "classes")
    labels = class_labels(docs, classes, text, words, percent)
    least = rows.where("n > 0").groupBy("v1", "v2").agg(F.min("id").alias("least"))
    known = names.join(least, ["v1", "v2"]).join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    smallest = known.groupBy("label").agg(F.min("least").alias("component_id"))
    found = stored(known.join(smallest, "label").select("v1", "v2", "component_id"), "components")
    some = rows.select("id", "n", *[F.when(F.col("n") > 0, F.col(v)).alias(v) for v in ("v1", "v2")])
    return some.join(found, ["v1", "v2"], "left").select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"),
    )
