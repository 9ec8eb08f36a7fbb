"""Near copies by the Jaccard similarity of word shingles: an exact, grouped prefix join.

Method: the shingles of all documents have one order, rare before frequent. If two sets are similar enough, their
prefixes in that order (n - ceil(t n) + 1 shingles) share a shingle. Documents with the same prefix and the same size
are collapsed into one group; only groups are matched, through the shingles of their prefixes; pairs of groups that
are left after the size filter are expanded to their members, and members are verified on their whole sets. The size
filter knows more than sizes: where all rare shingles of a set are in its prefix, it has none that only another prefix has.

Equal sets are one class from the start. Links are verified in two rounds, and no list of similar documents is ever
expanded into all its pairs: first, each group meets the hubs of the shingles it shares (HUBS groups of each), and each
member of a group the group's first member; in ROUNDS more rounds, what is not in its component meets one more hub;
then only pairs that are still in different components, of shingles whose documents
are not all in one component, are verified. A pair that is left out is in one component already, so the components
are those of all links.

The order needs no exact frequencies to be right, only the same order everywhere: the shingles that repeat within
tasks are counted, and the most frequent of these (at most FREQUENT) go last. They are also the only ones that can be
hot, and are matched through a broadcast of that bounded list instead of a shuffle.

A shingle, a set and a prefix stand for their 64-bit hashes. Classes are keyed by content, not by id, so repeated ids
and rows without an id are documents of their own.

Defined results: a document without words (or null) has 0 shingles and no links, its component is its own id; one
with fewer words than a shingle has one shingle, the whole sequence; ids may repeat; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrays
from .components import components
from .tables import frequent, stored

WORDS, PERCENT = 4, 85
#: shingles in the list of frequent ones
FREQUENT = 1 << 17
#: groups of a shingle that its other groups are matched with first, and the orders they are least in
HUBS, TRIES = 4, 10
#: further rounds with one hub of each shingle whose groups are not yet in one component
ROUNDS = 1
ORDERS = [k * 0x0F1BBCDCBFA53E0B % (1 << 63) for k in range(HUBS)]
#: 64-bit numbers of a parity map; they are folded into FOLDS of them, in columns, where pairs are looked for
MAPS, FOLDS = 32, 4
BITS = [f"b{k}" for k in range(FOLDS)]
#: shingles a task looks at together when it counts repetitions
HELD = 6 << 20
#: bytes of text that are worked on at once, and rows whose parity maps are counted at once
PIECE_BYTES, MAP_ROWS = 1 << 19, 256
#: bits of the filter that tells which sets are needed
FILTER_BITS = 1 << 25
_FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64
)


def shingle_sets(data: np.ndarray, rows: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(the sorted distinct shingles of each row as int64, all in one array; where each row begins in it)."""
    values, before = arrays.words(data, rows)
    hashed = arrays.hashes(values)
    n = len(hashed)
    with np.errstate(over="ignore"):
        factor = [_FACTORS[k % len(_FACTORS)] * np.uint64(2 * k + 1) for k in range(words)]
        wide = np.zeros(max(0, n - words + 1), np.uint64)
        for k in range(words):
            wide += hashed[k : n - words + 1 + k] * factor[k]
        wide = arrays.mixed(wide).view(np.int64)
        parts = []
        for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
            if b - a >= words:
                part = wide[a : b - words + 1].copy()
                part.sort()
            elif b > a:
                short = np.array([np.uint64(b - a) * _FACTORS[4]])
                for k in range(b - a):
                    short = arrays.mixed(short + hashed[a + k] * factor[k])
                part = short.view(np.int64)
            else:
                part = np.zeros(0, np.int64)
            parts.append(part)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    keep = np.ones(len(flat), bool)
    keep[1:] = flat[1:] != flat[:-1]
    keep[ends[:-1][ends[:-1] < len(flat)]] = True
    return flat[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def digests(values: np.ndarray, starts: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each row's values as a set."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(arrays.mixed(values.view(np.uint64) + np.uint64(salt)), out=sums[1:])
        total = sums[starts[1:]] - sums[starts[:-1]] + np.diff(starts).astype(np.uint64)
        return arrays.mixed(total).view(np.int64)


def parity_maps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MAPS 64-bit numbers for each row: a bit is set if an odd number of its shingles fall on it.

    The bits in which two maps differ are at most as many as the shingles that only one of the sets has. That also
    holds for maps that are folded by exclusive or.
    """
    width, parts = 64 * MAPS, [np.zeros((0, MAPS), np.int64)]
    for low in range(0, len(starts) - 1, MAP_ROWS):
        ends = starts[low : low + MAP_ROWS + 1]
        rows = len(ends) - 1
        row = np.repeat(np.arange(rows), np.diff(ends))
        at = row * width + ((values[ends[0] : ends[-1]] >> 9) & (width - 1))
        odd = (np.bincount(at, minlength=rows * width) & 1).astype(np.uint8).reshape(rows, width)
        parts.append(np.packbits(odd, axis=1).view(np.int64))
    return np.concatenate(parts)


def prefix_length(n, percent: int):
    return n + (-percent * n) // 100 + 1


def prefix(values: np.ndarray, length: int, last: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set in the common order, the rare and the frequent ones of them.

    `last` (sorted) are the frequent shingles, `weight` says how frequent. Only as much of the set is compared with
    them as it takes to find enough rare ones.
    """
    if not len(last):
        return values[:length], values[:0]
    size = length
    while True:
        head = values[:size]
        at = np.minimum(np.searchsorted(last, head), len(last) - 1)
        hot = last[at] == head
        cold = head[~hot]
        if len(cold) >= length:
            return cold[:length], head[:0]
        if size >= len(values):
            break
        size = min(len(values), 2 * size)
    rest, at = head[hot], at[hot]
    return cold, rest[np.lexsort((rest, weight[at]))][: length - len(cold)]


def repeated_values(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur more than once, and how often; `values` is sorted in place."""
    values.sort()
    same = values[1:] == values[:-1]
    first, last = same.copy(), same.copy()
    first[1:] &= ~same[:-1]
    last[:-1] &= ~same[1:]
    begin = np.flatnonzero(first)
    return values[begin], np.flatnonzero(last) - begin + 2


def signatures(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, n, v) per row, v naming its set, and (shingle, times) for shingles that repeat among a task's rows."""

    def run(batches):
        # one array is filled and sorted in place; pages that are not reached take no memory
        held, size = np.empty(HELD, np.int64), 0

        def repeated():
            values, counts = repeated_values(held[:size])
            none = len(values)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(none, kind), pa.nulls(none, pa.int32()), pa.nulls(none, pa.int64()), pa.array(values),
                 pa.array(counts.astype(np.int64))], names,
            )

        names, kind = ["id", "n", "v", "shingle", "times"], pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            for low, high, data, rows in arrays.pieces(batch.column(1), PIECE_BYTES):
                values, starts = shingle_sets(data, rows, words)
                n, sizes = high - low, np.diff(starts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, n), pa.array(sizes.astype(np.int32)),
                     pa.array(digests(values, starts, 1), mask=sizes == 0), pa.nulls(n, pa.int64()),
                     pa.nulls(n, pa.int64())], names,
                )
                if size + len(values) > len(held):
                    yield from repeated()
                    held, size = np.empty(max(HELD, len(values)), np.int64), 0
                held[size : size + len(values)] = values
                size += len(values)
        if size:
            yield from repeated()

    schema = f"id {docs.schema[key].dataType.simpleString()}, n int, v bigint, shingle bigint, times bigint"
    return docs.select(key, text).mapInArrow(run, schema)


def prefixes(docs: DataFrame, text: str, words: int, percent: int, last: np.ndarray, weight: np.ndarray) -> DataFrame:
    """(v, n, g, cold, hot, map, BITS): the sets of a task, each once, with the shingles of their prefixes.

    g names the group: all sets of one size with one prefix. `map` is the set's parity map, BITS the folded one.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((last, weight))

    def run(batches):
        last, weight = shipped.value
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, rows in arrays.pieces(batch.column(0), PIECE_BYTES):
                values, starts = shingle_sets(data, rows, words)
                names, sizes = digests(values, starts, 1).tolist(), np.diff(starts).tolist()
                chosen = []
                for k, name in enumerate(names):
                    if sizes[k] and name not in seen:
                        seen.add(name)
                        chosen.append(k)
                both = [
                    prefix(values[starts[k] : starts[k + 1]], prefix_length(sizes[k], percent), last, weight) for k in chosen
                ]
                n = np.array([sizes[k] for k in chosen], np.int64)
                cold, hot = [pa.array([p[i] for p in both], pa.list_(pa.int64())) for i in (0, 1)]
                first = np.concatenate([x for p in both for x in p]) if both else np.zeros(0, np.int64)
                ends = np.concatenate([[0], np.cumsum([len(p[0]) + len(p[1]) for p in both])]).astype(np.int64)
                maps = parity_maps(values, starts)[chosen]
                with np.errstate(over="ignore"):
                    g = arrays.mixed(digests(first, ends, 2).view(np.uint64) + n.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[k] for k in chosen], pa.int64()), pa.array(n, pa.int32()), pa.array(g), cold, hot,
                     pa.array(list(maps), pa.list_(pa.int64())),
                     *[pa.array(np.bitwise_xor.reduce(maps[:, k::FOLDS], axis=1)) for k in range(FOLDS)]],
                    ["v", "n", "g", "cold", "hot", "map", *BITS],
                )

    schema = "v bigint, n int, g bigint, cold array<bigint>, hot array<bigint>, map array<bigint>, " + ", ".join(f"{b} bigint" for b in BITS)
    return docs.select(text).mapInArrow(run, schema)


def wanted_sets(docs: DataFrame, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """(v, shingles) of the sets named in `wanted` (v, may repeat), each once in a task, and of some more.

    A filter of FILTER_BITS bits, built by tasks and of that size whatever the number of sets, goes to the tasks that
    read the documents; what it lets through by chance meets no pair.
    """
    bit = F.pmod("v", F.lit(FILTER_BITS))
    cells = wanted.select(F.floor(bit / 64).cast("int").alias("cell"), F.expr(f"shiftleft(1L, cast(pmod(v, {FILTER_BITS}) % 64 as int))").alias("bit"))
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[found.column("cell").to_numpy()] = found.column("bits").to_numpy()
    shipped = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        bits, seen = shipped.value.view(np.uint64), set()
        for batch in batches:
            for _, _, data, rows in arrays.pieces(batch.column(0), PIECE_BYTES):
                values, starts = shingle_sets(data, rows, words)
                names = digests(values, starts, 1)
                at = names % FILTER_BITS
                keep = (bits[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1
                chosen = []
                for k in np.flatnonzero(keep & (np.diff(starts) > 0)).tolist():
                    if names[k] not in seen:
                        seen.add(names[k])
                        chosen.append(k)
                sets = pa.array([values[starts[k] : starts[k + 1]] for k in chosen], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(names[chosen]), sets], ["v", "shingles"])

    return docs.select(text).mapInArrow(run, "v bigint, shingles array<bigint>")


def verified(pairs: DataFrame, maps: DataFrame, docs: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b), each given once, whose sets are similar enough.

    `maps` (v, n, map; each v once) rules out most others before any set is moved. Then each set is dealt out once, and
    one of the two once more for each pair.
    """
    left = maps.select(F.col("v").alias("a"), "n", "map")
    right = maps.select(F.col("v").alias("b"), F.col("n").alias("n2"), F.col("map").alias("map2"))
    near = pairs.join(left, "a").join(right, "b")
    apart = F.aggregate(
        F.zip_with("map", "map2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0).cast("int"), lambda s, x: s + x
    )
    near = near.where((100 + percent) * apart.cast("long") <= (100 - percent) * (F.col("n") + F.col("n2")).cast("long"))
    pairs = stored(near.select("a", "b"), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("v"))
    # equal sets of different tasks meet here; the exchange serves both sides
    sets = wanted_sets(docs, text, words, ends).repartition("v").dropDuplicates(["v"])
    left = pairs.join(sets, pairs["a"] == sets["v"]).select("a", "b", F.col("shingles").alias("left"))
    right = sets.select(F.col("v").alias("w"), F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    total = F.size("left") + F.size("right")
    joined = left.join(right, F.col("b") == F.col("w")).select("a", "b", both.alias("i"), total.alias("n"))
    return joined.where(100 * F.col("i").cast("long") >= percent * (F.col("n") - F.col("i"))).select("a", "b")


def ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def joined_labels(placed: DataFrame, links: DataFrame) -> DataFrame:
    """`placed` (v, label, ...) after links (a, b) join their components."""
    of = placed.select("v", "label")
    bridges = links.join(of.toDF("a", "la"), "a").join(of.toDF("b", "lb"), "b").select(
        F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")
    )
    bridges = stored(bridges.where("a != b").distinct(), "bridges")
    if bridges.isEmpty():
        return placed
    whole = components(bridges).toDF("label", "whole")
    after = placed.join(whole, "label", "left").withColumn("label", F.coalesce("whole", "label"))
    return stored(after.select(*placed.columns), "placed")


def class_labels(docs: DataFrame, marks: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """(v, label): the component of every class."""
    repeated = marks.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times"))
    listed = frequent(repeated, "times", FREQUENT).toArrow().sort_by("shingle")
    last, weight = listed.column("shingle").to_numpy(), listed.column("times").to_numpy()
    rows = stored(prefixes(docs, text, words, percent, last, weight), "prefixes")
    # equal sets of different tasks meet here
    members = stored(rows.select("v", "n", "g", "map").dropDuplicates(["v"]), "members")
    maps, members = members.select("v", "n", "map"), members.select("v", "n", "g")
    firsts = members.groupBy("g").agg(F.min("v").alias("first"))
    cold = rows.select(F.posexplode("cold").alias("at", "shingle"), "g")
    warm = rows.where(F.size("hot") > 0).select(F.size("cold").alias("c"), F.posexplode("hot").alias("at", "shingle"), "g")
    warm = warm.select((F.col("at") + F.col("c")).alias("at"), "shingle", "g")
    # the shingles that two groups share: rare ones are dealt out once; frequent ones are at most FREQUENT, so their
    # list is joined where they are read
    of = W.partitionBy("shingle")
    cold = cold.withColumn("low", F.min("g").over(of)).withColumn("high", F.max("g").over(of)).where("low != high")
    met = warm.groupBy("shingle").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low != high")
    warm = warm.join(F.broadcast(met.select("shingle")), "shingle")
    columns = ["shingle", "g", "at"]
    shared = stored(cold.select(*columns).unionByName(warm.select(*columns)).distinct(), "shared")
    # a group whose prefix reaches the frequent shingles has all its rare ones in the prefix; so it cannot have those
    # rare shingles of another group that no other prefix has: at most m of that group's n are in both
    has = rows.groupBy("g").agg(
        F.min("n").alias("n"), F.min(F.size("cold")).alias("c"), F.min(F.size("hot")).alias("w"),
        (F.min("v") == F.max("v")).alias("single"), *[F.min(b).alias(b) for b in BITS],
    )
    met = shared.join(has.select("g", "c"), "g").groupBy("g").agg(F.count(F.when(F.col("at") < F.col("c"), 1)).alias("k"))
    own = [F.when(F.col("single"), F.col(b)).alias(b) for b in BITS]
    bounds = has.join(met, "g").select("g", "n", (F.col("w") > 0).alias("all_rare"), (F.col("n") - (F.col("c") - F.col("k"))).alias("m"), *own)
    bounds = stored(bounds, "bounds")
    facts = ["n", "all_rare", "m", *BITS]
    theirs = [f"{c}2" for c in facts]

    def fits():
        """Whether two groups could be similar enough, by sizes, rare shingles and parity maps."""
        one = F.when(F.col("all_rare2"), F.col("m")).otherwise(F.col("n"))
        two = F.when(F.col("all_rare"), F.col("m2")).otherwise(F.col("n2"))
        most, total = F.least(one, two).cast("long"), F.col("n") + F.col("n2")
        apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}2"))) for b in BITS), F.lit(0))
        differ = F.coalesce(apart, F.lit(0)).cast("long")
        return (100 * most >= percent * (total - most)) & ((100 + percent) * differ <= (100 - percent) * total)

    # hubs of a shingle: the least groups in HUBS different orders
    dealt = shared.select("shingle", "g").repartition("shingle")
    hubs = [F.min(F.col("g").bitwiseXOR(F.lit(c))).bitwiseXOR(F.lit(c)).alias(f"h{k}") for k, c in enumerate(ORDERS)]
    hubs = dealt.groupBy("shingle").agg(F.count("*").alias("df"), *hubs)
    hubs = hubs.select(F.col("shingle").alias("s"), (F.col("df") > 2).alias("more"), F.array_distinct(F.array(*[f"h{k}" for k in range(HUBS)])).alias("hubs"))
    stars = dealt.join(hubs, F.col("shingle") == F.col("s")).select("g", "more", F.explode("hubs").alias("hub"))
    # pairs that only shingles of two groups give are all tried; of the others, those of each group that share most
    stars = stars.where("g != hub").select("g", "hub", "more").groupBy("g", "hub").agg(
        F.count("*").alias("k"), F.min("more").alias("more")
    ).repartition("g")
    best = F.row_number().over(W.partitionBy("g", "more").orderBy(F.desc("k"), "hub"))
    stars = stars.withColumn("r", best).where((F.col("r") <= TRIES) | ~F.col("more")).select("g", "hub").join(bounds, "g")
    stars = stars.join(bounds.select("g", *facts).toDF("hub", *theirs), "hub").where(fits())
    # each member meets the first members of the hubs that its group shares most with, and of its own group
    stars = stars.select("g", F.col("hub").alias("h")).join(firsts.withColumnRenamed("g", "h"), "h").select("g", "first")
    tried = ordered(members.join(stars, "g"), "v", "first").unionByName(ordered(members.join(firsts, "g"), "v", "first"))
    # written, as later rounds leave these pairs out
    tried = stored(tried.distinct(), "candidates")
    links = stored(verified(tried, maps, docs, text, words, percent), "links")
    label = F.coalesce("label", F.col("v")).alias("label")
    placed = stored(members.join(components(links), "v", "left").select("v", "n", "g", label), "placed")

    def left(placed, source):
        """(groups with their labels, and the shingles whose groups are not all in one component)."""
        several = (F.count("*") > 1).alias("several")
        state = placed.groupBy("g").agg(F.min("label").alias("low"), F.max("label").alias("high"), several)
        wide = source.join(state, "g")
        mixed = wide.groupBy("shingle").agg(F.min("low").alias("l"), F.max("high").alias("h"), (F.count("*") > 2).alias("more"), F.max("several").alias("several"))
        mixed = mixed.where("l != h and (more or several)").select("shingle")
        return state, stored(wide.drop("several").join(mixed, "shingle").join(bounds, "g"), "mixed")

    # members in different components meet the first member of one more hub of each shingle, in a new order each round
    state, every = left(placed, shared)
    for turn in range(ROUNDS):
        if every.isEmpty():
            break
        # first the most central one, which has the fewest shingles of its own; then any
        own = F.when(F.col("all_rare"), F.col("n") - F.col("m")).otherwise(F.col("n")).cast("long")
        place = own if turn == 0 else F.xxhash64("g", F.lit(turn))
        hubs = every.groupBy("shingle").agg(F.min(F.struct(place.alias("place"), "g")).alias("hub"))
        met = every.join(hubs.select("shingle", F.col("hub.g").alias("hub")), "shingle").where("g != hub")
        met = met.select("g", *facts, "hub").distinct().join(bounds.select("g", *facts).toDF("hub", *theirs), "hub").where(fits())
        first = firsts.toDF("hub", "first").join(placed.select(F.col("v").alias("first"), F.col("label").alias("at")), "first")
        met = met.select("g", "hub").join(first, "hub").select("g", "first", "at").join(placed, "g").where("label != at")
        fresh = stored(ordered(met, "v", "first").distinct().join(tried, ["a", "b"], "left_anti"), "candidates")
        if fresh.isEmpty():
            continue
        tried = tried.unionByName(fresh)
        after = joined_labels(placed, stored(verified(fresh, maps, docs, text, words, percent), "links"))
        if after is not placed:
            placed = after
            state, every = left(placed, every.select(*columns))  # components only grow, so no other shingle comes in question

    # what is left: members in different components whose groups share a shingle with further groups
    # one of any two components is not the shingle's largest one, so only groups outside that one look for partners
    largest = every.groupBy("shingle", "low").agg(F.count("*").alias("k"))
    largest = largest.groupBy("shingle").agg(F.max(F.struct("k", "low")).alias("top")).select("shingle", "top.low")
    largest = largest.withColumnRenamed("low", "top")
    outside = every.join(largest, "shingle").where("low != high or low != top")
    other = every.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("g", "at", *facts, "low", "high")])
    apart = (F.col("low") != F.col("low2")) | (F.col("high") != F.col("high2")) | (F.col("low") != F.col("high"))
    # if this is the first shingle that both have, they share no more than what comes from it on; where it is not the
    # first, the first one gives the pair
    common = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")).cast("long")
    first = (100 + percent) * common >= percent * (F.col("n") + F.col("n2"))
    pairs = outside.join(other, "shingle").where((F.col("g") != F.col("g2")) & first & fits() & apart)
    pairs = ordered(pairs, "g", "g2").distinct().toDF("g", "g2")
    pairs = pairs.unionByName(state.where("low != high").select("g", F.col("g").alias("g2")))
    one = placed.select(F.col("v").alias("a"), "g", F.col("label").alias("la"))
    two = placed.select(F.col("v").alias("b"), F.col("g").alias("g2"), F.col("label").alias("lb"))
    rest = ordered(pairs.join(one, "g").join(two, "g2").where("la != lb"), "a", "b")
    rest = stored(rest.join(tried, ["a", "b"], "left_anti"), "candidates")
    if not rest.isEmpty():
        placed = joined_labels(placed, stored(verified(rest, maps, docs, text, words, percent), "links"))
    return placed.select("v", "label")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT):
    """(key, n_shingles, component_id) of every row: the component by its smallest id."""
    marks = stored(signatures(docs, key, text, words), "signatures")
    rows = marks.where("n is not null").select("id", "n", "v")
    labels = class_labels(docs, marks, text, words, percent)
    classes = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("least"))
    known = classes.join(labels, "v", "left").select("v", "least", F.coalesce("label", F.col("v")).alias("label"))
    smallest = known.groupBy("label").agg(F.min("least").alias("component_id"))
    named = stored(known.join(smallest, "label").select("v", "component_id"), "components")
    return rows.join(named, "v", "left").select(
        F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )
