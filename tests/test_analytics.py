"""Joins, orders and similarities against brute force on small inputs."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from slicewise.operators import artifacts as art
from slicewise.operators import joins, similarity, throughput
from slicewise.operators.ordered import key_ranges, neighbours, running_sum
from slicewise.sources import logs
from slicewise.sources.files import limit_images


@pytest.fixture(scope="module")
def tokens():
    """A third of the images are copies, a third near copies, and one token is everywhere."""
    rng = random.Random(5)
    sets = {}
    for i in range(60):
        if i % 3 == 0:
            base = set(range(20))
        elif i % 3 == 1:
            base = set(rng.sample(range(100, 130), 22))
        else:
            base = set(rng.sample(range(1000), rng.randint(1, 15)))
        sets[f"i{i:02d}"] = base | {-1}
    return sets


def token_frame(spark, sets):
    return spark.createDataFrame([(i, str(t)) for i, s in sets.items() for t in s], "image string, token string")


def test_salted_join_splits_hot_keys(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(900)], "key string, n long")
    right = spark.createDataFrame([("hot", "x"), ("k3", "y"), ("none", "z")], "key string, v string")
    hot = joins.hot_keys(left.groupBy("key").agg(F.count("*").alias("n")), "key", shares=30, small=10)
    assert rows(hot) == [("hot", 20)]
    salted = joins.salted_join(left, right, "key", ["n"], shares=30, small=10)
    assert rows(salted.select("key", "n", "v")) == rows(left.join(right, "key").select("key", "n", "v"))
    plain = joins.salted_join(left, right, "key", ["n"])
    assert rows(plain.select("key", "n", "v")) == rows(salted.select("key", "n", "v"))


def test_overlap_summary(spark, tokens):
    df = Counter(t for s in tokens.values() for t in s)
    expected = sorted(
        (i, len(s), sum(df[t] > 1 for t in s), sum(df[t] - 1 for t in s)) for i, s in tokens.items()
    )
    assert rows(similarity.overlap_summary(token_frame(spark, tokens))) == expected


def test_similarity_to_seeds(spark, tokens):
    seeds = ["i00", "i01", "i02"]
    expected = sorted(
        (a, b, len(tokens[a] & tokens[b])) for a in seeds for b in tokens if a != b and tokens[a] & tokens[b]
    )
    frame = spark.createDataFrame([(s,) for s in seeds], "image string")
    got = similarity.similarity_to(token_frame(spark, tokens), frame)
    assert rows(got.select("image_a", "image_b", "shared")) == expected


@pytest.mark.parametrize("block, meetings", [(1 << 19, 1 << 21), (25, 7), (3, 1)])
def test_similarity_to_shuffles_no_pairs(spark, tokens, monkeypatch, block, meetings):
    """One block, several, and seeds too large for one; a pair is a row only once it is counted."""
    monkeypatch.setattr(similarity, "SEED_TOKENS", block)
    monkeypatch.setattr(similarity, "MET", meetings)
    expected = sorted((a, b, len(tokens[a] & tokens[b])) for a, b in itertools.permutations(tokens, 2) if tokens[a] & tokens[b])
    frame = spark.createDataFrame([(i,) for i in tokens], "image string")
    got = similarity.similarity_to(token_frame(spark, tokens), frame)
    assert rows(got.select("image_a", "image_b", "shared")) == expected
    if block > 3:
        assert "hashpartitioning(image_a" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8, 1.0])
def test_similar_pairs(spark, tokens, threshold):
    groups = defaultdict(list)
    for i, s in tokens.items():
        groups[frozenset(s)].append(i)
    reps = sorted(min(g) for g in groups.values())
    expected = []
    for a, b in itertools.combinations(reps, 2):
        shared = len(tokens[a] & tokens[b])
        if shared / len(tokens[a] | tokens[b]) >= threshold:
            expected.append((a, b, shared))
    got = similarity.similar_pairs(token_frame(spark, tokens), threshold)
    assert rows(got.select("image_a", "image_b", "shared")) == expected


def test_copy_groups(spark, tokens):
    got = {r.image: r.representative for r in similarity.copy_groups(token_frame(spark, tokens)).collect()}
    for a, b in itertools.combinations(tokens, 2):
        assert (got[a] == got[b]) == (tokens[a] == tokens[b])


def test_neighbours_equal_lag_and_lead(spark):
    rng = random.Random(1)
    data = [("big", o) for o in sorted(rng.sample(range(5000), 300))] + [("small", 7)]
    df = spark.createDataFrame(data, "image string, offset long")
    for width in (1, 50, 100000):
        bucket = F.call_function("div", F.col("offset"), F.lit(width).cast("long"))
        got = neighbours(df, ["image"], ["offset"], ["offset"], bucket)
        got = rows(got.select("image", "offset", F.coalesce("prev.offset", F.lit(-1)), F.coalesce("next.offset", F.lit(-1))))
        big = [o for i, o in data if i == "big"]
        expected = [("big", o, big[k - 1] if k else -1, big[k + 1] if k + 1 < len(big) else -1) for k, o in enumerate(big)]
        assert got == [*expected, ("small", 7, -1, -1)]


def test_running_sum_over_ranges(spark):
    data = [(f"n{i:04d}", i % 7) for i in range(500)]
    df = spark.createDataFrame(data, "name string, v long")
    got = running_sum(df, ["name"], {"total": F.col("v")}, key_ranges(df, "name", 9))
    sums = list(itertools.accumulate(v for _, v in data))
    assert rows(got.select("name", "total")) == [(n, s) for (n, _), s in zip(data, sums)]


def test_limits(spark):
    df = spark.createDataFrame([(f"img{i}", 10) for i in range(8)], "image string, length long")
    assert rows(limit_images(df, max_bytes=35)) == [("img0", 10), ("img1", 10), ("img2", 10)]
    assert rows(limit_images(df, n=1, include="img", exclude="0")) == [("img1", 10)]


def test_near_artifacts(spark):
    rng = random.Random(2)
    data = [(f"i{k % 2}", f"a{rng.randint(0, 5)}", rng.randint(0, 3000)) for k in range(200)]
    data = sorted(set(data))
    got = art.near_artifacts(spark.createDataFrame(data, "image string, artifact string, offset long"), 100)
    expected = []
    for x, y in itertools.permutations(data, 2):
        gap = y[2] - x[2]
        if x[0] == y[0] and (0 < gap <= 100 or (gap == 0 and x[1] < y[1])):
            expected.append((x[0], x[1], x[2], y[1], y[2], gap))
    assert rows(got) == sorted(expected)


def test_related_media_chain(spark):
    fa = spark.createDataFrame([("f1", "a"), ("f1", "b"), ("f2", "b"), ("f3", "c")], "file string, artifact string")
    mf = spark.createDataFrame([("m1", "f1"), ("m2", "f2"), ("m3", "f3"), ("m2", "f1")], "media string, file string")
    assert rows(art.related_media(fa, mf, "f1")) == [("m1",), ("m2",)]


def test_counts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "key string, n long")
    new = spark.createDataFrame([("b", 5), ("c", 7)], "key string, n long")
    assert rows(art.apply_counts(old, new, "insert")) == [("a", 1), ("b", 7), ("c", 7)]
    assert rows(art.apply_counts(old, new, "merge")) == [("a", 1), ("b", 5), ("c", 7)]


def test_inverted_index_rows_are_bounded(spark):
    df = spark.range(5000).select(F.lit("hot").alias("artifact"), F.lit("i").alias("image"), F.col("id").alias("offset"))
    index = art.inverted_index(df, width=100)
    assert index.agg(F.max(F.size("offsets"))).collect()[0][0] == 100
    assert index.select(F.explode("offsets")).distinct().count() == 5000


def test_prefiltered_lookup(spark):
    blocks = spark.createDataFrame([("X", "a", 0)] * 4 + [("Y", "a", 1), ("Z", "b", 2)], "block_md5 string, image string, offset long")
    totals = blocks.groupBy("block_md5").agg(F.count("*").alias("total"))
    got = similarity.prefiltered_lookup(blocks, similarity.hot_hashes(blocks, 1), totals)
    assert rows(got.groupBy("block_md5", "total", "from_hot").count()) == [("X", 4, True, 4), ("Y", 1, False, 1), ("Z", 1, False, 1)]


def test_progress_log(spark):
    lines = ["2017-01-10 01-12-42.tsv 0", "2017-01-10 01-13-31.tsv 160041885696", "2017-01-10 01-13-31.tsv 4", "x"]
    log = logs.parse_log(spark.createDataFrame([(x,) for x in lines], "value string"), "progress")
    assert rows(throughput.cumulative_bytes(log)) == [(0, 0), (49, 160041885700)]


def test_executor_log(spark):
    lines = [
        "17/01/10 01:00:01 INFO Executor: Running task 1.0 in stage 0.0",
        "17/01/10 01:00:05 INFO Executor: Running task 2.0 in stage 0.0",
        "17/01/10 01:00:19 INFO Executor: Finished task 1.0 in stage 0.0",
        "17/01/10 01:00:21 INFO Executor: Told to re-register on heartbeat",
        "short",
    ]
    log = logs.parse_log(spark.createDataFrame([(x,) for x in lines], "value string"), "executor")
    buckets = throughput.throughput(log, 10, gb_per_split=2.0)
    got = [r[1:] for r in rows(buckets)]
    assert got == [(2, 0, 0.4, 0.0), (0, 1, 0.0, 0.2)]
    assert [r[1:] for r in rows(throughput.cumulative_throughput(buckets, 2.0))] == [(4.0, 0.0), (4.0, 2.0)]


def test_log_counters(spark):
    lines = ["flex_bytes_considered: 5", "flex_bytes_accepted: 2", "flex_bytes_considered: 7", "other: 9"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = throughput.log_counters(df, ["flex_bytes_considered: ", "flex_bytes_accepted: ", "none: "])
    assert rows(got) == [(12, 2, 0)]
