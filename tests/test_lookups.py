"""Keyword tables, frequent keys, Bloom filters, runs of blocks, weighted similarity, closures and pushed filters."""

import collections
import itertools
import math
import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from slicewise.operators import artifacts, frequent, keywords, membership, similarity
from slicewise.plans.queries import QUERIES
from slicewise.sources.files import chunk, read_raw
from slicewise.sources.rawimage import FilteringReader
from slicewise.streaming import seen

# ---- keywords


def places(contents, words):
    out = []
    for name, data in contents.items():
        for w in set(words):
            at = data.find(w)
            while w and at >= 0:
                out.append((name, at, w.decode("latin-1")))
                at = data.find(w, at + 1)
    return sorted(out)


@pytest.mark.parametrize("overlap,shard", [(0, 1 << 20), (16, 1 << 20), (0, 100)])
def test_keywords_over_slices(spark, images, monkeypatch, overlap, shard):
    monkeypatch.setattr(keywords, "SHARD_BYTES", shard)
    rng = random.Random(4)
    contents = {str(k): bytes(rng.choice(b"ab\x00c") for _ in range(700)) for k in range(6)}
    words = [b"a", b"ab", b"aba", b"abab", b"cab\x00", b"bbbbbbb", b"zz", b"ab", b"", b"c" * 9]
    listed = spark.createDataFrame([(bytearray(w),) for w in words] + [(None,)], "keyword binary")
    got = keywords.scan_keywords(chunk(images(contents), "image", "data", 64, overlap), listed)
    assert sorted((r.image, r.offset, bytes(r.keyword).decode("latin-1")) for r in got.collect()) == places(contents, words)
    assert keywords.scan_keywords(chunk(images(contents), "image", "data", 64), listed.limit(0)).count() == 0


def test_a_hundred_thousand_keywords(spark, images):
    listed = spark.range(100_000).select(F.format_string("k%05dx", "id").alias("keyword"))
    contents = {"a": b"k00007x" * 50 + b"k99999xk12345xk1234", "b": b"\xffk54321x"}
    got = keywords.scan_keywords(chunk(images(contents), "image", "data", 128), listed)
    assert rows(got) == places(contents, [b"k00007x", b"k99999x", b"k12345x", b"k54321x"])


def test_keyword_longer_than_the_context_is_an_error(spark, images):
    listed = spark.createDataFrame([("x" * 40,)], "keyword string")
    with pytest.raises(ValueError, match="context"):
        keywords.scan_keywords(chunk(images({"a": b"x" * 90}), "image", "data", 64, 16), listed, context=16)


# ---- frequent keys


@pytest.mark.parametrize("size", [8, 40, 4000])
def test_top_counts_equal_the_full_count(spark, monkeypatch, size):
    monkeypatch.setattr(frequent, "MOST", 4000)
    rng = random.Random(size)
    keys = [f"h{int(rng.paretovariate(0.9))}" for _ in range(6000)] + [None] * 9
    df = spark.createDataFrame([(k, 1) for k in keys], "key string, low int").repartition(5)
    count = collections.Counter(k for k in keys if k is not None)
    best = sorted(count.items(), key=lambda x: (-x[1], x[0]))[:6]
    assert sorted(tuple(r) for r in frequent.top_counts(df, "key", 6, size).collect()) == sorted(best)


def test_summaries_are_bounded_and_never_above_the_count(spark):
    rng = random.Random(1)
    keys = [int(rng.paretovariate(0.7)) % 5000 for _ in range(20000)]
    kept = frequent.summaries(spark.createDataFrame([(k,) for k in keys], "key long").repartition(4), "key", 50).collect()
    count, low, error = collections.Counter(keys), collections.Counter(), sum(r.error for r in kept)
    for r in kept:
        if r.key is not None:
            low[r.key] += r.low
    assert len(kept) <= 4 * 51 and 0 < error <= len(keys) / 50
    assert all(low[k] <= n <= low[k] + error for k, n in count.items())


def test_keys_that_do_not_stand_out_are_counted_in_full(spark, monkeypatch):
    monkeypatch.setattr(frequent, "MOST", 16)
    df = spark.range(500).select((F.col("id") % 100).alias("key"))
    assert sorted(tuple(r) for r in frequent.top_counts(df, "key", 3, 4).collect()) == [(0, 5), (1, 5), (2, 5)]
    assert frequent.top_counts(df.limit(0), "key", 3).count() == 0


# ---- membership


@pytest.mark.parametrize("error", [0.2, 0.01])
def test_bloom_filter(spark, tmp_path, error):
    table = spark.range(3000).select(F.concat(F.lit("k"), F.col("id") * 7).alias("key"))
    membership.bloom_filter(table, "key", error).save(str(tmp_path / "bloom"))
    bloom = membership.load_bloom(spark, str(tmp_path / "bloom"))
    wanted = spark.range(30000).select(F.concat(F.lit("k"), "id").alias("key")).unionByName(spark.sql("select cast(null as string) key"))
    passed = {r.key for r in membership.maybe_in(wanted, "key", bloom).collect()}
    true = {f"k{7 * k}" for k in range(3000)}
    assert {k for k in true if int(k[1:]) < 30000} <= passed and None not in passed
    assert len(passed - true) / (30000 - 4286) <= 1.5 * error
    found = membership.filtered_lookup(wanted, table.withColumn("v", F.lit(1)), "key", bloom)
    assert {r.key for r in found.collect()} == {k for k in true if int(k[1:]) < 30000}


def test_bloom_filters_unite_and_large_ones_are_not_sent(spark, monkeypatch):
    a, b = (membership.bloom_filter(spark.range(k, k + 50), "id", keys=100) for k in (0, 200))
    united = a.union(b)
    assert {r.id for r in membership.maybe_in(spark.range(300), "id", united).collect()} >= {*range(50), *range(200, 250)}
    monkeypatch.setattr(membership, "SHIPPED_BYTES", 8)
    assert membership.maybe_in(spark.range(300), "id", united).count() == 300
    assert membership.maybe_in(spark.range(9), "id", membership.bloom_filter(spark.range(0), "id")).count() in (0, 9)


# ---- runs of blocks


def test_runs_against_brute_force(spark):
    rng = random.Random(2)
    pool = [f"b{k}" for k in range(40)]
    passage = [rng.choice(pool) for _ in range(60)]
    listed = {f"i{k}": [rng.choice(pool) for _ in range(10)] + passage[k : k + 40] + [f"own{k}"] for k in range(12)}
    data = [(i, m, 512 * n) for i, ms in listed.items() for n, m in enumerate(ms)]
    got = similarity.block_runs(spark.createDataFrame(data, "image string, block_md5 string, offset long"), width=4096)
    first, diagonals = {}, collections.defaultdict(list)
    for i, m, o in sorted(data, key=lambda x: (x[0], x[2])):
        if m in first:
            diagonals[i, first[m][0], o - first[m][1]].append(o)
        first.setdefault(m, (i, o))
    expected = []
    for (i, rep, d), offsets in diagonals.items():
        start = prev = offsets[0]
        for o in [*offsets[1:], None]:
            if o is None or o != prev + 512:
                expected.append((i, start, rep, start - d, prev + 512 - start))
                start = o
            prev = o
    assert rows(got) == sorted(expected)


# ---- weighted similarity


@pytest.mark.parametrize("least", [0.3, 0.7])
def test_cosine_pairs_against_brute_force(spark, least):
    rng = random.Random(6)
    common, docs = [f"c{k}" for k in range(6)], {}
    for k in range(60):
        base = [f"t{rng.randrange(40)}" for _ in range(rng.randrange(1, 12))]
        docs[k] = {t: round(rng.random() * 3, 3) for t in base} | {t: 0.05 for t in common if rng.random() < 0.9}
    docs |= {100: dict(docs[3]), 101: dict(docs[3]), 102: {"zero": 0.0}, 103: {c: 0.05 for c in common}}
    docs |= {104: {**docs[7], "more": 0.01}}
    weights = spark.createDataFrame([(i, t, w) for i, d in docs.items() for t, w in d.items()], "image int, token string, weight double")
    prints = {}
    for i in sorted(docs):
        prints.setdefault(frozenset((t, w) for t, w in docs[i].items() if w), i)
    kept = sorted(i for p, i in prints.items() if p)
    norm = {i: math.sqrt(sum(w * w for w in docs[i].values())) for i in kept}
    expected = {}
    for a, b in itertools.combinations(kept, 2):
        value = sum(w * docs[b].get(t, 0) for t, w in docs[a].items()) / norm[a] / norm[b]
        if value >= least:
            expected[a, b] = value
    got = {(r.image_a, r.image_b): r.cosine for r in similarity.cosine_pairs(weights, least).collect()}
    assert set(got) == set(expected) and all(abs(got[p] - c) < 1e-9 for p, c in expected.items())
    assert (3, 100) not in got and (7, 104) in got
    assert similarity.cosine_pairs(weights.limit(0), least).count() == 0


@pytest.mark.parametrize("least", [0.3, 0.7])
def test_cosine_pairs_of_copies_are_given(spark, monkeypatch, least):
    """Copies pair with each other and with all that is similar to one of them."""
    monkeypatch.setattr(similarity, "GROUP_PIECE", 2, raising=False)
    rng = random.Random(8)
    docs = {k: {f"t{rng.randrange(30)}": 1 + rng.randrange(3) for _ in range(6)} for k in range(20)}
    docs |= {k: dict(docs[k % 3]) for k in range(20, 40)} | {40: {"only": 2}, 41: {"only": 2}, 42: {"zero": 0}, 43: {"zero": 0}}
    rows_ = [(i, t, float(w)) for i, d in docs.items() for t, w in d.items()] + [(None, t, float(w)) for t, w in docs[0].items()]
    weights = spark.createDataFrame(rows_, "image int, token string, weight double")
    norm = {i: math.sqrt(sum(w * w for w in d.values())) for i, d in docs.items()}
    expected = {}
    for a, b in itertools.combinations([i for i in docs if norm[i]], 2):
        value = sum(w * docs[b].get(t, 0) for t, w in docs[a].items()) / norm[a] / norm[b]
        if value >= least - 1e-12:
            expected[a, b] = value
    got = [(r.image_a, r.image_b, r.cosine) for r in similarity.cosine_pairs(weights, least, copies=True).collect()]
    assert len(got) == len(expected) and {g[:2] for g in got} == set(expected)
    assert all(abs(expected[a, b] - c) < 1e-9 for a, b, c in got)
    assert (20, 23) in expected and (40, 41) in expected


@pytest.mark.parametrize("kind", ["int", "string"])
def test_cosine_pairs_are_worked_out_inside_the_tasks(spark, monkeypatch, kind):
    """No pair meets its tokens in a join, however images, blocks and meetings are cut."""
    for name, value in {"INDEX_TOKENS": 150, "BLOCKS": 2, "MET": 40, "CELLS": 60, "GATHERED": 30}.items():
        monkeypatch.setattr(similarity, name, value, raising=False)
    rng = random.Random(9)
    docs = {k: {f"t{min(rng.randrange(200), rng.randrange(200))}": 1 + rng.random() for _ in range(rng.randrange(2, 40))} for k in range(70)}
    for k in range(70, 100):
        docs[k] = {**docs[k - 60], f"x{k}": rng.random(), "t3": -rng.random()}
    weights = spark.createDataFrame([(i, t, w) for i, d in docs.items() for t, w in d.items()], "image int, token string, weight double")
    weights = weights.withColumn("image", F.format_string("%03d", "image") if kind == "string" else F.col("image"))
    norm = {i: math.sqrt(sum(w * w for w in d.values())) for i, d in docs.items()}
    expected = {}
    for a, b in itertools.combinations(docs, 2):
        value = sum(w * docs[b].get(t, 0) for t, w in docs[a].items()) / norm[a] / norm[b]
        if value >= 0.4:
            expected[a, b] = value
    pairs = similarity.cosine_pairs(weights, 0.4)
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = [(int(r.image_a), int(r.image_b), r.cosine) for r in pairs.collect()]
    assert len(got) == len(expected) > 30 and {g[:2] for g in got} == set(expected)
    assert all(abs(expected[a, b] - c) < 1e-9 for a, b, c in got)


def test_cosine_query_gives_the_pairs_of_copies(spark, tmp_path):
    texts = ["apple banana cherry", "apple banana cherry", "cherry apple banana", "other words altogether", "grape melon"]
    docs = [(k, t) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(QUERIES["image_cosine_pairs"](spark, str(tmp_path))) == [(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0)]


def test_counts_by_image_are_made_behind_the_exchange(spark):
    """No task holds the pairs of all it reads, and the weights are kept as columns, not as rows of a dump."""
    a = spark.createDataFrame([("w", 1), ("w", 1), ("v", 1), ("w", 2)], "artifact string, image int")
    counts = artifacts.artifact_by_image(a)
    assert rows(counts) == [("v", 1, 1), ("w", 1, 2), ("w", 2, 1)]
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") < plan.index("Exchange")
    weights = artifacts.tfidf(a)
    assert [tuple(r)[:4] for r in sorted(weights.collect())] == [("v", 1, 1, 1), ("w", 1, 2, 2), ("w", 2, 1, 2)]
    assert not re.search(r"ExistingRDD\[artifact#\d+, ?image", weights._jdf.queryExecution().toString())


def test_cosine_pairs_makes_few_candidates(spark, monkeypatch):
    """Images that share a rare token or two, but are not similar, are never rows of their own."""
    monkeypatch.setattr(similarity, "INDEX_TOKENS", 100, raising=False)
    monkeypatch.setattr(similarity, "MET", 50, raising=False)
    sizes, kept = {}, similarity.stored

    def counted(df, name):
        sizes[name] = df.count()
        return kept(df, name)

    monkeypatch.setattr(similarity, "stored", counted)
    rng = random.Random(7)
    docs = {k: rng.sample(range(60), 10) for k in range(60)} | {k: [*range(100, 110), k] for k in (60, 61)}
    weights = spark.createDataFrame([(i, str(t), 1.0) for i, d in docs.items() for t in d], "image int, token string, weight double")
    expected = {(a, b) for a, b in itertools.combinations(docs, 2) if len(set(docs[a]) & set(docs[b])) / math.sqrt(len(docs[a]) * len(docs[b])) >= 0.7}
    assert (60, 61) in expected
    assert {(r.image_a, r.image_b) for r in similarity.cosine_pairs(weights, 0.7).collect()} == expected
    met = sum(bool(set(docs[a]) & set(docs[b])) for a, b in itertools.combinations(docs, 2))
    assert met > 1000 and sizes["candidates"] < met / 10


# ---- closures


@pytest.mark.parametrize("hops", [0, 1, 2, 9])
def test_media_within_hops(spark, hops):
    rng = random.Random(hops)
    fa = [(rng.randrange(40), f"a{rng.randrange(30)}") for _ in range(45)] + [(f, "hot") for f in range(30, 40)]
    mf = [(f"m{rng.randrange(12)}", f) for f in range(40)]
    expected = {}
    for s in (0, 5, 31, 99):
        reached, frontier = {s: 0}, {s}
        for hop in range(1, hops + 1):
            found = {a for f, a in fa if f in frontier}
            frontier = {f for f, a in fa if a in found} - set(reached)
            reached |= {f: hop for f in frontier}
        for m, f in mf:
            if f in reached:
                expected[s, m] = min(expected.get((s, m), 99), reached[f])
    seeds = spark.createDataFrame([(0,), (5,), (31,), (99,), (5,)], "file int")
    got = artifacts.media_within(
        spark.createDataFrame(fa, "file int, artifact string"), spark.createDataFrame(mf, "media string, file int"), seeds, hops
    )
    assert {(r.seed, r.media): r.hops for r in got.collect()} == expected


# ---- filters that reach the reader


def test_pushed_filters_limit_what_is_read(spark, tmp_path):
    for name in ("a1", "a2", "b1"):
        (tmp_path / name).write_bytes(bytes(range(256)) * 16)
    base = str(tmp_path)

    def offsets(df):
        return sorted((r.image[len(base) + 1 :], r.offset) for r in df.select("image", "offset").collect())

    every = [(n, 256 * k) for n in ("a1", "a2", "b1") for k in range(16)]
    cases = {
        "offset >= 300 and offset < 1024": lambda n, o: 300 <= o < 1024,
        f"image = '{base}/a2' and offset > 512": lambda n, o: n == "a2" and o > 512,
        f"image in ('{base}/a1', '{base}/b1') and offset <= 256": lambda n, o: n != "a2" and o <= 256,
        f"image like '{base}/a%' and offset = 768": lambda n, o: n[0] == "a" and o == 768,
        f"image like '%1' and offset = 770": lambda n, o: False,
        f"image = '{base}/none'": lambda n, o: False,
        f"offset = 0 or image = '{base}/a1'": lambda n, o: o == 0 or n == "a1",
    }
    for push in ("true", "false"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", push)
        for condition, keep in cases.items():
            s = read_raw(spark, base, sliceBytes=256, pushFilters=push)
            assert offsets(s.where(condition)) == [p for p in every if keep(*p)], condition
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    wanted = read_raw(spark, base, sliceBytes=256, prefix=f"{base}/a", to=700, **{"from": 256})
    assert offsets(wanted) == [(n, o) for n in ("a1", "a2") for o in (256, 512)]


def test_excluded_ranges_are_not_planned(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan, StringStartsWith

    for name in ("a", "b"):
        (tmp_path / name).write_bytes(bytes(4 << 20))
    reader = FilteringReader({"path": str(tmp_path), "slicebytes": "4096", "splitbytes": str(1 << 20)})
    filters = [GreaterThanOrEqual(("offset",), 5000), LessThan(("offset",), 3 << 19), StringStartsWith(("image",), f"{tmp_path}/a")]
    other = EqualTo(("error",), "x")
    assert list(reader.pushFilters([*filters, other])) == [other]
    planned = [r for task in reader.partitions() for r in task.ranges]
    assert {r.image for r in planned} == {f"{tmp_path}/a"}
    assert min(r.start for r in planned) == 8192 and max(r.stop for r in planned) == 3 << 19
    assert sum(r.stop - r.start for r in planned) == (3 << 19) - 8192


# ---- buffers seen before


def test_a_buffer_is_seen_once_over_runs_and_restarts(spark, tmp_path):
    src, table, state = (str(tmp_path / n) for n in ("src", "table", "state"))

    def arrive(contents):
        df = spark.createDataFrame([(n, 0, bytearray(d)) for n, d in contents], seen.BUFFER_SCHEMA)
        df.write.mode("append").parquet(src)

    def run():
        seen.unseen_stream(spark, src, table, state).awaitTermination()
        return sorted(bytes(r.data) for r in spark.read.parquet(table).collect())

    arrive([("a", b"one"), ("b", b"two"), ("c", b"one")])
    assert run() == [b"one", b"two"]
    arrive([("d", b"two"), ("e", b"three")])
    assert run() == [b"one", b"three", b"two"]
    assert run() == [b"one", b"three", b"two"]
