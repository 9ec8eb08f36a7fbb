"""Collocations, MinHash near copies and hard negatives against brute force and on edge cases."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicewise.llm import collocations, hard_negatives, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ---- collocations


def brute_phrases(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    chosen = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    around = collections.Counter()
    for (lang, w), a in chosen.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inner = lang, w[i : i + k]
                around[inner] = max(around[inner], a)
    found = collections.defaultdict(list)
    for (lang, w), a in chosen.items():
        if around[lang, w] >= a:
            continue
        cuts = [(f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min((1000 * a * n[lang] // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
        found[lang].append((-score, -a, " ".join(w).encode(), left, right))
    out = []
    for lang, listed in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(listed)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed, n=300):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "Ab", "c", "d", "é", "e" * 40, "#", "x y", "f", "g"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(120))
    rows = []
    for k in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 40, 200]))]
        parts = [x + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "!?"]) for x in w]
        text = "".join(parts) + (passage if k % 3 == 0 else "")
        rows.append((text, rng.choice(["de", "de", "de", None, "und", "fr"])))
    return rows + [(None, "de"), ("", "de"), ("z " * 4000, "long"), (" . ", None)] + rows[:40]


@pytest.mark.parametrize("least,top", [(3, 2000), (20, 7)])
def test_phrases_against_brute_force(spark, least, top, monkeypatch):
    monkeypatch.setattr(collocations, "LONGEST", 64)
    monkeypatch.setattr(collocations, "MODULUS", 8)
    rows = texts(least)
    df = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, n long, phrase string").repartition(5)
    got = sorted(tuple(r) for r in collocations.mine(df, least=least, top=top).collect())
    assert got == brute_phrases(rows, least, top)
    assert collocations.mine(df.limit(0)).count() == 0


def test_each_phrase_begins_in_one_chunk():
    rng = np.random.default_rng(5)
    for _ in range(50):
        sizes = rng.integers(0, 90, 6)
        before = np.concatenate([[0], np.cumsum(sizes)])
        hashed = rng.integers(0, 40, before[-1]).astype(np.uint64)
        first, following, end = collocations.cuts(hashed, before)
        begun = np.zeros(before[-1], int)
        for a, b, c in zip(first, following, end):
            row_end = before[np.searchsorted(before, a, side="right")]
            begun[a:b] += 1
            assert c == min(b + collocations.OVERLAP, row_end) or c == row_end
        assert (begun == 1).all()


def test_large_counts_are_exact(spark, monkeypatch):
    row = [("a b", "x")]
    df = spark.createDataFrame(row, "text string, lang string")
    real = collocations.chunks
    times = 3_000_000_001  # copies of the text, as the dictionary counts them
    monkeypatch.setattr(collocations, "stored", lambda d, name: d.withColumn("times", F.lit(times)) if name == "dictionary" else d)
    got = collocations.mine(df).collect()
    assert real is collocations.chunks
    assert [tuple(r) for r in got] == [("x", 1, "a b", times, times, times, 2 * times, 2000)]


# ---- near copies


def brute_components(rows, words=5, percent=85):
    def shingles(text):
        w = WORD.findall(lower(text or ""))
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    members = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        members[find(k)].append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [m for m in members[find(k)] if m is not None]
        least = min(ids) if ids else None
        out.append((i, len(sets[k]), least, i is not None and i == least))
    return sorted(out, key=str)


def copies(seed, families=5, members=14, words=90):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    rows = []
    for _ in range(families):
        text = list(rng.choice(vocabulary, words))
        for _ in range(members):
            other = list(text)
            for _ in range(rng.integers(0, 4)):
                other[rng.integers(words)] = rng.choice(vocabulary)
            rows.append(" ".join(other).upper() if rng.random() < 0.2 else "\n".join(other))
            if rng.random() < 0.3:
                text = other  # a chain
    return rows


def test_near_copies_against_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(copies(3) + copies(4, 1, 60, 60))]
    rows += [(900, None), (901, ""), (902, "one two"), (903, "ONE\ttwo"), (904, " \n "), (905, "one two three four five")]
    rows += [(7, rows[50][1]), (None, rows[3][1]), (None, "quite alone here"), (5, rows[5][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, v1 int, label int").repartition(6)
    got = sorted((tuple(r) for r in minhash.near_dedup(df).collect()), key=str)
    assert got == brute_components(rows)
    assert minhash.near_dedup(df.limit(0)).count() == 0


def test_one_large_group_that_does_not_link_is_never_expanded(spark, monkeypatch):
    """Texts of one template whose pairs stay below the threshold: no join gives all their pairs."""
    rng, made = np.random.default_rng(1), {}
    template = [f"t{k}" for k in range(100)]
    rows = []
    for i in range(200):
        text = list(template)
        for place in rng.choice(100, 4, replace=False):
            text[place] = f"x{i}{place}"
        rows.append((i, " ".join(text)))
    rows.append((200, rows[7][1] + " more"))
    real = minhash.stored

    def noted(df, name):
        kept = real(df, name)
        made.setdefault(name, []).append(kept.count())
        return kept

    monkeypatch.setattr(minhash, "stored", noted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.near_dedup(df).collect()), key=str)
    assert got == brute_components(rows)
    # members meet one hub of a bucket in each round; of the 20,100 pairs nothing is left after that
    hubs, rest = made["pairs"][:-1], made["pairs"][-1]
    assert rest == 0 and max(hubs) <= minhash.BANDS * len(rows) / 4


@pytest.mark.parametrize("seed", range(3))
def test_stars_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(3, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.c: r.label for r in minhash.star_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: find(v) for v in root if find(v) != v}


def test_minima_estimate_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(-(1 << 63), 1 << 63, 1000, np.int64)
    two = np.concatenate([np.sort(pool[:900]), np.sort(pool[100:])])
    found = minhash.minima(two, np.array([0, 900, 1800]))
    assert abs((found[0] == found[1]).mean() - 0.8) < 0.12
    assert minhash.band_keys(found).shape == (2, minhash.BANDS)


# ---- hard negatives


def brute_negatives(rows, anchor, positives=5, negatives=5):
    kept = []
    for i, x, label in rows:
        if i is None or x is None or label is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        kept.append((i, label, [int(np.floor(256 * np.float64(c))) for c in x]))
    out = []
    for a, (i, label, x) in enumerate(kept):
        if not anchor(i):
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), j, g) for b, (j, g, y) in enumerate(kept) if b != a]
        same = sorted((s, j) for s, j, g in scored if g == label)[:positives]
        for s, j in same:
            window = sorted((t, k) for t, k, g in scored if g != label and -80 * s <= -100 * t <= -100 * s)
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(window[:negatives], 1)]
    return sorted(out)


def vectors(seed, n=260, width=11):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, width)) + 0.7).astype(np.float32)
    x[40:90] = x[40]
    rows = [(int(i), [float(c) for c in v], int(rng.integers(0, 3))) for i, v in enumerate(x)]
    rows += [(300, None, 1), (310, [], 1), (320, [float("nan")] * width, 1), (330, [None] * width, 1), (340, [1.0] * width, None)]
    rows += [(350, [float("-inf")] * width, 1), (None, [1.0] * width, 1), (360, [1.0, -2.0], 2), (370, [0.0] * width, 0)]
    return rows + [rows[0], rows[20], (20, rows[21][1], 1)]


def test_negatives_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 9)
    monkeypatch.setattr(hard_negatives, "HELD", 4)
    monkeypatch.setattr(hard_negatives, "ROWS", 32)
    rows = vectors(2)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, row int, rank int")
    got = sorted(tuple(r) for r in hard_negatives.mine(df.repartition(5), F.col("id") % 10 == 0).collect())
    assert got == brute_negatives(rows, lambda i: i % 10 == 0)
    assert hard_negatives.mine(df.limit(0), F.col("id") % 10 == 0).count() == 0
    assert hard_negatives.mine(df, F.col("id") < 0).count() == 0


@pytest.mark.parametrize("top", [1, 255, 256, 1 << 20, 1 << 27])
def test_scores_are_inner_products(top):
    rng = np.random.default_rng(top)
    x, y = rng.integers(-top, top + 1, (17, 16)), rng.integers(-top, top + 1, (9, 16))
    x[0], x[1] = top, -top
    bits = int(np.abs(x).max()).bit_length() + 1
    assert (hard_negatives.scores(hard_negatives.subset_sums(y), hard_negatives.planes(x, bits)) == x @ y.T).all()


def test_numbers_that_are_too_large_are_an_error(spark):
    for x in (1e30, 1e9):
        df = spark.createDataFrame([(0, [x, 1.0], 1), (1, [x, x], 1)], "vec_id long, embedding array<double>, label int")
        with pytest.raises(Exception, match="64 bits"):
            hard_negatives.mine(df, F.col("id") == 0).count()
