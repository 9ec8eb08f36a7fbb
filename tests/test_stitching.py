"""Matches of any length over slices of any width against Python's `re` on whole images."""

import random
import re

import pytest
from conftest import rows

from slicewise.operators import stitching
from slicewise.operators.scanners import scan, scan_pattern
from slicewise.operators.stitching import Within
from slicewise.sources.files import chunk

DIGITS, WORDS = Within("[0-9]{4,}", "0-9"), Within("[A-Za-z]{5,}", "A-Za-z")


def expected(contents, pattern):
    return sorted((n, m.start(), m.group().decode("latin1")) for n, d in contents.items() for m in re.finditer(pattern, d))


def found(df):
    return rows(df.select("image", "offset", "feature"))


@pytest.fixture(scope="module")
def contents():
    random.seed(3)
    pieces = [b"1" * 7, b"ab", b"word" * 5, b" ", b"\x00", b"23", b"\xff", b"7" * 90, b"Q" * 300, b"x1"]
    made = {f"i{k}": b"".join(random.choice(pieces) for _ in range(random.randrange(1, 60))) for k in range(30)}
    return made | {"digits": b"5" * 5900, "all": b"ab" * 1024, "edge": b"9" * 64, "none": b" " * 300, "one": b"z"}


@pytest.mark.parametrize("size,overlap", [(16, 0), (64, 0), (64, 20), (4096, 1024), (1 << 20, 0)])
def test_runs_over_slices(images, contents, size, overlap):
    s = chunk(images(contents), "image", "data", size, overlap)
    got = scan(s, {"number": DIGITS, "word": WORDS})
    for name, pattern in (("number", rb"[0-9]{4,}"), ("word", rb"[A-Za-z]{5,}")):
        assert found(got.where(f"artifact_class = '{name}'")) == expected(contents, pattern)


def test_long_run_on_small_slices_comes_back_whole(images):
    image = {"a": b"x " + b"7" * 5900 + b" y"}
    s = chunk(images(image), "image", "data", 4096, 1024)
    got = scan_pattern(s, DIGITS).collect()
    assert [(r.offset, r.feature, r.context) for r in got] == [(2, "7" * 5900, "x " + "7" * 5900 + " y")]
    with pytest.raises(Exception, match="longer than the context"):
        scan_pattern(s, "[0-9]{4,}").collect()


def test_pattern_inside_a_run(images):
    """A pattern that does not take whole runs gives the matches of the whole image too."""
    rng = random.Random(8)
    image = {str(k): bytes(rng.choice(b"ab-. ") for _ in range(700)) for k in range(8)}
    rule = Within("a[ab]*-[ab]+", "ab-")
    s = chunk(images(image), "image", "data", 32)
    assert found(scan_pattern(s, rule)) == expected(image, rb"a[ab]*-[ab]+")


def test_match_that_ends_with_its_image_is_no_error(images):
    image = {"a": b" " * 4090 + b"8" * 500, "b": b"8" * 4200, "c": b" " * 8190 + b"8" * 40}
    s = chunk(images(image), "image", "data", 4096, 1024)
    assert found(scan_pattern(s, "[0-9]{4,}")) == expected(image, rb"[0-9]{4,}")


def test_a_gap_in_the_slices_ends_a_run(spark):
    s = spark.createDataFrame([("a", 0, b"12345"), ("a", 5, b"678"), ("a", 9, b"12345"), ("b", 5, b"67890")], "image string, offset long, data binary")
    assert found(scan_pattern(s, DIGITS)) == [("a", 0, "12345678"), ("a", 9, "12345"), ("b", 5, "67890")]


def test_chains_take_few_rounds(spark, monkeypatch):
    made = []
    real = stitching.stored
    monkeypatch.setattr(stitching, "stored", lambda df, name: (made.append(name), real(df, name))[1])
    parts = spark.range(300).selectExpr("'a' image", "id * 10 start", "id * 10 + 10 end")
    roots = stitching.chains(parts.unionByName(spark.sql("select 'a' image, 9000L start, 9001L end")), ["image"])
    assert {(r.start, r.root) for r in roots.collect()} == {(10 * k, 0) for k in range(300)} | {(9000, 9000)}
    assert len(made) <= 10


@pytest.mark.parametrize("range_bytes", [64, 200, 1 << 22])
def test_runs_of_a_range_need_no_chain(images, contents, monkeypatch, range_bytes):
    """Fragments of one range are put together at once; only what reaches into another range is chained."""
    monkeypatch.setattr(stitching, "RANGE_BYTES", range_bytes, raising=False)
    called, chains = [], stitching.chains
    monkeypatch.setattr(stitching, "chains", lambda *args: called.append(1) or chains(*args))
    s = chunk(images(contents), "image", "data", 16)
    assert found(scan_pattern(s, DIGITS)) == expected(contents, rb"[0-9]{4,}")
    assert bool(called) == (range_bytes < 1 << 22)
