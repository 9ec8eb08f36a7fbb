import gzip
import io
import os
import zipfile
import zlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from slicewise.operators import embedded
from slicewise.operators.scanners import scan
from slicewise.sources.files import chunk


def scanned(images, contents, size=65536, depth=7):
    s = chunk(images(contents), "image", "data", size, 1024)
    found = embedded.forensic_path(embedded.scan_recursive(s, depth, size))
    return rows(found.select("image", "path", "feature"))


def zipped(content):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("inner.txt", content)
    return buffer.getvalue()


def test_kinds(images):
    text = b"hello ab@c.com bye"
    contents = {
        "gzip": b"12345" + gzip.compress(text) + b"tail",
        "zlib": b"1234567" + zlib.compress(text),
        "zip": b"123" + zipped(text),
        "plain": text,
        "none": b"\x1f\x8b\x08 not a stream, PK\x03\x04 neither",
    }
    assert scanned(images, contents) == [
        ("gzip", "5-GZIP-6", "ab@c.com"),
        ("plain", "6", "ab@c.com"),
        ("zip", "3-ZIP-6", "ab@c.com"),
        ("zlib", "7-ZLIB-6", "ab@c.com"),
    ]


def test_depth_is_limited_to_seven(images):
    data = b"ab@c.com "
    levels = {}
    for n in range(1, 9):
        # Padding makes deflate code the inner stream instead of storing it as it is.
        data = gzip.compress(data + b" " * 2000)
        levels[f"d{n}"] = data
    found = scanned(images, levels)
    assert [(r[0], r[1].count("GZIP")) for r in found] == [(f"d{n}", n) for n in range(1, 8)]
    assert [r[0] for r in scanned(images, levels, depth=2)] == ["d1", "d2"]


def test_stream_over_many_slices(images):
    text = os.urandom(20000).hex().encode() + b" ab@c.com " + os.urandom(20000).hex().encode() + b" xy@z.org "
    contents = {"long": b"head" + gzip.compress(text) + b"foot"}
    expected = [("long", "4-GZIP-40001", "ab@c.com"), ("long", f"4-GZIP-{80000 + 11}", "xy@z.org")]
    for size in (2048, 65536):
        assert scanned(images, contents, size) == expected


def test_what_came_before_a_fault_is_kept(images):
    text = b"ab@c.com " + os.urandom(30000).hex().encode() + b" xy@z.org "
    packed = gzip.compress(text)
    damaged = packed[:-2000] + bytes(1000) + packed[-1000:]
    contents = {"cut": packed[:-1000], "damaged": damaged, "whole": packed}
    expected = [("cut", "0-GZIP-0", "ab@c.com"), ("damaged", "0-GZIP-0", "ab@c.com")]
    expected += [("whole", "0-GZIP-0", "ab@c.com"), ("whole", "0-GZIP-60010", "xy@z.org")]
    for size in (2048, 65536):
        assert scanned(images, contents, size) == expected


def test_long_content_leaves_in_slices(images):
    text = b"." * 5_000_000 + b" ab@c.com "
    assert scanned(images, {"a": gzip.compress(text)}) == [("a", "0-GZIP-5000001", "ab@c.com")]
    level = next(iter(embedded.expand_embedded(chunk(images({"a": gzip.compress(text)}), "image", "data", 65536, 1024))))
    assert level.agg(F.max(F.length("data"))).first()[0] == embedded.SLICE_BYTES
    assert level.agg(F.sum(F.length("data"))).first()[0] == len(text)


def test_any_scanner_and_seen_buffers(images, spark):
    inner = gzip.compress(b"number 123456 here")
    s = chunk(images({"a": b"zz" + inner, "b": b"yy" + gzip.compress(b"number 777777")}), "image", "data", 65536, 1024)
    seen = spark.range(1).select(F.md5(F.lit("number 777777").cast("binary")).alias("digest"))
    found = embedded.scan_recursive(s, scanner=lambda x: scan(x, {"number": "number [0-9]{6}"}), seen=seen)
    assert rows(found.select("artifact_class", "image", "recursion_prefix", "feature")) == [("number", "a", "2-GZIP", "number 123456")]


def test_misplaced_slices_are_an_error(images, spark):
    packed = gzip.compress(os.urandom(9000))
    s = chunk(images({"a": packed}), "image", "data", 2048, 0)
    with pytest.raises(Exception, match="multiples"):
        embedded.expand_once(s, 3000).count()


def test_match_over_slices_of_a_buffer(images):
    text = b"." * (embedded.SLICE_BYTES - 4) + b" abcd@example.com " + b"." * 100
    assert scanned(images, {"a": gzip.compress(text)}) == [("a", f"0-GZIP-{embedded.SLICE_BYTES - 3}", "abcd@example.com")]


def test_seen_buffers_are_dropped(images, spark):
    df = images({"a": b"one", "b": b"two"})
    seen = spark.range(1).select(F.md5(F.lit("one").cast("binary")).alias("digest"))
    assert rows(embedded.drop_seen(df, seen).select("image")) == [("b",)]


def test_a_slice_of_signatures_costs_its_own_size(images):
    data = b"\x78\x01" * 16384
    found = embedded.find_streams(chunk(images({"a": data}), "image", "data", 65536)).collect()
    assert len(found) == 1 and len(found[0].hits) == 16384 and len(found[0].buffer) == len(data)
    assert scanned(images, {"a": data + b" ab@c.com "}) == [("a", "32769", "ab@c.com")]
