import hashlib
import random
from collections import Counter

from conftest import rows
from pyspark.sql import functions as F

from slicewise.operators import hashes, histogram
from slicewise.sources.files import chunk


def contents():
    rng = random.Random(3)
    return {f"i{n}": rng.randbytes(n) + bytes(n % 1500) for n in (0, 1, 511, 512, 513, 5000, 9999)}


def test_block_hashes(images):
    data = contents()
    expected = sorted(
        (name, hashlib.md5(d[o : o + 512]).hexdigest().upper(), o)
        for name, d in data.items()
        for o in range(0, len(d) - 511, 512)
    )
    for size in (512, 1024, 65536):
        assert rows(hashes.block_hashes(chunk(images(data), "image", "data", size))) == expected


def test_histograms(images):
    data = contents()
    expected = sorted((n, b, c) for n, d in data.items() for b, c in Counter(d).items())
    total = sorted(Counter(b"".join(data.values())).items())
    for size in (100, 65536):
        partial = histogram.byte_histogram(chunk(images(data), "image", "data", size))
        per_image = rows(histogram.histogram_by_image(partial).where("image is not null"))
        assert per_image == expected
        assert rows(histogram.histogram_by_image(partial).where("image is null").select("byte", "n")) == total
        assert rows(histogram.histogram_total(partial)) == total
        assert rows(histogram.histogram_total(histogram.byte_histogram(chunk(images(data), "image", "data", size), by=()))) == total
    assert sum(c for _, c in total) == sum(map(len, data.values()))


def test_report(spark):
    total = spark.createDataFrame([(65, 3), (255, 1)], "byte int, n long")
    lines = histogram.histogram_report(total).collect()[0].report.split("\n")
    assert len(lines) == 257 and lines[65] == "65 3" and lines[0] == "0 0" and lines[256] == "total: 4"
    line = histogram.histogram_report(total, newline=False).collect()[0].report
    assert line.startswith("0 0 1 0 ") and line.endswith("255 1 \ntotal: 4\n")


def test_hash_counts_are_clipped(spark):
    blocks = spark.createDataFrame([("X", "a")] * 5 + [("X", "b"), ("Y", "b")], "block_md5 string, image string")
    assert rows(hashes.hash_counts(blocks, clip=3)) == [("X", "a", 3, True), ("X", "b", 1, False), ("Y", "b", 1, False)]
    assert rows(hashes.hash_totals(blocks)) == [("X", 6, 2), ("Y", 1, 1)]


def test_slices_of_a_column_add_up(images):
    data = contents()
    for size, overlap in ((100, 0), (700, 300)):
        s = chunk(images(data), "image", "data", size, overlap).orderBy("image", "offset").collect()
        for name, d in data.items():
            mine = [r for r in s if r.image == name]
            assert b"".join(bytes(r.data) for r in mine) == d
            if overlap:
                for r in mine:
                    end = r.offset + len(r.data)
                    assert bytes(r.before) == d[max(0, r.offset - overlap) : r.offset]
                    assert bytes(r.after) == d[end : end + overlap]


def test_read_only_pass(images):
    s = chunk(images(contents()), "image", "data", 1000)
    assert histogram.read_only_pass(s).collect()[0].bytes == sum(map(len, contents().values()))
    assert s.agg(F.max(F.length("data"))).collect()[0][0] == 1000
