import re

from conftest import rows
from pyspark.sql import functions as F

from slicewise.functions import digest, text
from slicewise.functions.patterns import alternation, default_tlds


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).collect()[0].x


def test_escape_is_reversible(spark):
    data = bytes(range(256)) * 2
    shown = one(spark, text.escape(text.latin1(F.col("d"))), d=data)
    back = re.sub(r"\\x([0-9A-F]{2})", lambda m: chr(int(m.group(1), 16)), shown)
    assert back.encode("latin1") == data
    assert one(spark, text.escape(F.col("d")), d="plain text") == "plain text"
    assert one(spark, text.escape(F.col("d")), d="a\\b\n") == "a\\x5Cb\\x0A"


def test_latin1_keeps_positions(spark):
    assert one(spark, F.length(text.latin1(F.col("d"))), d=bytes(range(256))) == 256


def test_context_is_cut_at_the_ends(spark):
    def context(position, length):
        return one(spark, text.context(F.col("d"), F.lit(position).cast("long"), F.lit(length)), d=bytes(range(65, 91)))

    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    assert context(2, 3) == letters[: 5 + 16]
    assert context(20, 6) == letters[4:]


def test_narrow(spark):
    assert one(spark, text.narrow16(F.col("d")), d="a\0b\0") == "ab"


def test_tld(spark):
    for address, ok in [("a@b.com", True), ("a@b.COM", True), ("a@b.zz", False), ("com", False), ("a@b.", False)]:
        assert one(spark, text.tld_ok(F.col("d")), d=address) is ok
    assert len(default_tlds()) == 273


def test_alternation_matches_exactly_the_names():
    rx = re.compile(alternation(default_tlds()))
    assert all(rx.fullmatch(n) and rx.fullmatch(n.lower()) for n in default_tlds())
    assert not any(rx.fullmatch(n) for n in ("XX", "CO1", "COMM", "", "Q"))


def test_address_parts(spark):
    def ok(local, domain, **kw):
        return one(spark, text.addr_ok(F.col("l"), F.col("d"), **kw), l=local, d=domain)

    assert ok("a" * 64, "b" * 256) and not ok("a" * 65, "b") and not ok("a", "b" * 257)
    assert not ok("a b", "c") and ok("a b", "c", allow_space=True) and not ok("a(", "c") and not ok("", "c")


def test_paths_and_shards(spark):
    assert one(spark, text.child_path(F.col("p"), F.col("c"), F.col("o")), p="1000", c="gzip", o=7) == "1000-GZIP-7"
    assert one(spark, digest.shard(F.col("o")), o=2_999_999_999) == 2
    assert one(spark, text.abs_offset(F.lit(100), F.lit(7))) == 107


def test_zero_block(spark):
    assert one(spark, digest.block_md5(F.col("d")), d=bytes(512)) == digest.zero_block_md5()
    assert not one(spark, digest.not_zero_block(digest.block_md5(F.col("d"))), d=bytes(512))
    df = spark.createDataFrame([(bytearray(b"a"),)], "d binary")
    assert rows(df.select(digest.block_md5(F.col("d")))) == [("0CC175B9C0F1B6A831C399E269772661",)]
