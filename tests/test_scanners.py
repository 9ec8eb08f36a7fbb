"""Scanners against Python's `re` on the same bytes."""

import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from slicewise.functions.patterns import default_tlds
from slicewise.operators.boundary import reslice, seams
from slicewise.operators.scanners import found_by_pattern, scan, scan_email, scan_email_anchor, scan_pattern, to_artifacts
from slicewise.sources.files import chunk, read_raw

TLD8 = "|".join(sorted(default_tlds(), key=len, reverse=True)).encode()
TLD16 = b"|".join(
    b"".join(bytes([c]) + rb"\x00" for c in name.encode()) for name in sorted(default_tlds(), key=len, reverse=True)
)
LEXER = re.compile(
    rb"(?i)(?:[a-z0-9][a-z0-9._%+\-]{1,64}@[a-z0-9._%\-]{1,64}\.(?:" + TLD8 + rb")(?=[^a-z]))"
    rb"|(?:[a-z0-9]\x00(?:[a-z0-9._%+\-]\x00){1,64}@\x00(?:[a-z0-9._%\-]\x00){1,64}\.\x00(?:"
    + TLD16
    + rb")(?=[^a-z]|[\s\S][^\x00]))"
)


def utf16(text):
    return text.encode("utf-16le")


def lexed(contents):
    return sorted(
        (name, m.start(), m.group().decode("latin1"), data[max(0, m.start() - 16) : m.end() + 16].decode("latin1"))
        for name, data in contents.items()
        for m in LEXER.finditer(data)
    )


def anchored(contents, allow_space):
    """The anchor rule byte by byte: no text, no regular expression."""
    bad = set(b'"(),:;<>@[\\]') | set(range(0x20 if allow_space else 0x21)) | set(range(0x80, 0x100))
    tlds = set(default_tlds())
    found = []
    for name, data in contents.items():
        for at in (i for i, b in enumerate(data) if b == 0x40):
            step = 2 if data[at + 1 : at + 2] == b"\0" else 1
            low = at
            while low >= step and data[low - step] not in bad and (step == 1 or data[low - 1] == 0):
                low -= step
            high = at + step
            while high + step <= len(data) and data[high] not in bad and (step == 1 or data[high + 1] == 0):
                high += step
            local, domain = data[low:at:step], data[at + step : high : step]
            text = (local + b"@" + domain).decode("latin1")
            if 1 <= len(local) <= 64 and 1 <= len(domain) <= 256 and "." in text:
                if text.rsplit(".", 1)[1].upper() in tlds:
                    found.append((name, low, text))
    return sorted(found)


@pytest.fixture(scope="module")
def corpus():
    random.seed(11)
    parts = [
        b"ab@c.com", b"x1", b"@", b".", b"com", b" ", b"foo.bar@mail.example.org", b"\x00", utf16("ab@cd.net"),
        "Łß".encode(), b"q" * 70, b".co.uk", b"\xff", utf16("me@x.museum "), b"m\x00", b"a@b.com@c.org", b"1x@c.org",
        b"\n", b"\\", b"(", utf16("a b@c.de"),
    ]
    return {str(i): b"".join(random.choice(parts) for _ in range(300)) for i in range(40)}


def test_lexer_equals_re(images, corpus):
    assert rows(scan_email(chunk(images(corpus), "image", "data", 1 << 20))) == lexed(corpus)


@pytest.mark.parametrize("size,margin", [(2048, 1024), (1024, 512), (600, 300)])
def test_lexer_over_seams(images, corpus, size, margin):
    assert rows(scan_email(seams(chunk(images(corpus), "image", "data", size), margin))) == lexed(corpus)


def test_lexer_with_context_columns(images, corpus):
    assert rows(scan_email(chunk(images(corpus), "image", "data", 700, 512))) == lexed(corpus)


def test_lexer_after_reslice(images, corpus):
    pieces = chunk(images(corpus), "image", "data", 37)
    assert rows(scan_email(reslice(pieces, 1000, 600))) == lexed(corpus)


@pytest.mark.parametrize("space", [False, True])
def test_anchor_rule(images, corpus, space):
    found = scan_email_anchor(chunk(images(corpus), "image", "data", 2048, 1024), allow_space=space)
    assert rows(found.select("image", "offset", "feature")) == anchored(corpus, space)


@pytest.mark.parametrize("space", [False, True])
def test_anchor_rule_over_seams(images, corpus, space):
    found = scan_email_anchor(seams(chunk(images(corpus), "image", "data", 2048)), allow_space=space)
    assert rows(found.select("image", "offset", "feature")) == anchored(corpus, space)


def test_lexer_edges(images):
    cases = {
        "end": b"ab@c.com",
        "end_but_one": b"ab@c.com\n",
        "short_local": b"a@c.com ",
        "unknown": b"ab@c.notatld ",
        "local65": b" " + b"a" * 65 + b"@c.com ",
        "local66": b" " + b"a" * 66 + b"@c.com ",
        "domain64": b"ab@" + b"d" * 64 + b".com ",
        "domain65": b"ab@" + b"d" * 65 + b".com ",
        "nul": b"\0ab@c.com\0",
        "ff": b"\xffab@c.com\xff",
        "wide_after": b"ab@c.com" + utf16("xy@z.org "),
        "case": b"AB@C.CoM ",
        "longest": b"ab@c.co.uk ",
        "letters": b"ab@c.comx ",
    }
    assert rows(scan_email(chunk(images(cases), "image", "data"))) == lexed(cases)
    found = {r[0] for r in lexed(cases)}
    assert "end" not in found and "end_but_one" in found and "local66" in found and "domain65" not in found


def test_anchor_edges(images):
    cases = {
        "two": b"a@b.com@c.org",
        "local64": b" " + b"a" * 64 + b"@c.com",
        "local65": b" " + b"a" * 65 + b"@c.com",
        "domain256": b"a@" + b"d" * 252 + b".com",
        "domain257": b"a@" + b"d" * 253 + b".com",
        "wide256": utf16("a@" + "d" * 252 + ".com "),
        "wide257": utf16("a@" + "d" * 253 + ".com "),
        "wide64": utf16(" " + "a" * 64 + "@c.com "),
        "wide65": utf16(" " + "a" * 65 + "@c.com "),
        "dot": b"a@.com",
        "del": b"a\x7f@b.com",
    }
    found = rows(scan_email_anchor(chunk(images(cases), "image", "data")).select("image", "offset", "feature"))
    assert found == anchored(cases, False)
    assert [r for r in found if r[0] == "two"] == [("two", 0, "a@b.com"), ("two", 2, "b.com@c.org")]


def test_many_matches_in_one_slice(images):
    contents = {"list": b"".join(b"user%d@host%d.example.com\n" % (i, i) for i in range(3000))}
    assert rows(scan_email(chunk(images(contents), "image", "data", 1 << 20))) == lexed(contents)


def test_own_top_level_domains(images):
    long = "photography"
    contents = {"a": b"ab@c." + long.encode() + b" ab@c.com ", "b": utf16("ab@" + "d" * 64 + f".{long} ")}
    s = chunk(images(contents), "image", "data")
    found = rows(scan_email(s, tlds=[long]).select("image", "offset"))
    assert found == [("a", 0), ("b", 0)]
    assert rows(scan_email_anchor(s, tlds=[long]).select("image", "offset")) == [("a", 0), ("b", 0)]


def test_pattern_scan_and_classes(images):
    contents = {"a": b"12 ab@c.com \xff345,6789", "b": b"", "c": b"none"}
    pattern = "[0-9]{2,}"
    expected = sorted(
        (name, m.start(), m.group().decode())
        for name, data in contents.items()
        for m in re.finditer(pattern.encode(), data)
    )
    s = chunk(images(contents), "image", "data")
    assert rows(scan_pattern(s, pattern).select("image", "offset", "feature")) == expected
    both = scan(s, {"email": None, "number": pattern})
    assert rows(both.groupBy("artifact_class").count()) == [("email", 1), ("number", 3)]
    with pytest.raises(ValueError):
        scan(s, {"telephone": None})


def test_artifact_rows_keep_bytes(images):
    wide = utf16("ab@cd.net ")
    found = to_artifacts(scan_email(chunk(images({"a": wide}), "image", "data")), "email").collect()
    assert [(r.artifact_class, r.stream_name, r.recursion_prefix, r.offset) for r in found] == [("email", "a", "", 0)]
    assert bytes(found[0].artifact) == wide[:-2]


def test_scan_stays_in_the_jvm(images):
    plan = scan_email(chunk(images({"a": b"x"}), "image", "data"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_any_number_of_classes_reads_once(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(b"call 12345 or ab@c.com now " * 3)
    slices = read_raw(spark, str(tmp_path), overlap=64)
    found = scan(slices, {"email": None, "number": "[0-9]{5}", "word": "now"})
    assert [r.artifact_class for r in found.orderBy("offset").collect()] == ["number", "email", "word"] * 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and "Exchange" not in plan


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 5000])
def test_positions_of_many_matches_are_not_appended_one_by_one(images, n):
    """Offsets come from sums by doubling; a fold that appends was most of a scan's time."""
    data = b"".join(b"x" * (k % 3) + b"%d" % k + b" " for k in range(n))
    got = rows(scan_pattern(images({"i": data}).withColumn("offset", F.lit(0).cast("long")), "[0-9]+").select("offset", "feature"))
    assert got == sorted((m.start(), m.group().decode()) for m in re.finditer(rb"[0-9]+", data))
    assert "a.found" not in found_by_pattern("[0-9]+")
