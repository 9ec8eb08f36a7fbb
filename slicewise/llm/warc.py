"""WARC archives: writing pages as records, and reading them back by boundary-chain verification.

Writing: of the pages with equal payloads that are long enough, the one with the largest id is a `response`, the
others are `revisit` records that refer to it and carry no payload. Records are written as text lines whose end is the
record end, so Spark's own writer puts them into the shared folder.

Reading: archives are read as byte ranges, each by its own task. A task looks for the magic `WARC/1.1` at the start of
a line in its range, reads the header there and its content length, and so gives a candidate: where a record may begin
and where its successor would. The magic may as well stand inside a payload. So the candidates of a file are linked
to their successors, and pointer jumping from the file's start finds those on the chain: after k rounds each candidate
on it knows the one 2^k records on. Only records reachable from the start are real; a candidate inside a payload is
not among them, whatever it looks like. A chain must end at the end of its file, or the file is reported as broken.

Each task hashes the payload of its candidates as it reads them, so no payload is ever moved; it may read on past its
range's end, in pieces of READ bytes. An archive folder is any path that pyarrow's file systems know.

Defined results: a null page is an empty payload; an url may have any length, as a header is read to its empty line; rows that repeat the
largest id with its payload are responses too, so no payload is in no record, however `pages` is read; a null id is
written as an empty one, sorts below all others (pages without any id are all responses) and comes back as null; an empty table gives an archive without
records.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder
from ..sources.rawimage import find_files, open_filesystem
from .tables import stored

MAGIC, END = b"WARC/1.1\r\n", b"\r\n\r\n"
#: bytes of a range, and bytes that are read at once
RANGE, READ = 4 << 20, 1 << 20
#: bytes of a header that are read first; a longer one is read on to its end
HEADER = 1 << 16
# The alphabet of base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload) -> F.Column:
    """SHA-1 in base 32: 160 bits are 32 digits of 5 bits."""
    digest = F.sha1(payload)
    parts = []
    for at in range(1, 41, 10):  # ten hexadecimal digits are eight of base 32
        value = F.conv(F.substring(digest, at, 10), 16, 10).cast("bigint")
        for shift in range(35, -1, -5):
            place = F.shiftright(value, shift).bitwiseAND(F.lit(31)).cast("int") + 1
            parts.append(F.substring(F.lit(BASE32), place, F.lit(1)))
    return F.concat(*parts)


def records(pages: DataFrame, key: str, url: str, html: str, least: int = 0) -> DataFrame:
    """(id, url, payload, bytes, digest, kind, refers_to) of every page."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("bigint"))
    rows = rows.withColumn("digest", sha1_base32(F.encode("payload", "UTF-8")))
    # a group is named by its largest id alone, so nothing depends on how often or in which order rows are read
    long = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes")
    last = stored(long.agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1"), "copies")
    joined = rows.join(last.select("digest", "bytes", "last"), ["digest", "bytes"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    return joined.select(
        "id", "url", "payload", "bytes", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("last")).alias("refers_to"),
    )


def write(pages: DataFrame, folder: str, key="page_id", url="url", html="html", least: int = 0, files: int = 0) -> None:
    """Archives of all pages in `folder`, one file for each task (or `files` of them)."""
    rows = records(pages, key, url, html, least)
    clean = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    body = F.when(F.col("kind") == "response", F.col("payload")).otherwise(F.lit(""))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "kind"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), text("id"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.concat(F.lit("X-Payload-Length: "), text("bytes")),
        F.when(F.col("kind") == "revisit", F.concat(F.lit("WARC-Refers-To: <urn:page:"), text("refers_to"), F.lit(">"))),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    value = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), body)
    out = rows.select(value.alias("value"))
    (out.repartition(files) if files else out).write.option("lineSep", "\r\n\r\n").text(folder)


def parse_header(data: bytes) -> tuple[dict, int] | None:
    """(fields in lower case, length of the header with its empty line), or None if it is not a whole header."""
    end = data.find(END)
    if not data.startswith(MAGIC) or end < 0:
        return None
    fields = {}
    for line in data[len(MAGIC) : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")):
        return None
    return fields, end + len(END)


FIELDS = "file string, size bigint, start bigint, next bigint, body bigint, length bigint, kind string, record string, uri string, refers string, digest string, payload_length bigint, body_digest string"


def ranges(spark: SparkSession, folder: str, span: int = RANGE) -> DataFrame:
    """(file, size, start, stop) of all byte ranges of the archives below `folder`; files are listed on the driver."""
    own = lambda path: not path.rsplit("/", 1)[-1].startswith(("_", "."))  # noqa: E731  the writer's marks and sums
    files = [(path, size) for path, size in find_files(folder) if size and own(path)]
    listed = spark.createDataFrame(files, "file string, size bigint") if files else spark.createDataFrame([], "file string, size bigint")
    cuts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(span).cast("bigint")))
    cut = listed.select("file", "size", cuts.alias("start"))
    return cut.withColumn("stop", F.least(F.col("start") + span, F.col("size"))).repartition(
        max(1, sum(-(-size // span) for _, size in files)), "file", "start"
    )


def candidates(spark: SparkSession, folder: str, span: int = RANGE) -> DataFrame:
    """Every place that looks like a record, with the place of its successor; see FIELDS."""

    def read_range(f, size: int, start: int, stop: int):
        """Candidates that begin in [start, stop)."""

        def at(low: int, n: int) -> bytes:
            f.seek(low)
            return f.read(min(n, size - low))

        def header(place: int) -> bytes:
            """The bytes from `place` to an empty line, or else to a line that is no field or the file's end."""
            data = at(place, HEADER)
            while END not in data and place + len(data) < size:
                if any(b":" not in line for line in data[len(MAGIC) :].split(b"\r\n")[:-1]):
                    break
                data += at(place + len(data), len(data))
            return data

        position = start
        while position < stop:
            end = min(position + READ, stop)
            # a line feed before the magic; the bytes after it, in case the magic crosses the end
            low = max(0, position - 1)
            data = at(low, end - low + len(MAGIC))
            found = [low + m.start() + (1 if m.group(0)[:1] == b"\n" else 0) for m in re.finditer(rb"(?:\n|\A)WARC/1\.1\r\n", data)]
            for place in found:
                if not position <= place < end or (place and data[place - low - 1 : place - low] != b"\n"):
                    continue
                parsed = parse_header(header(place))
                if parsed is None:
                    continue
                fields, head = parsed
                length = int(fields["content-length"])
                body = place + head
                if body + length + len(END) > size:
                    continue
                sha, left, offset = hashlib.sha1(), length, body
                while left:
                    piece = at(offset, min(left, READ))
                    sha.update(piece)
                    offset, left = offset + len(piece), left - len(piece)
                if at(body + length, len(END)) != END:
                    continue
                number = fields.get("x-payload-length", "")
                yield (
                    place, body + length + len(END), body, length, fields.get("warc-type"),
                    fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"),
                    fields.get("warc-payload-digest"), int(number) if number.isdigit() else None,
                    base64.b32encode(sha.digest()).decode(),
                )
            position = end

    names = [part.split()[0] for part in FIELDS.split(", ")]
    types = [pa.int64() if part.split()[1] == "bigint" else pa.string() for part in FIELDS.split(", ")]

    def run(batches):
        filesystem, _ = open_filesystem(folder)
        for batch in batches:
            for file, size, start, stop in zip(*[c.to_pylist() for c in batch.columns]):
                with filesystem.open_input_file(file) as f:
                    rows = [(file, size, *row) for row in read_range(f, size, start, stop)]
                columns = list(zip(*rows)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return ranges(spark, folder, span).mapInArrow(run, FIELDS)


def reachable(found: DataFrame) -> DataFrame:
    """The candidates on their file's chain, by pointer jumping from the file's start.

    `reached` grows from the start by the jumps of 2^k records; `jump` doubles in each round, so a file of n records
    takes log2(n) rounds. Only offsets are moved, by merge joins: written tables are smaller than what they hold, so
    they would pass for ones that can be broadcast.
    """
    jump = stored(found.select("file", "start", F.col("next").alias("to")), "jumps")
    reached = stored(found.where("start = 0").select("file", "start"), "reached")
    while True:
        new = reached.join(jump.hint("merge"), ["file", "start"]).select("file", F.col("to").alias("start"))
        more = stored(reached.unionByName(new).distinct(), "reached")
        far = jump.select("file", F.col("start").alias("to"), F.col("to").alias("far"))
        longer = stored(jump.join(far.hint("merge"), ["file", "to"]).select("file", "start", F.col("far").alias("to")), "jumps")
        reached, jump = more, longer
        if jump.isEmpty():
            break
    return found.join(reached.hint("merge"), ["file", "start"], "left_semi")


def read(spark: SparkSession, folder: str, span: int = RANGE) -> DataFrame:
    """The records of all archives (FIELDS): those that the chain from the start of their file reaches.

    Fails where a file's chain does not end at its end, naming such a file.
    """
    found = stored(candidates(spark, folder, span), "candidates")
    real = reachable(found)
    ends = real.groupBy("file").agg(F.max("next").alias("end"))
    files = ranges(spark, folder, span).select("file", "size").distinct()
    broken = files.join(ends, "file", "left").where(F.coalesce("end", F.lit(0)) != F.col("size"))
    if names := [r["file"] for r in broken.select("file").limit(5).collect()]:
        raise ValueError(f"the record chain breaks off in {names}")
    return real


def page_number(urn: str) -> F.Column:
    """The id in a record's name, as a number; null for an empty one."""
    return F.regexp_extract(urn, "^<urn:page:(.*)>$", 1).try_cast("bigint")


def round_trip(pages: DataFrame, key="page_id", url="url", html="html", least: int = 0, folder: str | None = None):
    """(key, payload_bytes, payload_digest, record_type, refers_to) of every page, from archives written and read back.

    The digest of a response is that of the bytes read; a revisit's is the one it was written with.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    write(pages, folder, key, url, html, least)
    got = read(spark, folder)
    response = F.col("kind") == "response"
    return got.select(
        page_number("record").alias(key),
        F.when(response, F.col("length")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.col("body_digest")).otherwise(F.regexp_replace("digest", "^sha1:", "")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        page_number("refers").alias("refers_to"),
    )
