"""Buffers packed inside images: found by signature, unpacked and scanned again.

Each round takes the slices of one depth. Signatures are found by expressions; the stream behind
each is unpacked in Arrow batches, first from the bytes at hand. The few streams that go on are
fed from the following slices, in order and slice by slice, over eight times as many bytes in each
pass. No row ever holds more than a slice and no stream is too long: what is unpacked leaves the
task as slices while the stream is read. A stream that is damaged or cut off by the end of its
image gives what came before that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .boundary import MARGIN, id_columns, windows
from .scanners import found_by_pattern, scan_email

# First bytes of packed streams, and the deepest level unpacked.
SIGNATURES = {
    "gzip": r"\x1f\x8b\x08",
    "zip": r"PK\x03\x04",
    "zlib": r"\x78[\x01\x5e\x9c\xda]",
}
MAX_DEPTH = 7

SLICE_BYTES = 65536
#: bytes given to a decoder at once, and in its second try where these hold a fault
FEED_BYTES, CAREFUL_BYTES = 4096, 64
#: unpacked bytes that leave a task together
FLUSH_BYTES = 4 << 20

_HIT = ["kind", "at"]


def drop_seen(slices: DataFrame, seen: DataFrame) -> DataFrame:
    """Buffers whose MD5 is not in `seen` (digest)."""
    digested = slices.withColumn("digest", F.md5("data"))
    return digested.join(seen.select("digest"), "digest", "left_anti").drop("digest")


def find_streams(slices: DataFrame) -> DataFrame:
    """(ids, base, buffer, hits): the bytes at hand of each slice, once, and where signatures begin in its own bytes.

    One pass looks for all signatures; no two of them can overlap. `hits` is an array of (kind, at).
    """
    ids = id_columns(slices)
    found = F.expr(found_by_pattern("|".join(SIGNATURES.values())))
    # outer, as an inner generator would have the expression evaluated a second time in an inferred filter
    rows = windows(slices).select(*ids, "base", "buffer", "own_from", "own_to", F.explode_outer(F.array(found)).alias("found"))
    rows = rows.where("found is not null")

    def named(feature):
        kind = F.when(F.lit(False), "")
        for name, pattern in SIGNATURES.items():
            kind = kind.when(feature.rlike(rf"\A(?:{pattern})"), name)
        return kind

    hits = F.transform("found", lambda m: F.struct(named(m["feature"]).alias("kind"), (F.col("base") + m["pos"]).alias("at")))
    ours = F.filter(hits, lambda h: (h["at"] >= F.col("own_from")) & (h["at"] < F.col("own_to")))
    return rows.select(*ids, "base", "buffer", ours.alias("hits")).where(F.size("hits") > 0)


class Stream:
    """One packed stream, fed in order; its content comes out in pieces of at most SLICE_BYTES.

    `state` is "more" until the stream ends ("done"), holds a fault ("bad") or turns out to be a
    zip member that is not deflated ("stored", whose bytes the plain scan sees).
    """

    def __init__(self, kind: str):
        import zlib

        self.kind, self.state, self.head, self.ready = kind, "more", b"", kind != "zip"
        self.decoder = zlib.decompressobj({"gzip": 31, "zlib": 15, "zip": -15}[kind])

    def feed(self, data: bytes | memoryview) -> Iterator[bytes]:
        if not self.ready:
            data = self.head = self.head + bytes(data)
            if len(data) < 30:
                return
            if int.from_bytes(data[8:10], "little") != 8:
                self.state = "stored"
                return
            start = 30 + int.from_bytes(data[26:28], "little") + int.from_bytes(data[28:30], "little")
            if len(data) < start:
                return
            data, self.head, self.ready = data[start:], b"", True
        for at in range(0, len(data), FEED_BYTES):
            if self.state != "more":
                return
            yield from self.careful(data[at : at + FEED_BYTES])

    def careful(self, data: bytes) -> Iterator[bytes]:
        """Decode; where that fails, once more from before it in small steps up to the fault."""
        import zlib

        before = self.decoder.copy()
        try:
            out = list(self.decoded(data))
        except zlib.error:
            self.decoder, out = before, []
            try:
                for at in range(0, len(data), CAREFUL_BYTES):
                    for piece in self.decoded(data[at : at + CAREFUL_BYTES]):
                        out.append(piece)
            except zlib.error:
                self.state = "bad"
        yield from out

    def decoded(self, data: bytes) -> Iterator[bytes]:
        while True:
            out = self.decoder.decompress(data, SLICE_BYTES)
            data = self.decoder.unconsumed_tail
            if out:
                yield out
            if self.decoder.eof:
                self.state = "done"
                return
            if not data and len(out) < SLICE_BYTES:
                return


class Slicer:
    """Pieces of any size to slices of SLICE_BYTES with MARGIN bytes of context on each side."""

    def __init__(self):
        self.before, self.buffer, self.offset = b"", b"", 0

    def put(self, piece: bytes) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        self.buffer += piece
        while len(self.buffer) >= SLICE_BYTES + MARGIN:
            yield self.cut()

    def rest(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        while self.buffer:
            yield self.cut()

    def cut(self) -> tuple[int, bytes, bytes, bytes]:
        data, self.buffer = self.buffer[:SLICE_BYTES], self.buffer[SLICE_BYTES:]
        row = (self.offset, data, self.before, self.buffer[:MARGIN])
        self.before, self.offset = data[-MARGIN:], self.offset + len(data)
        return row


def _at_hand(batch, ids: int) -> Iterator[tuple[tuple, int, memoryview]]:
    """(key, start, bytes from there on) of each hit of a batch of `find_streams`, all of a slice out of one buffer."""
    named, base, buffer, hits = ([batch.column(k) for k in range(ids)], *(batch.column(ids + k) for k in range(3)))
    for n in range(batch.num_rows):
        name = tuple(c[n].as_py() for c in named)
        start, view = base[n].as_py(), memoryview(buffer[n].as_buffer())
        for hit in hits[n].as_py():
            yield (*name, hit["kind"], hit["at"]), hit["at"], view[hit["at"] - start :]


def _in_order(batch, ids: int) -> Iterator[tuple[tuple, int, memoryview]]:
    """The like for a batch of `_following`: pieces of a stream, in order."""
    columns = [batch.column(k) for k in range(ids + 4)]
    for n in range(batch.num_rows):
        *name, kind, at, start = (c[n].as_py() for c in columns[:-1])
        view = memoryview(columns[-1][n].as_buffer())
        yield (*name, kind, at), max(start, at), view[max(0, at - start) :]


def _unpacked(rows: DataFrame, ids: list[str], pieces: Callable, kinds: dict[str, T.DataType]) -> DataFrame:
    """(ids, kind, at, state, offset, data, before, after) of the streams whose pieces `pieces` gives.

    The pieces of a stream lie in one partition, in order. Its content comes as slices without a
    state, then one row with its state.
    """
    fields = [T.StructField(c, kinds[c]) for c in ids] + [T.StructField("kind", T.StringType()), T.StructField("at", T.LongType())]
    fields += [T.StructField("state", T.StringType()), T.StructField("offset", T.LongType())]
    schema = T.StructType(fields + [T.StructField(c, T.BinaryType()) for c in ("data", "before", "after")])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target, rows, held = to_arrow_schema(schema), [], 0

        def batch():
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), target)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, schema=target)

        key = stream = slicer = None
        for part in batches:
            for this, _, view in pieces(part, len(ids)):
                if this != key:
                    if key is not None:
                        rows += [(*key, None, *r) for r in slicer.rest()] + [(*key, stream.state, None, None, None, None)]
                    key, stream, slicer = this, Stream(this[-2]), Slicer()
                for piece in stream.feed(view):
                    new = [(*key, None, *r) for r in slicer.put(piece)]
                    rows += new
                    held += sum(len(r[-3]) for r in new)
                    if held > FLUSH_BYTES:
                        yield batch()
                        held = 0
                if len(rows) >= 1024:
                    yield batch()
                    held = 0
        if key is not None:
            rows += [(*key, None, *r) for r in slicer.rest()] + [(*key, stream.state, None, None, None, None)]
        if rows:
            yield batch()

    return rows.mapInArrow(run, schema)


def _following(hits: DataFrame, slices: DataFrame, ids: list[str], width: int, size: int) -> DataFrame:
    """The slices that cover `width` bytes from each hit, in order, a hit's slices in one partition."""
    unit = F.lit(size).cast("long")
    first = F.call_function("div", F.col("at"), unit)
    last = F.call_function("div", F.col("at") + width - 1, unit)
    wanted = hits.select(*ids, *_HIT, F.explode(F.sequence(first, last)).alias("range"))
    whole = F.when(F.col("offset") % unit == 0, F.call_function("div", F.col("offset"), unit))
    place = F.coalesce(whole, F.raise_error(F.lit(f"slices must begin at multiples of {size}")).cast("long"))
    parts = slices.select(*ids, place.alias("range"), F.col("offset").alias("from"), F.col("data").alias("packed"))
    joined = wanted.join(parts, [*ids, "range"]).select(*ids, *_HIT, "from", "packed")
    return joined.repartition(*ids, *_HIT).sortWithinPartitions(*ids, *_HIT, "from")


def expand_once(slices: DataFrame, size: int = SLICE_BYTES) -> DataFrame:
    """Slices of all buffers packed directly inside `slices`, named by `recursion_prefix`.

    `size` is the slice width of the input, whose slices must begin at its multiples.
    """
    if "recursion_prefix" not in slices.columns:
        slices = slices.withColumn("recursion_prefix", F.lit(""))
    ids = id_columns(slices)
    content = ["offset", "data", "before", "after"]
    kinds = {c: slices.schema[c].dataType for c in ids}
    found = stored(_unpacked(find_streams(slices), ids, _at_hand, kinds), "unpacked")
    ends = slices.groupBy(*ids).agg(F.max(F.col("offset") + F.length("data")).alias("end"))
    open_hits = stored(found.where("state = 'more'").select(*ids, *_HIT).join(ends, ids), "open")
    result = found.where("state is null").join(open_hits.select(*ids, *_HIT), [*ids, *_HIT], "left_anti")
    width = size
    while not open_hits.isEmpty():
        width *= 8
        found = stored(_unpacked(_following(open_hits, slices, ids, width, size), ids, _in_order, kinds), "unpacked")
        # a stream that was given all bytes of its image has no more to come
        going_on = found.where("state = 'more'").select(*ids, *_HIT).join(open_hits, [*ids, *_HIT])
        open_hits = stored(going_on.where(F.col("at") + width < F.col("end")), "open")
        ended = found.where("state is null").join(open_hits.select(*ids, *_HIT), [*ids, *_HIT], "left_anti")
        result = result.unionByName(ended)
    at = F.col("at").cast("string")
    path = F.when(F.col("recursion_prefix") == "", at).otherwise(F.concat_ws("-", "recursion_prefix", at))
    outer = [c for c in ids if c != "recursion_prefix"]
    return result.select(*outer, F.concat(path, F.lit("-"), F.upper("kind")).alias("recursion_prefix"), *content)


def expand_embedded(
    slices: DataFrame, max_depth: int = MAX_DEPTH, size: int = SLICE_BYTES, seen: DataFrame | None = None
) -> Iterable[DataFrame]:
    """Slices of the packed buffers, one DataFrame per depth, until a depth has none.

    Slices whose digest is in `seen` are dropped, and with them what is packed inside.
    """
    level, width = slices, size
    for _ in range(max_depth):
        level = expand_once(level, width)
        if seen is not None:
            level = drop_seen(level, seen)
        level = stored(level, "level")
        if level.isEmpty():
            return
        yield level
        width = SLICE_BYTES


def scan_recursive(
    slices: DataFrame,
    max_depth: int = MAX_DEPTH,
    size: int = SLICE_BYTES,
    scanner: Callable[[DataFrame], DataFrame] = scan_email,
    seen: DataFrame | None = None,
) -> DataFrame:
    """What `scanner` finds in images and in all buffers packed in them, with `recursion_prefix`."""
    top = slices.withColumn("recursion_prefix", F.lit(""))
    result = scanner(top)
    for level in expand_embedded(top, max_depth, size, seen):
        result = result.unionByName(scanner(level))
    return result


def forensic_path(features: DataFrame) -> DataFrame:
    """Features with `path`: the offset, behind the path of the buffer it lies in."""
    inner = F.concat_ws("-", "recursion_prefix", F.col("offset").cast("string"))
    plain = F.col("offset").cast("string")
    return features.withColumn("path", F.when(F.col("recursion_prefix") == "", plain).otherwise(inner))
