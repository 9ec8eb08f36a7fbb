"""One query per operator over the driver tables."""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digest, text
from ..operators import artifacts as art
from ..operators import cells as cell
from ..operators import (
    compaction, embedded, hashes, histogram, joins, keywords, membership, scanners, similarity, sinks, throughput,
)
from ..operators.boundary import reslice, seams
from ..operators.stitching import Within
from ..session import new_folder
from ..sources import files, logs, tables
from ..streaming import ingest, seen
from . import lifecycle
from . import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: address looked for by the lookup and top-k queries
ADDRESS_WORD = "thing"
SEED_FILE = 1
NEAR = 1000
BUCKET = 600


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _hex(c: str | Column) -> Column:
    return F.hex(c)


def _text_hex(c: str) -> Column:
    return F.hex(text.latin1_bytes(F.col(c)))


def _shown(features: DataFrame) -> DataFrame:
    return features.select("image", "offset", "feature", _text_hex("context").alias("context_hex"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashes.block_hashes(v.plain_slices(spark, sf_dir))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.block_tokens(_blocks(spark, sf_dir))


# ---- sources

@query
def chunk_slices(spark, sf_dir):
    return v.plain_slices(spark, sf_dir).select("image", "offset", _hex("data").alias("data_hex"))


@query
def list_image_sizes(spark, sf_dir):
    return v.document_listing(spark, sf_dir)


@query
def limit_by_bytes(spark, sf_dir):
    return files.limit_images(v.document_listing(spark, sf_dir), max_bytes=1_000_000)


@query
def limit_first_images(spark, sf_dir):
    named = v.document_listing(spark, sf_dir).withColumn("image", F.col("image").cast("string"))
    return files.limit_images(named, n=100, include="1", exclude="7")


@query
def union_inputs(spark, sf_dir):
    both = files.union_all(
        v.document_listing(spark, sf_dir).withColumn("kind", F.lit("document")),
        v.page_listing(spark, sf_dir).withColumn("kind", F.lit("page")),
    )
    return both.select("kind", "image", "length")


@query
def split_order(spark, sf_dir):
    s = v.plain_slices(spark, sf_dir).select(
        "image", F.col("offset").alias("start"), F.length("data").cast("long").alias("length")
    )
    return files.order_splits(s)


@query
def raw_files_email(spark, sf_dir):
    """Documents as image files, cut into small slices and scanned over their boundaries."""
    s = files.read_raw(spark, v.raw_document_files(spark, sf_dir), sliceBytes=4096, overlap=1024, exclude=v.MARKS)
    found = scanners.scan_email(s)
    return found.groupBy(v.source_of().alias("source"), "feature").agg(F.count("*").alias("n"))


@query
def raw_files_histogram(spark, sf_dir):
    s = files.read_raw(spark, v.raw_document_files(spark, sf_dir), exclude=v.MARKS)
    by_source = s.select(v.source_of().alias("source"), "data")
    return histogram.byte_histogram(by_source, ["source"]).groupBy("source", "byte").agg(F.sum("n").alias("n"))


@query
def raw_files_sizes(spark, sf_dir):
    """Listed, read whole and read in slices: three times the same bytes."""
    path = v.raw_document_files(spark, sf_dir)

    def total(df, name, length):
        return df.groupBy(v.source_of().alias("source")).agg(F.sum(length).alias(name))

    listed = total(files.list_images(spark, path, v.MARKS), "listed", F.col("length"))
    whole = total(files.whole_files(spark, path, v.MARKS), "whole", F.length("data").cast("long"))
    sliced = total(files.read_raw(spark, path, exclude=v.MARKS), "sliced", F.length("data").cast("long"))
    return listed.join(whole, "source").join(sliced, "source")


def _raw_files(spark, sf_dir, **options):
    s = files.read_raw(spark, v.raw_document_files(spark, sf_dir), exclude=v.MARKS, **options)
    return s.withColumn("source", v.source_of())


@query
def raw_image_slices(spark, sf_dir):
    """Image files in slices with context: all bytes, and those that the context repeats."""
    s = _raw_files(spark, sf_dir, sliceBytes=4096, overlap=64)
    context = F.when(F.col("offset") > 0, F.length("before")).otherwise(F.lit(0))
    return s.groupBy("source").agg(
        F.sum(F.length("data").cast("long")).alias("bytes"),
        (F.count_if(F.col("offset") > 0) * 64 - F.sum(context)).alias("missing_context"),
    )


@query
def raw_email_scan(spark, sf_dir):
    """The whole job on files: slices with context, scan, counts per source."""
    found = scanners.scan_email(_raw_files(spark, sf_dir, overlap=1024).drop("source"))
    return found.groupBy(v.source_of().alias("source")).agg(
        F.count("*").alias("n"), F.count_distinct("feature").alias("addresses")
    )


@query
def raw_image_tolerant(spark, sf_dir):
    """A scan that goes on after read errors; these files have none."""
    s = _raw_files(spark, sf_dir, onError="skip", sliceBytes=131072)
    return s.groupBy("source").agg(F.sum(F.length("data").cast("long")).alias("bytes"), F.count("error").alias("errors"))


@query
def raw_unreadable(spark, sf_dir):
    """A tolerant scan of image files and of a folder that is gone: its error is a row of the result."""
    path = v.raw_document_files(spark, sf_dir)
    s = files.read_raw(spark, f"{path},{path}/gone", exclude=v.MARKS, onError="skip")
    return s.groupBy(v.source_of().alias("source")).agg(F.sum(F.length("data").cast("long")).alias("bytes"), F.count("error").alias("errors"))


@query
def raw_ranges(spark, sf_dir):
    """Files of some sources, their first slices and the rest read apart; other files and ranges are not opened."""
    path = v.raw_document_files(spark, sf_dir)
    prefix = f"{files.image_name(path)}/source=src1"
    zero, length = F.lit(0).cast("long"), F.length("data").cast("long")
    head = files.read_raw(spark, path, exclude=v.MARKS, sliceBytes=4096, prefix=prefix, to=8191)
    rest = files.read_raw(spark, path, exclude=v.MARKS, sliceBytes=4096, prefix=prefix, **{"from": 8192})
    head = head.select("image", length.alias("head"), zero.alias("rest"))
    rest = rest.select("image", zero.alias("head"), length.alias("rest"))
    sums = head.unionByName(rest).groupBy("image").agg(F.sum("head").alias("head"), F.sum("rest").alias("rest"))
    even = F.count_if((F.col("rest") > 0) & (F.col("head") < 8192)) == 0
    return sums.groupBy(v.source_of().alias("source")).agg(F.sum(F.col("head") + F.col("rest")).alias("bytes"), even.alias("even"))


@query
def whole_file_sizes(spark, sf_dir):
    """Image files in one row each: their lengths and their line breaks."""
    w = files.whole_files(spark, v.raw_document_files(spark, sf_dir), v.MARKS)
    text = F.decode("data", "UTF-8")
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")
    return w.groupBy(v.source_of().alias("source")).agg(F.sum("length").alias("length"), F.sum(lines).alias("lines"))


@query
def file_listing(spark, sf_dir):
    listed = files.list_images(spark, v.raw_document_files(spark, sf_dir), v.MARKS)
    return listed.groupBy(v.source_of().alias("source")).agg(F.sum("length").alias("length"))


@query
def progress_log(spark, sf_dir):
    return logs.parse_log(v.progress_lines(spark, sf_dir), "progress")


@query
def executor_log(spark, sf_dir):
    return logs.parse_log(v.executor_lines(spark, sf_dir), "executor").select("t", "event")


@query
def log_line_filter(spark, sf_dir):
    return logs.log_filter(v.executor_lines(spark, sf_dir), logs.EXECUTOR_TEXT, logs.STARTED)


@query
def literal_cells(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    lines = e.select(F.concat_ws(",", F.col("event_id").cast("string"), F.lit("f"), F.lit("a"), "event_type").alias("line"))
    return tables.parse_cells(lines, "line")


# ---- scalar functions

@query
def escape_text(spark, sf_dir):
    d = v.document_images(spark, sf_dir)
    return d.select("image", text.escape(text.latin1(F.col("data"))).alias("escaped"))


@query
def latin1_text(spark, sf_dir):
    d = v.document_images(spark, sf_dir)
    t = text.latin1(F.col("data"))
    return d.select("image", F.length(t).cast("long").alias("characters"), F.hex(text.latin1_bytes(t)).alias("data_hex"))


@query
def utf16_narrowed(spark, sf_dir):
    """Texts widened to UTF-16LE and narrowed again; a character of two bytes cannot be narrowed."""
    d = v.text_table(spark, sf_dir, "documents")
    wide = text.latin1(F.encode(F.regexp_replace("text", r"[^\x01-\xff]", "?"), "UTF-16LE"))
    return d.select("doc_id", text.narrow16(wide).alias("narrow"))


@query
def top_level_domains(spark, sf_dir):
    p = v.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/:]+)", 1).alias("host"))
    return p.select("page_id", "host", text.tld_ok(F.col("host")).alias("ok"))


@query
def address_parts_valid(spark, sf_dir):
    p = v.table(spark, sf_dir, "pages").select("page_id", F.split("url", "/", 4).alias("u"))
    p = p.select("page_id", F.get("u", F.lit(3)).alias("local"), F.get("u", F.lit(2)).alias("domain"))
    return p.where("local is not null").select(
        "page_id", text.addr_ok(F.col("local"), F.col("domain")).alias("ok")
    )


@query
def offset_shards(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    return b.groupBy("image", digest.shard(F.col("offset"), 4096).alias("shard")).agg(F.count("*").alias("n"))


@query
def forensic_paths(spark, sf_dir):
    e = v.event_artifacts(spark, sf_dir)
    path = text.child_path(F.col("image").cast("string"), F.col("artifact"), F.col("offset"))
    return e.select("image", "offset", path.alias("path"))


@query
def nonzero_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).where(digest.not_zero_block(F.col("block_md5"))).groupBy("image").agg(F.count("*").alias("n"))


@query
def padded_blocks(spark, sf_dir):
    """Documents filled up with zeros to whole blocks and one more: blocks that hold something, and the others."""
    d = v.document_images(spark, sf_dir)
    missing = 1024 - F.length("data") % 512
    padded = d.select("image", F.concat("data", F.substring(F.lit(bytes(1024)), F.lit(1), missing)).alias("data"))
    b = hashes.block_hashes(files.chunk(padded, "image", "data", v.SLICE))
    full = digest.not_zero_block(F.col("block_md5"))
    return b.groupBy("image").agg(F.count_if(full).alias("blocks"), F.count_if(~full).alias("zero"))


@query
def context_windows(spark, sf_dir):
    """Context of the first word of each slice, cut at the ends of the slice."""
    s = v.plain_slices(spark, sf_dir).select("image", "offset", "data")
    length = F.least(F.lit(8), F.length("data")).cast("long")
    position = F.greatest(F.length("data") - 8, F.lit(0)).cast("long")
    return s.select("image", "offset", F.hex(text.latin1_bytes(text.context(F.col("data"), position, length))).alias("context_hex"))


# ---- scanners

@query
def email_scan(spark, sf_dir):
    return _shown(scanners.scan_email(v.slices(spark, sf_dir)))


@query
def email_scan_seams(spark, sf_dir):
    """Slices stored without context: only the strips around their boundaries are shuffled."""
    return _shown(scanners.scan_email(seams(v.plain_slices(spark, sf_dir, 4096)))).drop("context_hex")


@query
def email_scan_resliced(spark, sf_dir):
    """The documents of a source as pieces of one image, each at its own offset."""
    d = v.text_table(spark, sf_dir, "documents").select(
        F.col("source").alias("image"),
        (F.col("doc_id") * (1 << 24)).alias("offset"),
        F.encode(F.concat("text", F.lit("\n")), "UTF-8").alias("data"),
    )
    return scanners.scan_email(reslice(d, 1 << 16)).select("image", "offset", "feature")


@query
def email_anchor_scan(spark, sf_dir):
    return scanners.scan_email_anchor(v.slices(spark, sf_dir)).select("image", "offset", "feature")


@query
def email_anchor_scan_spaces(spark, sf_dir):
    """With spaces allowed an address runs on to the next other byte, here a semicolon."""
    lines = v.text_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("image"), F.encode(F.regexp_replace("text", r"(@mail[0-9]+\.[a-z]+\.com)", "$1;"), "UTF-8").alias("data")
    )
    s = files.chunk(lines, "image", "data", v.SLICE, 1024)
    return scanners.scan_email_anchor(s, allow_space=True).select("image", "offset", "feature")


@query
def email_scan_utf16(spark, sf_dir):
    """The documents widened to UTF-16LE, as far as their characters fit a byte."""
    d = v.text_table(spark, sf_dir, "documents")
    wide = F.encode(F.regexp_replace("text", r"[^\x00-\xff]", "?"), "UTF-16LE")
    s = files.chunk(d.select(F.col("doc_id").alias("image"), wide.alias("data")), "image", "data", v.SLICE, 1024)
    found = scanners.scan_email(s)
    return found.select("image", "offset", text.narrow16(F.col("feature")).alias("feature"))


@query
def scan_classes(spark, sf_dir):
    """Two classes in one go."""
    found = scanners.scan(v.slices(spark, sf_dir), {"email": None, "word": v.WORDS})
    return found.select("artifact_class", "image", "offset", "feature")


@query
def long_runs(spark, sf_dir):
    """Lines and words of any length on narrow slices: most lines reach over several of them."""
    s = files.chunk(v.document_images(spark, sf_dir), "image", "data", 256)
    found = scanners.scan(s, {"line": Within(r"[^\n]+", r"^\n"), "word": v.WORDS})
    return found.select("artifact_class", "image", "offset", F.md5(text.latin1_bytes(F.col("feature"))).alias("md5"))


@query
def email_anchor_scan_utf16(spark, sf_dir):
    """The anchor rule on documents widened to UTF-16LE; its addresses come as 8-bit text."""
    d = v.text_table(spark, sf_dir, "documents")
    wide = F.encode(F.regexp_replace("text", r"[^\x00-\x7f]", "?"), "UTF-16LE")
    s = files.chunk(d.select(F.col("doc_id").alias("image"), wide.alias("data")), "image", "data", v.SLICE, 1024)
    return scanners.scan_email_anchor(s).select("image", "offset", "feature")


@query
def keyword_scan(spark, sf_dir):
    """Every place of every longer word of the benchmark passages in the documents, inside other words too."""
    words = F.explode(F.regexp_extract_all("text", F.lit(v.WORD), F.lit(0)))
    listed = v.table(spark, sf_dir, "benchmark").select(words.alias("keyword")).distinct()
    return keywords.scan_keywords(v.plain_slices(spark, sf_dir), listed).select("image", "offset", "keyword")


@query
def artifact_rows(spark, sf_dir):
    a = scanners.to_artifacts(scanners.scan_email(v.slices(spark, sf_dir)), "email")
    return a.select("artifact_class", "stream_name", "recursion_prefix", "offset", _hex("artifact").alias("artifact_hex"))


@query
def page_email_scan(spark, sf_dir):
    s = files.chunk(v.page_images(spark, sf_dir), "image", "data", v.SLICE, 1024)
    return scanners.scan_email(s).select("image", "offset", "feature")


@query
def embedded_scan(spark, sf_dir):
    """Documents packed inside images: found, unpacked and scanned again."""
    found = embedded.scan_recursive(files.chunk(v.packed_images(spark, sf_dir), "image", "data", 16384, 1024), size=16384)
    return found.select("image", "recursion_prefix", "offset", "feature")


@query
def unseen_buffers(spark, sf_dir):
    """Slices whose content does not occur in the benchmark passages, by digest."""
    seen = v.table(spark, sf_dir, "benchmark").select(F.md5(F.encode("text", "UTF-8")).alias("digest"))
    return embedded.drop_seen(v.document_images(spark, sf_dir), seen).select("image")


@query
def unlabelled_contents(spark, sf_dir):
    """Images whose content is not that of a labelled image: copies of labelled ones go too."""
    labelled = v.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("image"))
    seen_before = joins.lookup(v.document_images(spark, sf_dir), labelled, "image").select(F.md5("data").alias("digest"))
    return embedded.drop_seen(v.document_images(spark, sf_dir), seen_before).select("image")


@query
def seen_across_runs(spark, sf_dir):
    """Two runs of a stream of buffers: pages and labelled documents, then all documents. Each content comes once."""
    source, table, state = (new_folder(spark, n) for n in ("buffers", "unseen", "state"))
    labelled = v.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("image"))
    docs = v.document_images(spark, sf_dir)
    first = joins.lookup(docs, labelled, "image").unionByName(v.page_images(spark, sf_dir))
    for number, run in enumerate((first, docs)):
        run.select(F.col("image").cast("string").alias("image"), F.lit(0).cast("long").alias("offset"), "data").write.mode("append").parquet(source)
        seen.unseen_stream(spark, source, table, state, columns={"run": F.lit(number)}).awaitTermination()
    return spark.read.parquet(table).groupBy("run").agg(F.count("*").alias("buffers"), F.sum(F.length("data").cast("long")).alias("bytes"))


@query
def block_hash_table(spark, sf_dir):
    return _blocks(spark, sf_dir)


# ---- histograms

@query
def byte_histogram_total(spark, sf_dir):
    return histogram.histogram_total(histogram.byte_histogram(v.plain_slices(spark, sf_dir), by=()))


@query
def byte_histogram_by_image(spark, sf_dir):
    h = histogram.histogram_by_image(histogram.byte_histogram(v.plain_slices(spark, sf_dir)))
    return h.withColumn("image", F.coalesce(F.col("image").cast("string"), F.lit("all")))


@query
def byte_histogram_report(spark, sf_dir):
    h = histogram.histogram_total(histogram.byte_histogram(v.plain_slices(spark, sf_dir), by=()))
    return histogram.histogram_report(h)


@query
def byte_histogram_report_one_line(spark, sf_dir):
    h = histogram.histogram_total(histogram.byte_histogram(v.plain_slices(spark, sf_dir), by=()))
    return histogram.histogram_report(h, newline=False)


@query
def image_total_bytes(spark, sf_dir):
    return histogram.total_bytes(v.document_listing(spark, sf_dir))


@query
def read_only(spark, sf_dir):
    return histogram.read_only_pass(v.plain_slices(spark, sf_dir))


@query
def slice_count(spark, sf_dir):
    return sinks.row_count(v.plain_slices(spark, sf_dir))


# ---- sink lines and keyed tables

@query
def feature_tsv(spark, sf_dir):
    return sinks.feature_lines(scanners.scan_email(v.slices(spark, sf_dir)))


@query
def artifact_report_lines(spark, sf_dir):
    found = scanners.scan_email(v.slices(spark, sf_dir))
    rows = found.select(F.lit("email").alias("artifact_class"), "image", F.col("offset").alias("path"), "feature", "context")
    return sinks.artifact_lines(rows)


@query
def cells_address_to_image(spark, sf_dir):
    return cell.cells_email_to_image(scanners.scan_email(v.slices(spark, sf_dir)))


@query
def cells_image_to_address(spark, sf_dir):
    c = cell.cells_image_to_email(scanners.scan_email(v.slices(spark, sf_dir)))
    return c.withColumn("value", _text_hex("value"))


@query
def cells_media_to_block(spark, sf_dir):
    return cell.cells_media_to_block(_blocks(spark, sf_dir), k=4096)


@query
def cells_block_to_media(spark, sf_dir):
    return cell.cells_block_to_media(_blocks(spark, sf_dir))


@query
def cells_artifacts(spark, sf_dir):
    return cell.cells_artifacts_by_image(scanners.scan_email(v.slices(spark, sf_dir)))


@query
def artifacts_per_class(spark, sf_dir):
    a = scanners.to_artifacts(scanners.scan_email(v.slices(spark, sf_dir)), "email")
    return cell.rows_by_class(a).withColumn("artifact", F.hex("artifact"))


def _event_cells(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    return e.select(
        F.concat_ws(",", "event_type", F.col("user_id").cast("string")).alias("row_key"),
        F.lit("f").alias("family"),
        F.pmod(F.col("event_id"), F.lit(16)).cast("string").alias("qualifier"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("value"),
    )


@query
def cells_collapsed(spark, sf_dir):
    return cell.collapse(_event_cells(spark, sf_dir))


def _last_keys(spark, sf_dir):
    """Cells of the first order per customer and of the last event per user."""

    def cells(df, key, value):
        return df.select(
            F.col(key).cast("string").alias("row_key"), F.lit("f").alias("family"),
            F.lit("last").alias("qualifier"), F.col(value).cast("string").alias("value"),
        )

    orders = v.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("k"))
    events = v.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("k"))
    return cells(orders, "o_custkey", "k"), cells(events, "user_id", "k")


@query
def cells_upserted(spark, sf_dir):
    """User cells put over customer cells of the same keys."""
    return cell.upsert(*_last_keys(spark, sf_dir))


@query
def cells_filtered(spark, sf_dir):
    cells = cell.collapse(_event_cells(spark, sf_dir))
    return cell.row_filter(cells, eq={"family": "f"}, lt={"qualifier": "5"}, prefix={"row_key": "view,"})


# ---- tables written and read back, in the shared folder

@query
def feature_text_files(spark, sf_dir):
    path = new_folder(spark, "features")
    sinks.write_features(scanners.scan_email(v.media_slices(spark, sf_dir)), path)
    return spark.read.schema("value string, image string").text(path).select("image", F.col("value").alias("line"))


@query
def feature_append_files(spark, sf_dir):
    """Two runs of the scan appended to one target: documents, then pages."""
    path = new_folder(spark, "appended")
    sinks.write_append(scanners.scan_email(v.media_slices(spark, sf_dir)), path, first=True)
    pages = files.chunk(v.page_images(spark, sf_dir), "image", "data", v.SLICE, 1024)
    sinks.write_append(scanners.scan_email(pages), path)
    lines = spark.read.schema("value string, image string").text(path).select("image", F.split("value", "\t").alias("p"))
    return lines.select("image", F.get("p", F.lit(0)).alias("offset"), F.get("p", F.lit(1)).alias("feature"))


@query
def slice_table(spark, sf_dir):
    """Media of labelled documents are stored first; the second run adds only the others."""
    path = new_folder(spark, "slices")
    s = v.media_slices(spark, sf_dir).select("image", "offset", "data")
    labelled = v.table(spark, sf_dir, "labels").select("doc_id")
    media = v.table(spark, sf_dir, "documents").join(labelled, "doc_id", "left_semi")
    some = media.groupBy(F.col("source").alias("image")).agg(F.count("*").alias("n")).where("n > 1")
    sinks.write_slices(joins.lookup(s, some, "image"), path)
    sinks.write_slices(s, path, tables.read_slices(spark, path).select("image").distinct())
    return tables.read_slices(spark, path).select("image", "offset", F.md5("data").alias("md5"))


@query
def slice_table_resumed(spark, sf_dir):
    """A slice table that holds one slice of three of some images is completed: every slice once, of every image."""
    path, out = v.raw_document_files(spark, sf_dir), new_folder(spark, "slices")
    part = files.read_raw(spark, path, sliceBytes=v.SLICE, overlap=1024, exclude=v.MARKS).drop("error")
    held = part.where((F.col("offset") % (3 * v.SLICE) == 0) & v.source_of().startswith("src1"))
    sinks.write_slices(held, out)
    lifecycle.complete_slices(spark, path, out, size=v.SLICE, exclude=v.MARKS)
    s = tables.read_slices(spark, out).select("image", "offset", F.length("data").cast("long").alias("length"))
    listing = files.list_images(spark, path, v.MARKS)
    whole = sinks.complete_images(s, listing, v.SLICE).select("image", F.lit(1).alias("whole"))
    by_image = s.groupBy("image").agg(F.sum("length").alias("bytes"), (F.count("*") - F.count_distinct("offset")).alias("twice"))
    both = listing.where("length > 0").join(by_image, "image", "left").join(whole, "image", "left")
    return both.groupBy(v.source_of().alias("source")).agg(
        F.sum("bytes").alias("bytes"), F.sum("twice").alias("twice"), F.count_if(F.col("whole").isNull()).alias("open")
    )


@query
def artifact_table(spark, sf_dir):
    path = new_folder(spark, "artifacts")
    found = scanners.scan(v.media_slices(spark, sf_dir), {"email": None, "number": "[0-9]{4,}"})
    sinks.write_artifacts(scanners.to_artifacts(found), path)
    return tables.read_artifacts(spark, path).groupBy("artifact_class", "stream_name").agg(F.count("*").alias("n"))


@query
def keyed_table(spark, sf_dir):
    """Puts of two jobs, the second one repeated; a third put comes to nothing when it is repeated."""
    path = new_folder(spark, "cells")
    old, new = _last_keys(spark, sf_dir)
    cell.keyed_put(old, path, 0)
    cell.keyed_put(new, path, 1, put="users")
    cell.keyed_put(new, path, 1, put="users")
    cell.keyed_put(old, path, 2, put="retried")
    cell.keyed_put(old.where("row_key is null"), path, 2, put="retried")
    return tables.scan_cells(spark, path, "f")


@query
def streamed_cells(spark, sf_dir):
    """Slice files that arrive in two folders, each taken in by a stream of its own into one table."""
    path = new_folder(spark, "streamed")
    pages = files.chunk(v.page_images(spark, sf_dir), "image", "data", v.SLICE, 1024)
    for arriving in (v.media_slices(spark, sf_dir), pages.withColumn("image", F.concat(F.lit("page"), F.col("image")))):
        src, state = new_folder(spark, "arriving"), new_folder(spark, "progress")
        arriving.select("image", "offset", "data", "before", "after").write.parquet(src)
        ingest.ingest_stream(spark, src, path, state).awaitTermination()
    return tables.scan_cells(spark, path)


@query
def compacted_table(spark, sf_dir):
    """The puts of `keyed_table` merged while the table is in use: a later put, a repeated one, old folders deleted."""
    path = new_folder(spark, "cells")
    old, new = _last_keys(spark, sf_dir)
    cell.keyed_put(old, path, 0)
    cell.keyed_put(old.withColumn("value", F.lit("none")), path, 1, put="users")
    compaction.compact_live(spark, path, 8)
    cell.keyed_put(old, path, 1, put="users")
    cell.keyed_put(new, path, 2)
    compaction.vacuum(spark, path)
    compaction.compact_live(spark, path, 8)
    return tables.scan_cells(spark, path, "f")


@query
def raw_streamed(spark, sf_dir):
    """Image files taken in as a stream, a third of their bytes at a time at most, by two runs with more files at the second."""
    path, table, state = v.raw_document_files(spark, sf_dir), new_folder(spark, "streamed"), new_folder(spark, "progress")
    total = files.list_images(spark, path, v.MARKS).agg(F.sum("length")).collect()[0][0] or 3
    options = {"exclude": v.MARKS, "trigger_bytes": total // 3 + 1, "compact_every": 2}
    ingest.ingest_raw(spark, path, table, state, prefix=f"{files.image_name(path)}/source=src1", **options)
    ingest.ingest_raw(spark, path, table, state, **options)
    cells = tables.scan_cells(spark, table).withColumn("source", v.source_of("qualifier"))
    return cells.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("row_key").alias("addresses"))


# ---- aggregations

@query
def artifact_frequency(spark, sf_dir):
    return art.artifact_histogram(v.words(spark, sf_dir))


@query
def artifact_image_counts(spark, sf_dir):
    return art.artifact_by_image(v.words(spark, sf_dir))


@query
def address_image_counts(spark, sf_dir):
    found = scanners.scan_email(v.slices(spark, sf_dir))
    return art.artifact_by_image(found.select("image", F.col("feature").alias("artifact")))


@query
def inverted_index(spark, sf_dir):
    i = art.inverted_index(v.event_artifacts(spark, sf_dir), width=4096)
    return i.select("artifact", "image", "part", F.array_join("offsets", ",").alias("offsets"))


@query
def tfidf(spark, sf_dir):
    t = art.tfidf(v.words(spark, sf_dir))
    return t.withColumn("tfidf", F.round("tfidf", 6))


@query
def hash_sub_counts(spark, sf_dir):
    d = v.text_table(spark, sf_dir, "documents").select("source", F.encode("text", "UTF-8").alias("data"))
    s = files.chunk(d, "source", "data", v.SLICE).withColumnRenamed("image", "source")
    return hashes.hash_counts(hashes.block_hashes(s), "source", clip=3)


@query
def hash_totals(spark, sf_dir):
    return hashes.hash_totals(_blocks(spark, sf_dir))


@query
def slowest_slices(spark, sf_dir):
    e = v.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("image"), F.col("event_id").alias("offset"), F.col("value").alias("cost")
    )
    return art.slowest_slice(e)


def _count_tables(spark, sf_dir):
    old = v.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"))
    new = v.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n"))
    return old, new


@query
def counts_inserted(spark, sf_dir):
    return art.apply_counts(*_count_tables(spark, sf_dir), mode="insert")


@query
def counts_merged(spark, sf_dir):
    return art.apply_counts(*_count_tables(spark, sf_dir), mode="merge")


# ---- joins and lookups

@query
def image_overlap(spark, sf_dir):
    return similarity.overlap_summary(_tokens(spark, sf_dir))


@query
def image_similarity(spark, sf_dir):
    """Each labelled image against all images."""
    seeds = v.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("image"))
    pairs = similarity.similarity_to(_tokens(spark, sf_dir), seeds)
    return pairs.withColumn("jaccard", F.round("jaccard", 6)).withColumn("containment", F.round("containment", 6))


@query
def similar_image_pairs(spark, sf_dir):
    pairs = similarity.similar_pairs(_tokens(spark, sf_dir), 0.3)
    return pairs.select("image_a", "image_b", "shared", F.round("jaccard", 6).alias("jaccard"))


@query
def image_cosine_pairs(spark, sf_dir):
    """All images compared by their words, rare ones weighing most; copies are pairs too."""
    weights = art.tfidf(v.words(spark, sf_dir)).select("image", F.col("artifact").alias("token"), F.col("tfidf").alias("weight"))
    pairs = similarity.cosine_pairs(weights, 0.5, copies=True)
    return pairs.select("image_a", "image_b", F.round("cosine", 6).alias("cosine"))


@query
def block_runs(spark, sf_dir):
    """Stretches of blocks that each image shares with the first image that has them."""
    return similarity.block_runs(_blocks(spark, sf_dir), width=8192)


@query
def hot_block_hashes(spark, sf_dir):
    return similarity.hot_hashes(_blocks(spark, sf_dir), 20)


@query
def filtered_block_lookup(spark, sf_dir):
    """Blocks of all images looked up among those of the images marked as toxic, through a Bloom filter."""
    marked = v.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("image"))
    totals = hashes.hash_totals(joins.lookup(_blocks(spark, sf_dir), marked, "image")).select("block_md5", "total")
    path = new_folder(spark, "bloom")
    membership.bloom_filter(totals, "block_md5").save(path)
    return membership.filtered_lookup(_blocks(spark, sf_dir), totals, "block_md5", membership.load_bloom(spark, path))


@query
def image_copy_groups(spark, sf_dir):
    return similarity.copy_groups(_tokens(spark, sf_dir))


@query
def shared_artifacts(spark, sf_dir):
    return art.shared_artifacts(v.words(spark, sf_dir))


@query
def artifact_similarity(spark, sf_dir):
    """Labelled users' images compared by the addresses and words they share."""
    words = v.words(spark, sf_dir).select("image", F.col("artifact").alias("token")).distinct()
    seeds = v.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("image"))
    return similarity.similarity_to(words, seeds).select("image_a", "image_b", "shared")


@query
def near_artifacts(spark, sf_dir):
    return art.near_artifacts(v.event_artifacts(spark, sf_dir), NEAR)


@query
def adjacent_artifacts(spark, sf_dir):
    a = art.adjacent_artifacts(v.event_artifacts(spark, sf_dir), width=4096)
    for side in ("prev_offset", "next_offset"):
        a = a.withColumn(side, F.coalesce(side, F.lit(-1)))
    return a


@query
def related_media(spark, sf_dir):
    fa = v.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("artifact"))
    mf = v.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("media"), F.col("o_orderkey").alias("file"))
    return art.related_media(fa, mf, SEED_FILE)


@query
def media_hops(spark, sf_dir):
    """Media within two hops of the first file of each kind."""
    fa = v.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("artifact"))
    orders = v.table(spark, sf_dir, "orders")
    mf = orders.select(F.col("o_custkey").alias("media"), F.col("o_orderkey").alias("file"))
    seeds = orders.groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("file"))
    return art.media_within(fa, mf, seeds, 2)


@query
def block_lookup(spark, sf_dir):
    """All places of the blocks that the images marked as toxic consist of."""
    marked = v.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("image"))
    keys = joins.lookup(_blocks(spark, sf_dir), marked, "image").select("block_md5")
    return joins.lookup(_blocks(spark, sf_dir), keys, "block_md5")


@query
def address_lookup(spark, sf_dir):
    return joins.lookup(v.words(spark, sf_dir), [ADDRESS_WORD], "artifact")


@query
def prefiltered_hashes(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    full = hashes.hash_totals(b).select("block_md5", "total")
    return similarity.prefiltered_lookup(b, similarity.hot_hashes(b, 50), full)


@query
def not_ingested_images(spark, sf_dir):
    done = v.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("image"))
    return joins.not_ingested(v.document_listing(spark, sf_dir), done)


@query
def neighbour_blocks(spark, sf_dir):
    return similarity.neighbour_blocks(_blocks(spark, sf_dir))


@query
def top_images(spark, sf_dir):
    return art.top_images(v.words(spark, sf_dir), ADDRESS_WORD, 10)


@query
def top_images_by_address(spark, sf_dir):
    """All addresses of the documents, and for the most frequent one its top ten images."""
    found = scanners.scan_email(v.slices(spark, sf_dir))
    a = found.select("image", F.col("feature").alias("artifact"))
    counts = art.artifact_histogram(a)
    best = counts.orderBy(F.desc("n"), "artifact").limit(1).select("artifact").scalar()
    return art.top_images(a, best, 10)


# ---- throughput

@query
def log_counters(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    name = F.when(F.col("event_type") == "view", "flex_bytes_considered: ").otherwise("flex_bytes_accepted: ")
    lines = e.select(F.concat(name, F.round(F.col("value") * 100).cast("long").cast("string")).alias("value"))
    return throughput.log_counters(lines, ["flex_bytes_considered: ", "flex_bytes_accepted: "])


def _buckets(spark, sf_dir):
    return throughput.throughput(logs.parse_log(v.executor_lines(spark, sf_dir), "executor"), BUCKET)


@query
def throughput_series(spark, sf_dir):
    b = throughput.order_buckets(_buckets(spark, sf_dir))
    return b.select(
        "bucket", "started", "finished",
        F.round("started_gb_s", 6).alias("started_gb_s"), F.round("finished_gb_s", 6).alias("finished_gb_s"),
    )


@query
def throughput_cumulative(spark, sf_dir):
    c = throughput.cumulative_throughput(_buckets(spark, sf_dir))
    return c.select("bucket", F.round("started_gb", 4).alias("started_gb"), F.round("finished_gb", 4).alias("finished_gb"))


@query
def bytes_cumulative(spark, sf_dir):
    return throughput.cumulative_bytes(logs.parse_log(v.progress_lines(spark, sf_dir), "progress"))


@query
def resharded(spark, sf_dir):
    """Rewritten into 16 files and read back: how many files there are, and the rows of each artifact."""
    path = new_folder(spark, "resharded")
    sinks.reshard(v.event_artifacts(spark, sf_dir), 16).write.parquet(path)
    stored = spark.read.parquet(path).withColumn("file", F.input_file_name())
    names = stored.select("file").distinct().agg(F.count("*")).scalar()
    return stored.groupBy("artifact").agg(F.count("*").alias("n"), F.sum("offset").alias("offsets")).withColumn("files", names)


@query
def saved_artifacts(spark, sf_dir):
    """The artifact table in the catalog, partitioned by class."""
    name = f"artifacts_{uuid.uuid4().hex}"
    found = scanners.scan_email(v.media_slices(spark, sf_dir))
    sinks.save_artifacts(scanners.to_artifacts(found, "email"), name)
    return spark.table(name).groupBy("artifact_class", "stream_name").agg(F.count("*").alias("n"))


@query
def slice_table_names(spark, sf_dir):
    """Image names that look like numbers come back as they were: 0012 is not 12."""
    path = new_folder(spark, "slices")
    s = v.plain_slices(spark, sf_dir).withColumn("last", F.pmod("image", F.lit(100)).cast("string"))
    names = F.explode(F.array("last", F.lpad("last", 4, "0")))
    s = s.select(names.alias("image"), "offset", "data")
    sinks.write_slices(s, path)
    return tables.read_slices(spark, path).groupBy("image").agg(F.sum(F.length("data").cast("long")).alias("bytes"))
