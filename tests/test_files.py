"""Raw files in, tables out and back."""

import os
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from slicewise import session
from slicewise.operators import cells, sinks
from slicewise.operators.scanners import scan_email, to_artifacts
from slicewise.plans import lifecycle
from slicewise.sources import files, tables
from slicewise.sources.rawimage import ByteRange, RawImageReader, pack
from slicewise.streaming.ingest import ingest_stream


@pytest.fixture
def image_dir(tmp_path):
    folder = tmp_path / "images"
    (folder / "deep").mkdir(parents=True)
    data = {
        "a.raw": b"x" * 990 + b" first@example.com " + bytes(3000),
        "deep/b.raw": os.urandom(2500) + b" second@example.org " + b"y" * 10,
        "empty.raw": b"",
    }
    for name, content in data.items():
        (folder / name).write_bytes(content)
    return str(folder), data


def stems(df):
    return df.withColumn("image", F.element_at(F.split("image", "/"), -1))


def test_raw_slices_cover_files(spark, image_dir):
    path, data = image_dir
    for size, split, overlap in ((1000, 1, 0), (1000, 2500, 100), (65536, 1 << 27, 16)):
        s = files.read_raw(spark, path, sliceBytes=size, splitBytes=split, overlap=overlap)
        found = stems(s).orderBy("image", "offset").collect()
        for name, content in data.items():
            mine = [r for r in found if r.image == os.path.basename(name)]
            assert b"".join(bytes(r.data) for r in mine) == content
            assert [r.offset for r in mine] == list(range(0, len(content), size))
            for r in mine:
                end = r.offset + len(r.data)
                assert bytes(r.before) == content[max(0, r.offset - overlap) : r.offset]
                assert bytes(r.after) == content[end : end + overlap]
                assert r.error is None


def test_raw_scan_sees_matches_over_slices(spark, image_dir):
    path, _ = image_dir
    s = files.read_raw(spark, path, sliceBytes=1000, splitBytes=1000, overlap=600)
    assert rows(stems(scan_email(s)).select("image", "offset", "feature")) == [
        ("a.raw", 991, "first@example.com"),
        ("b.raw", 2501, "second@example.org"),
    ]


def test_unreadable_ranges(spark, image_dir):
    path, _ = image_dir
    missing = ByteRange(path, path + "/gone.raw", 0, 1000, 1000)
    tolerant = RawImageReader({"path": path, "onerror": "skip"})
    batches = list(tolerant.read_range(missing))
    assert batches[0].num_rows == 1 and batches[0]["error"][0].as_py()
    with pytest.raises(OSError):
        list(RawImageReader({"path": path}).read_range(missing))
    short = ByteRange(path, path + "/a.raw", 0, 9000, 9000)
    assert list(tolerant.read_range(short))[-1]["error"][0].as_py().startswith("short read")
    with pytest.raises(ValueError):
        RawImageReader({})


def test_small_files_share_a_task():
    ranges = [ByteRange("", str(i), 0, 1000, 1000) for i in range(100)] + [ByteRange("", "big", 0, 1 << 20, 1 << 20)]
    tasks = pack(ranges, 1 << 20)
    assert [r for t in tasks for r in t.ranges] == ranges
    assert len(tasks) < 10 and len(tasks[-1].ranges) == 1
    assert pack([], 10) == []


def test_listing_and_whole_files(spark, image_dir):
    path, data = image_dir
    sizes = sorted((os.path.basename(n), len(c)) for n, c in data.items())
    assert rows(stems(files.list_images(spark, path))) == sizes
    names = files.list_images(spark, path).where("length > 0").select("image")
    assert rows(names) == rows(files.read_raw(spark, path).select("image").distinct())
    whole = {r.image: bytes(r.data) for r in stems(files.whole_files(spark, path)).collect()}
    assert whole == {os.path.basename(n): c for n, c in data.items() if c}


def test_lifecycle(spark, image_dir, tmp_path):
    path, data = image_dir
    out = str(tmp_path / "features")
    lifecycle.features_of_images(spark, path, out)
    lines = spark.read.text(out).select("value").orderBy("value").collect()
    assert lines[0].value.startswith("2501\tsecond@example.org\t") and lines[1].value.startswith("991\tfirst@example.com\t")
    with pytest.raises(Exception):
        lifecycle.features_of_images(spark, path, out)
    report = lifecycle.histogram_of_images(spark, path).collect()[0].report
    assert report.endswith(f"total: {sum(map(len, data.values()))}")
    art = str(tmp_path / "artifacts")
    lifecycle.artifacts_of_images(spark, path, art, {"email": None, "digits": "[0-9]{9,}"})
    stored = tables.read_artifacts(spark, art)
    assert rows(stored.where("artifact_class = 'email'").select(F.decode("artifact", "UTF-8"))) == [
        ("first@example.com",),
        ("second@example.org",),
    ]
    lifecycle.block_tables(spark, path, *(str(tmp_path / n) for n in ("h", "m", "b")))
    hashes = spark.read.parquet(str(tmp_path / "h"))
    assert hashes.count() == sum(len(c) // 512 for c in data.values())
    assert tables.scan_cells(spark, str(tmp_path / "m"), "f").count() == hashes.count()
    assert tables.scan_cells(spark, str(tmp_path / "b"), "g").count() == 0


def test_slice_table_skips_what_is_stored(spark, image_dir, tmp_path):
    path, data = image_dir
    out = str(tmp_path / "slices")
    lifecycle.slices_of_images(spark, path, out)
    stored = tables.read_slices(spark, out)
    done = stored.select("image").distinct()
    lifecycle.slices_of_images(spark, path, out, done)
    again = tables.read_slices(spark, out)
    assert again.agg(F.sum(F.length("data"))).collect()[0][0] == sum(map(len, data.values()))
    assert again.where("error is not null").count() == 0 if "error" in again.columns else True


def cell_frame(spark, *values):
    return spark.createDataFrame(list(values), "row_key string, family string, qualifier string, value string")


def test_keyed_put(spark, tmp_path):
    table = str(tmp_path / "cells")
    first = cell_frame(spark, ("r1", "f", "a", "1"), ("r2", "f", "a", "2"), ("r1", "g", "a", "x"))
    cells.keyed_put(first, table, 0, put="first")
    cells.keyed_put(first, table, 0, put="first")
    assert spark.read.parquet(table).count() == 3
    cells.keyed_put(cell_frame(spark, ("r1", "f", "a", "0"), ("r3", "f", "b", "3")), table, 1)
    expected = [("r1", "f", "a", "0"), ("r2", "f", "a", "2"), ("r3", "f", "b", "3")]
    assert rows(tables.scan_cells(spark, table, "f")) == expected
    cells.keyed_put(first, table, 0, put="first")
    assert rows(tables.scan_cells(spark, table, "f")) == expected
    compacted = str(tmp_path / "compacted")
    cells.compact(spark.read.parquet(table), compacted, 2)
    assert spark.read.parquet(compacted).count() == 4
    assert rows(tables.scan_cells(spark, compacted, "f")) == expected


def test_puts_of_different_jobs_add_up(spark, tmp_path):
    table = str(tmp_path / "cells")
    cells.keyed_put(cell_frame(spark, ("r1", "f", "a", "1")), table)
    cells.keyed_put(cell_frame(spark, ("r2", "f", "a", "2")), table)
    assert rows(tables.scan_cells(spark, table)) == [("r1", "f", "a", "1"), ("r2", "f", "a", "2")]
    cells.keyed_put(cell_frame(spark, ("r3", "f", "a", "3")), table, put="retried")
    cells.keyed_put(cell_frame(spark, ("r3", "f", "a", "3")).where("value = '4'"), table, put="retried")
    assert [r[0] for r in rows(tables.scan_cells(spark, table))] == ["r1", "r2"]


def test_block_jobs_add_to_the_same_tables(spark, tmp_path):
    from slicewise.plans.lifecycle import block_tables

    for name in ("a", "b"):
        (tmp_path / f"{name}.raw").write_bytes(name.encode() * 1024)
        block_tables(spark, str(tmp_path / f"{name}.raw"), str(tmp_path / f"h{name}"), str(tmp_path / "m"), str(tmp_path / "t"))
    assert tables.scan_cells(spark, str(tmp_path / "t")).count() == 4


def test_no_file_is_left_out_unless_asked_for(spark, tmp_path):
    (tmp_path / ".hid").mkdir()
    for name in ("x.raw", "_sys.dd", ".hid/z.raw"):
        (tmp_path / name).write_bytes(b"data")
    assert files.list_images(spark, str(tmp_path)).count() == 3
    assert files.read_raw(spark, str(tmp_path)).count() == 3 == files.whole_files(spark, str(tmp_path)).count()
    names = rows(files.list_images(spark, str(tmp_path), exclude="_*;.*"))
    assert [n.rsplit("/", 1)[-1] for n, _ in names] == ["x.raw"]
    assert rows(files.whole_files(spark, str(tmp_path), exclude="_*;.*").select("image", "length")) == names


def test_image_names_come_back_as_text(spark, tmp_path):
    path = str(tmp_path / "slices")
    s = spark.createDataFrame([("0012", 0, bytearray(b"a")), ("12", 0, bytearray(b"b"))], "image string, offset long, data binary")
    sinks.write_slices(s, path)
    assert sorted(r.image for r in tables.read_slices(spark, path).collect()) == ["0012", "12"]


def test_malformed_log_lines_are_left_out(spark):
    from slicewise.sources import logs

    lines = ["2020-01-01 01-02-03.tsv 17", "2020-01-01 xx-02-03.tsv 17", "2020-01-01 01-02-03.tsv many"]
    found = logs.parse_log(spark.createDataFrame([(x,) for x in lines], "value string"), "progress")
    assert [r.bytes for r in found.collect()] == [17]


def test_bucketed_table(spark):
    cells.save_bucketed(cell_frame(spark, ("r1", "f", "a", "1")), "bucketed_cells", 2)
    assert rows(spark.table("bucketed_cells")) == [("r1", "f", "a", "1")]
    spark.sql("DROP TABLE bucketed_cells")


def test_literal_rows(spark):
    lines = spark.createDataFrame([(f"{i},f,a,{i}",) for i in range(1, 6)], "line string")
    assert rows(tables.parse_cells(lines, "line")) == [(str(i), "f", "a", str(i)) for i in range(1, 6)]


def test_row_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "c")
    cell_frame(spark, ("a1", "f", "q", "v"), ("b1", "f", "q", "w")).write.parquet(path)
    found = cells.row_filter(spark.read.parquet(path), eq={"family": "f"}, prefix={"row_key": "a"})
    assert rows(found) == [("a1", "f", "q", "v")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(row_key,a)" in plan and "EqualTo(family,f)" in plan


def test_append_sink(spark, tmp_path):
    path = str(tmp_path / "out")
    f = spark.createDataFrame([("i", 1, "a\tb", "c")], "image string, offset long, feature string, context string")
    sinks.write_append(f, path, first=True)
    sinks.write_append(f, path)
    assert rows(spark.read.text(path)) == [("1\ta\\x09b\tc", "i")] * 2
    with pytest.raises(Exception):
        sinks.write_append(f, path, first=True)


def test_saved_artifact_table(spark, images):
    found = to_artifacts(scan_email(files.chunk(images({"a": b"ab@c.com "}), "image", "data")), "email")
    sinks.save_artifacts(found, "artifact_table")
    assert spark.table("artifact_table").count() == 1
    spark.sql("DROP TABLE artifact_table")


def test_reshard_keeps_rows(spark):
    df = spark.range(1000)
    again = sinks.reshard(df, 7)
    assert rows(again) == rows(df)
    assert again.select(F.spark_partition_id().alias("p")).distinct().count() == 7


def test_stream_takes_each_file_once(spark, tmp_path):
    src, table, checkpoint = (str(tmp_path / n) for n in ("src", "table", "checkpoint"))

    def add(name, content):
        df = spark.createDataFrame([(name, 0, bytearray(content), bytearray(), bytearray())],
                                   "image string, offset long, data binary, before binary, after binary")
        df.coalesce(1).write.mode("append").parquet(src)

    add("one", b"ab@c.com ")
    ingest_stream(spark, src, table, checkpoint).awaitTermination()
    add("two", b"..ab@c.com xy@z.org ")
    ingest_stream(spark, src, table, checkpoint).awaitTermination()
    ingest_stream(spark, src, table, checkpoint).awaitTermination()
    assert spark.read.parquet(table).count() == 3
    assert rows(tables.scan_cells(spark, table).select("row_key", "qualifier")) == [
        ("ab@c.com", "one,0"),
        ("ab@c.com", "two,2"),
        ("xy@z.org", "two,11"),
    ]


def test_stored_rows_leave_no_shuffle_files(spark):
    """What shuffles wrote for a stored table is gone soon after, and the setting is as it was."""

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if "/shuffle_" in f}

    before, setting = shuffled(), spark.conf.get(session.RELEASE, None)
    counts = session.stored(spark.range(50000).groupBy((F.col("id") % 999).alias("k")).agg(F.count("*").alias("n")), "counts")
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get(session.RELEASE, None) == setting
    assert counts.count() == 999 and counts.agg(F.sum("n")).collect()[0][0] == 50000
