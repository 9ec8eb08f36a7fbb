"""Tables and images that grow: compaction of live tables, slice tables cut short, raw files as a stream."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from slicewise.operators import cells, compaction, sinks
from slicewise.plans import lifecycle
from slicewise.sources import files, tables
from slicewise.sources.rawstream import RawStreamReader, RawStreamSource
from slicewise.streaming.ingest import ingest_raw


def cell_frame(spark, *values):
    return spark.createDataFrame(list(values), "row_key string, family string, qualifier string, value string")


def put_names(spark, table):
    return {r.put for r in compaction.live_puts(spark, table).select("put").distinct().collect()}


def test_compaction_keeps_what_is_read_and_bounds_the_puts(spark, tmp_path):
    table, draw, expected = str(tmp_path / "cells"), random.Random(5), {}
    for batch in range(9):
        put = {f"r{draw.randrange(12)}": f"{batch}-{draw.random()}" for _ in range(6)}
        cells.keyed_put(cell_frame(spark, *[(k, "f", "a", v) for k, v in put.items()]), table, batch, put=f"p{batch}")
        expected |= put
        if batch % 3 == 2:
            before = len(put_names(spark, table))
            assert compaction.compact_live(spark, table, 2) == before
            assert len(put_names(spark, table)) == 1
        assert rows(tables.scan_cells(spark, table)) == sorted((k, "f", "a", v) for k, v in expected.items())
    assert compaction.compact_live(spark, table, 2) == 0
    assert len(compaction.vacuum(spark, table)) == 11 and compaction.vacuum(spark, table) == []
    assert rows(tables.scan_cells(spark, table)) == sorted((k, "f", "a", v) for k, v in expected.items())


def test_batches_and_names_decide_as_before_a_compaction(spark, tmp_path):
    table = str(tmp_path / "cells")
    cells.keyed_put(cell_frame(spark, ("r", "f", "a", "m")), table, 5, put="m")
    cells.keyed_put(cell_frame(spark, ("s", "f", "a", "m")), table, 5, put="n")
    compaction.compact_live(spark, table, 1)
    # an older batch loses, of equal batches the name that sorts last wins, not that of the compacted put
    cells.keyed_put(cell_frame(spark, ("r", "f", "a", "old")), table, 4, put="z")
    cells.keyed_put(cell_frame(spark, ("s", "f", "a", "lower")), table, 5, put="d")
    assert rows(tables.scan_cells(spark, table)) == [("r", "f", "a", "m"), ("s", "f", "a", "m")]
    cells.keyed_put(cell_frame(spark, ("s", "f", "a", "upper")), table, 5, put="o")
    assert rows(tables.scan_cells(spark, table)) == [("r", "f", "a", "m"), ("s", "f", "a", "upper")]


def test_a_put_repeated_after_its_merger_is_not_lost(spark, tmp_path):
    table = str(tmp_path / "cells")
    for name in ("a", "b"):
        cells.keyed_put(cell_frame(spark, (name, "f", "q", "1")), table, 0, put=name)
    compaction.compact_live(spark, table, 1)
    cells.keyed_put(cell_frame(spark, ("a", "f", "q", "2"), ("c", "f", "q", "3")), table, 0, put="a")
    compaction.vacuum(spark, table)
    assert rows(tables.scan_cells(spark, table)) == [("a", "f", "q", "2"), ("b", "f", "q", "1"), ("c", "f", "q", "3")]


def test_an_unfinished_compaction_changes_nothing(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "cells")
    for batch in range(3):
        cells.keyed_put(cell_frame(spark, (f"r{batch % 2}", "f", "q", str(batch))), table, batch)
    read = rows(tables.scan_cells(spark, table))
    with monkeypatch.context() as m:
        m.setattr(compaction, "ENTRIES", "no schema")
        with pytest.raises(Exception):
            compaction.compact_live(spark, table, 1)
    assert len(put_names(spark, table)) == 4 and rows(tables.scan_cells(spark, table)) == read
    compaction.compact_live(spark, table, 1)
    assert len(put_names(spark, table)) == 1 and rows(tables.scan_cells(spark, table)) == read


@pytest.fixture
def image_files(tmp_path):
    folder, draw = tmp_path / "images", random.Random(9)
    folder.mkdir()
    data = {f"{n}.raw": draw.randbytes(size) for n, size in (("a", 4096 * 5 + 17), ("b", 4096 * 3), ("c", 1), ("d", 0))}
    for name, content in data.items():
        (folder / name).write_bytes(content)
    return str(folder), data


def together(df, path):
    """The bytes of each image, put together from its slices; a slice that is there twice is an error."""
    found = {}
    for image, offset, data in df.select("image", "offset", "data").orderBy("image", "offset").collect():
        held = found.setdefault(image[len(path) + 1 :], bytearray())
        assert len(held) == offset
        held += data
    return {k: bytes(v) for k, v in found.items()}


def test_a_slice_table_cut_short_is_completed(spark, image_files, tmp_path):
    path, data = image_files
    out = str(tmp_path / "slices")
    whole = files.read_raw(spark, path, sliceBytes=4096, overlap=8).drop("error")
    sinks.write_slices(whole.where("image like '%a.raw' and offset in (4096, 12288)"), out)
    lifecycle.complete_slices(spark, path, out, size=4096, overlap=8)
    stored = tables.read_slices(spark, out)
    assert together(stored, path) == {k: v for k, v in data.items() if v}
    columns = ["image", "offset", "data", "before", "after"]
    assert rows(stored.select(*columns)) == rows(whole.select(*columns))
    lifecycle.complete_slices(spark, path, out, size=4096, overlap=8)
    assert tables.read_slices(spark, out).count() == stored.count() == 10
    fresh = str(tmp_path / "fresh")
    lifecycle.complete_slices(spark, path, fresh, size=4096)
    assert together(tables.read_slices(spark, fresh), path) == {k: v for k, v in data.items() if v}


def test_absent_slices_are_read_by_as_many_tasks_as_their_bytes_need(spark, image_files, tmp_path, monkeypatch):
    """The names of all absent slices fit one partition; what they stand for does not."""
    path, data = image_files
    monkeypatch.setattr(files, "TASK_BYTES", 4096, raising=False)
    none = spark.createDataFrame([], "image string, offset bigint")
    absent = files.read_absent(spark, path, none, size=512)
    assert absent.rdd.getNumPartitions() >= sum(map(len, data.values())) / 4096 > 4
    assert together(absent, path) == {k: v for k, v in data.items() if v}


def test_complete_images(spark):
    listing = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10), ("e", 0)], "image string, length long")
    held = [("a", o) for o in (0, 4, 8)] + [("b", 0), ("b", 4), ("b", 4)]
    stored = spark.createDataFrame(held, "image string, offset long")
    assert rows(sinks.complete_images(stored, listing, 4)) == [("a",), ("e",)]


def test_a_missing_path_is_a_row_only_if_errors_are_skipped(spark, image_files):
    path, data = image_files
    found = files.read_raw(spark, f"{path},{path}/gone", onError="skip")
    assert found.where("error is not null").select("image", "offset", "data").collect() == [(f"{path}/gone", 0, None)]
    assert found.where("error is null").count() == 3
    with pytest.raises(Exception):
        files.read_raw(spark, f"{path},{path}/gone").count()


def planned(reader, start, end):
    return sum(r.stop - r.start for task in reader.partitions(start, end) for r in task.ranges)


def test_admission_goes_on_in_the_middle_of_a_file(image_files, tmp_path):
    path, data = image_files
    options = {"path": path, "log": str(tmp_path / "log"), "slicebytes": "4096", "triggerbytes": "10000"}
    reader = RawStreamReader(options)
    zero = reader.initialOffset()
    first = reader.latestOffset()
    assert first == {"entries": 1, "position": 12288} and planned(reader, zero, first) == 12288
    # a new reader knows from the log where the one before stopped, and the same offsets give the same ranges
    again = RawStreamReader(options)
    assert planned(again, zero, first) == 12288
    second = again.latestOffset()
    assert planned(again, first, second) == 8209 and second == {"entries": 2, "position": 4096 * 5 + 17}
    (tmp_path / "images" / "0.raw").write_bytes(b"first by name, last to come")
    while (last := again.latestOffset()) != second:
        second = last
    assert planned(again, zero, last) == sum(map(len, data.values())) + 27
    assert again.latestOffset() == last and again.partitions(last, last) == []
    with pytest.raises(ValueError):
        RawStreamReader({"path": path})


def test_stream_of_raw_files(spark, image_files, tmp_path):
    path, data = image_files
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    RawStreamSource.register(spark)

    def run(stop_after=None):
        source = spark.readStream.format("rawstream").option("path", path).option("log", str(tmp_path / "log"))
        source = source.option("sliceBytes", 4096).option("triggerBytes", 8192).option("overlap", 4)

        def put(batch, number):
            if stop_after is not None and number >= stop_after:
                raise RuntimeError("stopped")
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        stream = source.load().writeStream.foreachBatch(put).option("checkpointLocation", state).start()
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()

    with pytest.raises(Exception):
        run(stop_after=2)
    (tmp_path / "images" / "A.raw").write_bytes(b"x" * 5000)
    run()
    run()
    stored = spark.read.parquet(out)
    assert together(stored, path) == {k: v for k, v in data.items() if v} | {"A.raw": b"x" * 5000}
    expected = files.read_raw(spark, path, sliceBytes=4096, overlap=4)
    assert rows(stored.drop("batch", "error")) == rows(expected.drop("error"))
    assert stored.groupBy("batch").agg(F.sum(F.length("data")).alias("n")).where("n > 8192").count() == 0


def test_raw_ingest_equals_a_scan_at_once(spark, tmp_path):
    folder, table, state = tmp_path / "images", str(tmp_path / "table"), str(tmp_path / "state")
    folder.mkdir()
    (folder / "m.raw").write_bytes(b"".join(b"user%d@example.com " % n for n in range(3000)))
    options = {"sliceBytes": 4096, "trigger_bytes": 16384, "compact_every": 2}
    ingest_raw(spark, str(folder), table, state, **options)
    (folder / "a.raw").write_bytes(b"late@example.org and user1@example.com ")
    ingest_raw(spark, str(folder), table, state, **options)
    found = rows(tables.scan_cells(spark, table).select("row_key"))
    assert len(found) == 3002 and len(set(found)) == 3001
    assert len(put_names(spark, table)) <= 3
