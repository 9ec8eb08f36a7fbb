"""`rawimage`: a Python data source that reads files as fixed-width byte slices.

    RawImageSource.register(spark)
    spark.read.format("rawimage").option("path", p).load()

Options
    path          file or directory (searched recursively); several paths joined by commas
    sliceBytes    width of a slice, default 65536
    overlap       bytes of the neighbouring slices kept in `before` and `after`, default 0
    splitBytes    most bytes read by one task, default 128 MiB, rounded to whole slices
    minTasks      tasks wanted at least; small inputs are cut finer for it (down to 1 MiB)
    exclude       patterns of file and folder names to leave out, joined by semicolons; default none
    prefix        beginning of the names of the files wanted
    from, to      first and last offset of the slices wanted
    onError       "fail" (default) or "skip": an unreadable range gives one row with `error` set, and so does a path
                  under which there is nothing

Ranges that are not wanted are never opened: options `prefix`, `from` and `to` give them. With `pushFilters` set to true,
in sessions with `spark.sql.python.filterPushdown.enabled`, filters on `image` (equality, `in`, beginning of the name) and
on `offset` (comparisons) do so too. Load anew for each such filter: Spark 4.1 keeps the reader of the last query on a
loaded DataFrame, with its filters, for the next query. So neither is set by this package.

Each task opens one file, seeks to its range and yields Arrow batches of a few MiB; nothing is read
on the driver but the directory listing. A path may be any URI that pyarrow's file systems know
(local, hdfs, s3, gs); the container must bring that file system's client library.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
)

SLICE_BYTES = 65536
SPLIT_BYTES = 128 << 20
SMALLEST_SPLIT = 1 << 20
#: what opening a file costs, in bytes that could be read instead; small files share a task
OPEN_COST = 1 << 16
BATCH_BYTES = 4 << 20


def open_filesystem(path: str):
    """(file system, path inside it) of a URI or a local path."""
    import os

    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
    return fs.LocalFileSystem(), os.path.abspath(path)


def find_files(root: str, exclude: str = "") -> list[tuple[str, int]]:
    """(path, size) of a file, or of all files below a folder.

    `exclude` holds patterns (as `_*;.*`) of names that are left out, of files and of folders.
    """
    from fnmatch import fnmatchcase

    from pyarrow import fs

    patterns = [p for p in exclude.split(";") if p]

    filesystem, inner = open_filesystem(root)
    info = filesystem.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    found = []
    for f in filesystem.get_file_info(fs.FileSelector(inner, recursive=True)):
        parts = f.path[len(inner) :].split("/")
        left_out = any(fnmatchcase(part, p) for part in parts for p in patterns)
        if f.type == fs.FileType.File and not left_out:
            found.append((f.path, f.size))
    return found


@dataclass
class ByteRange:
    root: str
    image: str
    start: int
    stop: int
    length: int


@dataclass
class ByteRanges(InputPartition):
    """What one task reads."""

    ranges: list[ByteRange]


def pack(ranges: list[ByteRange], size: int) -> list[InputPartition]:
    """Ranges in the order given, as many to a task as `size` bytes allow."""
    tasks: list[InputPartition] = []
    room = 0
    for r in ranges:
        cost = r.stop - r.start + OPEN_COST
        if cost > room or not tasks:
            tasks.append(ByteRanges([]))
            room = size + OPEN_COST
        tasks[-1].ranges.append(r)
        room -= cost
    return tasks


class RawImageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        if not self.paths:
            raise ValueError("rawimage needs a path")
        self.slice_bytes = int(options.get("slicebytes", SLICE_BYTES))
        self.overlap = int(options.get("overlap", 0))
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.min_tasks = int(options.get("mintasks", 1))
        self.exclude = options.get("exclude", "")
        self.on_error = options.get("onerror", "fail")
        if self.slice_bytes <= 0 or self.overlap < 0 or self.on_error not in ("fail", "skip"):
            raise ValueError("sliceBytes > 0, overlap >= 0 and onError fail|skip are required")
        self.names: set[str] | None = None
        self.prefixes: list[str] = [options["prefix"]] if options.get("prefix") else []
        #: first and last offset wanted
        self.low, self.high = int(options.get("from", 0)), int(options["to"]) if "to" in options else None

    def wanted(self, image: str) -> bool:
        return (self.names is None or image in self.names) and all(image.startswith(p) for p in self.prefixes)

    def bounds(self, size: int) -> tuple[int, int]:
        """First and end byte of the slices of a file whose offsets are wanted."""
        low = -(-self.low // self.slice_bytes) * self.slice_bytes
        high = size if self.high is None else min(size, (self.high // self.slice_bytes + 1) * self.slice_bytes)
        return low, high

    def partitions(self) -> list[InputPartition]:
        found, gone = [], []
        for root in self.paths:
            try:
                found += [(root, image, size) for image, size in find_files(root, self.exclude)]
            except FileNotFoundError:
                if self.on_error == "fail":
                    raise
                # a range without bytes, whose task tells of the error
                gone.append(ByteRange(root, open_filesystem(root)[1], 0, 0, 0))
        files = [f for f in found if self.wanted(f[1])]
        even = max(SMALLEST_SPLIT, sum(size for _, _, size in files) // self.min_tasks)
        step = max(1, min(self.split_bytes, even) // self.slice_bytes) * self.slice_bytes
        ranges = [
            ByteRange(root, image, start, min(start + step, high), size)
            for root, image, size in files
            for low, high in [self.bounds(size)]
            for start in range(low, high, step)
        ]
        return pack(gone + ranges, step)

    def read(self, partition: ByteRanges | None) -> Iterator:
        # without any partition Spark asks for the rows of None
        for byte_range in partition.ranges if partition else ():
            yield from self.read_range(byte_range)

    def read_range(self, partition: ByteRange) -> Iterator:
        import numpy as np
        import pyarrow as pa

        fields = {"image": pa.string(), "offset": pa.int64(), "data": pa.binary(), "before": pa.binary()}
        fields |= {"after": pa.binary(), "error": pa.string()}
        schema = pa.schema(list(fields.items()))
        position = partition.start
        try:
            filesystem, _ = open_filesystem(partition.root)
            with filesystem.open_input_file(partition.image) as f:
                per_read = max(1, BATCH_BYTES // self.slice_bytes) * self.slice_bytes
                while position < partition.stop:
                    stop = min(position + per_read, partition.stop)
                    low = max(0, position - self.overlap)
                    high = min(partition.length, stop + self.overlap)
                    f.seek(low)
                    buffer = f.read_buffer(high - low)
                    if buffer.size != high - low:
                        raise OSError(f"short read at {position} of {partition.image}")
                    starts = list(range(position, stop, self.slice_bytes))
                    edges = np.array([*starts, stop], dtype=np.int64) - position
                    # The slices lie side by side in the buffer, so they need no copy.
                    data = pa.Array.from_buffers(
                        pa.binary(),
                        len(starts),
                        [None, pa.py_buffer(edges.astype(np.int32)), buffer.slice(position - low, stop - position)],
                    )
                    view = memoryview(buffer)
                    ends = [*starts[1:], stop]
                    before = [bytes(view[max(0, o - low - self.overlap) : o - low]) for o in starts]
                    after = [bytes(view[o - low : o - low + self.overlap]) for o in ends]
                    n = len(starts)
                    columns = [pa.array([partition.image] * n), pa.array(starts, pa.int64()), data]
                    columns += [pa.array(before, pa.binary()), pa.array(after, pa.binary()), pa.nulls(n, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
                    position = stop
        except OSError as failure:
            if self.on_error == "fail":
                raise
            row = [partition.image, position, None, None, None, str(failure)]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, fields.values())], schema=schema)


class FilteringReader(RawImageReader):
    """A reader that takes over filters. Sessions that do not push filters refuse one that could."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on names are taken over whole, those on offsets narrow the ranges; the rest is left to Spark."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if self.on_error == "skip":
                yield f  # a row that tells of an error stands for a whole range
            elif column == ("image",) and isinstance(f, (EqualTo, In)):
                named = set(f.value) if isinstance(f, In) else {value}
                self.names = named if self.names is None else self.names & named
            elif column == ("image",) and isinstance(f, StringStartsWith):
                self.prefixes.append(value)
            elif column == ("offset",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    last = value - isinstance(f, LessThan)
                    self.high = last if self.high is None else min(self.high, last)
                if isinstance(f, EqualTo):
                    yield f  # a range begins at the slice that the offset is in
            else:
                yield f


class RawImageSource(DataSource):
    """Byte-range slices of raw images: (image, offset, data, before, after, error)."""

    @classmethod
    def name(cls) -> str:
        return "rawimage"

    @classmethod
    def register(cls, spark: SparkSession) -> None:
        spark.dataSource.register(cls)

    def schema(self) -> str:
        return "image string, offset bigint, data binary, before binary, after binary, error string"

    def reader(self, schema) -> RawImageReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (FilteringReader if options.get("pushfilters") == "true" else RawImageReader)(options)


@dataclass
class Folder(InputPartition):
    root: str
    exclude: str


class ImageListReader(DataSourceReader):
    def __init__(self, paths: str, exclude: str):
        self.paths = [p for p in paths.split(",") if p]
        self.exclude = exclude

    def partitions(self) -> list[InputPartition]:
        return [Folder(root, self.exclude) for root in self.paths]

    def read(self, partition: Folder) -> Iterator:
        yield from find_files(partition.root, partition.exclude)


class ImageListSource(DataSource):
    """Names and sizes of raw images, as `rawimage` names them, empty files included."""

    @classmethod
    def name(cls) -> str:
        return "imagelist"

    def schema(self) -> str:
        return "image string, length bigint"

    def reader(self, schema) -> ImageListReader:
        return ImageListReader(self.options.get("path", ""), self.options.get("exclude", ""))
