"""`rawstream`: raw images as a stream, each byte of each file taken in once.

    RawStreamSource.register(spark)
    spark.readStream.format("rawstream").option("path", p).option("log", folder).load()

Options
    path, sliceBytes, overlap, splitBytes, exclude, prefix   as for `rawimage`
    log           folder of the shared store in which the source keeps what it has taken in
    triggerBytes  most bytes taken in by one micro-batch, default 64 GiB, rounded up to whole slices

An offset is the number of entries in the log and the position in the file that the last entry ends in. An entry holds
the byte ranges of one admission, a row for each file; it is written under its final name in one move, before Spark
hears of its offset. So a restart finds the same ranges for the same offsets, and goes on in the middle of a file where
the one before stopped. Files are taken in by name, those that arrive later too, whatever their names.

A file must appear whole (moved into place): its length is fixed when it is first listed, and what is appended to it
later is not read; a file that got shorter is an error. Empty files have no slices. The driver holds the name and length
of each file, as Spark's own file source does; bytes are only read by tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .rawimage import ByteRange, RawImageReader, find_files, open_filesystem, pack

TRIGGER_BYTES = 64 << 30


class AdmissionLog:
    """Entries 1, 2, ... of ranges (root, image, start, stop, length), one file each."""

    def __init__(self, folder: str):
        self.filesystem, self.folder = open_filesystem(folder)
        self.filesystem.create_dir(self.folder, recursive=True)

    def _file(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def last(self) -> int:
        from pyarrow import fs

        listed = self.filesystem.get_file_info(fs.FileSelector(self.folder))
        return max((int(f.base_name[:-5]) for f in listed if f.base_name.endswith(".json")), default=0)

    def read(self, number: int) -> list[ByteRange]:
        with self.filesystem.open_input_stream(self._file(number)) as f:
            return [ByteRange(*r) for r in json.loads(f.read())]

    def append(self, number: int, ranges: list[ByteRange]) -> None:
        rows = [[r.root, r.image, r.start, r.stop, r.length] for r in ranges]
        written = f"{self.folder}/{number:012d}.new"
        with self.filesystem.open_output_stream(written) as f:
            f.write(json.dumps(rows).encode())
        self.filesystem.move(written, self._file(number))


class RawStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        if not options.get("log"):
            raise ValueError("rawstream needs a log folder")
        self.images = RawImageReader({k: v for k, v in options.items() if k not in ("from", "to", "onerror")})
        self.trigger_bytes = int(options.get("triggerbytes", TRIGGER_BYTES))
        if self.trigger_bytes <= 0:
            raise ValueError("triggerBytes > 0 is required")
        self.log_folder = options["log"]
        self.entries: int | None = None
        #: how far each file is taken in, and its length
        self.taken: dict[str, tuple[int, int]] = {}
        self.position = 0

    def _note(self, ranges: list[ByteRange]) -> None:
        for r in ranges:
            self.taken[r.image] = (r.stop, r.length)
            self.position = r.stop

    def _resume(self, log: AdmissionLog) -> None:
        """Read the log once for each reader."""
        if self.entries is None:
            self.entries = log.last()
            for number in range(1, self.entries + 1):
                self._note(log.read(number))

    def admit(self) -> list[ByteRange]:
        """The next ranges: the rest of files begun, then new files by name, up to the bytes of a trigger."""
        width = self.images.slice_bytes
        room = -(-self.trigger_bytes // width) * width
        listed = [(root, *f) for root in self.images.paths for f in find_files(root, self.images.exclude)]
        files = [(self.taken.get(image, (0, size)), root, image) for root, image, size in listed if self.images.wanted(image)]
        opened = sorted((not done, image, root, done, size) for (done, size), root, image in files if done < size)
        ranges = []
        for _, image, root, done, size in opened:
            if room <= 0:
                break
            stop = min(size, done + room)
            ranges.append(ByteRange(root, image, done, stop, size))
            room -= -(-(stop - done) // width) * width
        return ranges

    def initialOffset(self) -> dict:
        return {"entries": 0, "position": 0}

    def latestOffset(self) -> dict:
        log = AdmissionLog(self.log_folder)
        self._resume(log)
        ranges = self.admit()
        if ranges:
            log.append(self.entries + 1, ranges)
            self.entries += 1
            self._note(ranges)
        return {"entries": self.entries, "position": self.position}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        log = AdmissionLog(self.log_folder)
        step = max(1, self.images.split_bytes // self.images.slice_bytes) * self.images.slice_bytes
        ranges = [
            ByteRange(r.root, r.image, low, min(low + step, r.stop), r.length)
            for number in range(start["entries"] + 1, end["entries"] + 1)
            for r in log.read(number)
            for low in range(r.start, r.stop, step)
        ]
        return pack(ranges, step)

    def read(self, partition: InputPartition) -> Iterator:
        return self.images.read(partition)


class RawStreamSource(DataSource):
    """Slices of raw images as they arrive: (image, offset, data, before, after, error), `error` always null."""

    @classmethod
    def name(cls) -> str:
        return "rawstream"

    @classmethod
    def register(cls, spark: SparkSession) -> None:
        spark.dataSource.register(cls)

    def schema(self) -> str:
        return "image string, offset bigint, data binary, before binary, after binary, error string"

    def streamReader(self, schema) -> RawStreamReader:
        return RawStreamReader({k.lower(): v for k, v in self.options.items()})
