"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion into a sink that drops its rows. The first run of a query is not
counted (class loading, code generation); the second one is. The `raw_*` entries are the jobs on
image files: the bytes of all documents, written as image files several times over, are sliced,
scanned over slice boundaries, hashed and counted. `scan_mb_per_core_sec` relates them to bytes.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slicewise.operators import hashes, histogram, scanners  # noqa: E402
from slicewise.operators.sinks import consume  # noqa: E402
from slicewise.plans.queries import QUERIES  # noqa: E402
from slicewise.session import local_session  # noqa: E402
from slicewise.sources.files import read_raw  # noqa: E402

HEADLINE = [
    "email_scan",
    "email_scan_seams",
    "email_anchor_scan",
    "scan_classes",
    "block_hash_table",
    "byte_histogram_total",
    "byte_histogram_by_image",
    "embedded_scan",
    "raw_image_slices",
    "feature_tsv",
    "cells_block_to_media",
    "cells_collapsed",
    "artifact_frequency",
    "inverted_index",
    "tfidf",
    "hash_totals",
    "image_overlap",
    "image_similarity",
    "similar_image_pairs",
    "shared_artifacts",
    "near_artifacts",
    "adjacent_artifacts",
    "related_media",
    "prefiltered_hashes",
    "neighbour_blocks",
    "top_images_by_address",
    "throughput_cumulative",
    "bytes_cumulative",
]
RAW_FILES, RAW_COPIES = 4, 2


def write_images(sf_dir: str, folder: str) -> int:
    """Image files holding the bytes of all documents; their total size."""
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist()
    content = "\n".join(texts).encode()
    for i in range(RAW_FILES):
        with open(os.path.join(folder, f"image{i}.raw"), "wb") as f:
            for _ in range(RAW_COPIES):
                f.write(content)
    return len(content) * RAW_FILES * RAW_COPIES


def raw_jobs(spark, folder: str) -> dict:
    return {
        "raw_scan_email": lambda: scanners.scan_email(read_raw(spark, folder, overlap=1024)),
        "raw_scan_email_anchor": lambda: scanners.scan_email_anchor(read_raw(spark, folder, overlap=1024)),
        "raw_block_hashes": lambda: hashes.block_hashes(read_raw(spark, folder).drop("before", "after", "error")),
        "raw_byte_histogram": lambda: histogram.histogram_total(
            histogram.byte_histogram(read_raw(spark, folder), by=())
        ),
        "raw_read_only": lambda: histogram.read_only_pass(read_raw(spark, folder)),
    }


def timed(make) -> float:
    for _ in range(2):
        start = time.perf_counter()
        consume(make())
        seconds = time.perf_counter() - start
    return round(seconds, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, memory=os.environ.get("BENCH_MEMORY", "16g"), app="bench")
    times = {}
    for name in HEADLINE:
        times[name] = timed(lambda: QUERIES[name](spark, sf_dir))
        print(f"{name}: {times[name]}", file=sys.stderr)
    rates = {}
    with tempfile.TemporaryDirectory(prefix="slicewise-bench-") as folder:
        size = write_images(sf_dir, folder)
        for name, make in raw_jobs(spark, folder).items():
            times[name] = timed(make)
            rates[name] = round(size / 1e6 / times[name] / cores, 2)
    spark.stop()
    result = {
        "metric": "total time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "raw_bytes": size,
        "scan_mb_per_core_sec": rates,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
