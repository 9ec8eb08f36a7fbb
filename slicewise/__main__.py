"""Command line of the jobs: `spark-submit` this file or `python -m slicewise <job> ...`."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise.operators.histogram import read_only_pass
from slicewise.operators.sinks import reshard
from slicewise.operators.throughput import cumulative_bytes, cumulative_throughput, log_counters, throughput
from slicewise.plans import lifecycle
from slicewise.session import configure
from slicewise.sources.files import read_raw
from slicewise.sources.logs import read_log
from slicewise.sources.tables import read_artifacts, read_slices, scan_cells
from slicewise.streaming.ingest import ingest_stream


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="slicewise", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, text: str, *arguments: str) -> argparse.ArgumentParser:
        added = jobs.add_parser(name, help=text)
        for argument in arguments:
            added.add_argument(argument)
        return added

    job("features", "scan images for addresses, write text files", "images", "out")
    job("histogram", "byte histogram report of images", "images", "out")
    art = job("artifacts", "scan images, write the artifact table", "images", "out")
    art.add_argument("--pattern", action="append", default=[], metavar="CLASS=REGEX")
    job("slices", "copy images to a slice table, those it holds already left out", "images", "out").add_argument(
        "--append", action="store_true", help="the table exists"
    )
    both = job("blocks", "block hashes and both keyed tables", "images", "hashes", "media_to_block", "block_to_media")
    both.add_argument("--put", help="name of the puts, for a run that may be repeated")
    job("count", "read images and count their bytes", "images", "out")
    job("regroup", "rewrite an artifact table into evenly filled files", "table", "out").add_argument(
        "-n", type=int, default=500
    )
    job("addresses", "cells per row key of a keyed table", "table", "out").add_argument("--family", default="f")
    job("ingest", "take in new slice files once", "slices", "table", "checkpoint")
    rate = job("throughput", "series of an executor log", "log", "out")
    rate.add_argument("--bucket", type=int, default=10, help="seconds")
    rate.add_argument("--cumulative", action="store_true")
    job("progress", "bytes over time of a progress log", "log", "out")
    job("counters", "sums of counter lines of a log", "log", "out").add_argument("prefix", nargs="+")
    return top


def _save_lines(df: DataFrame, out: str) -> None:
    columns = [F.col(c).cast("string") for c in df.columns]
    df.select(F.concat_ws("\t", *columns).alias("line")).write.mode("errorifexists").text(out)


def main(arguments: Sequence[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = configure(SparkSession.builder.appName(f"slicewise {a.job}").getOrCreate())
    if a.job == "features":
        lifecycle.features_of_images(spark, a.images, a.out)
    elif a.job == "histogram":
        _save_lines(lifecycle.histogram_of_images(spark, a.images), a.out)
    elif a.job == "artifacts":
        patterns = dict(p.split("=", 1) for p in a.pattern)
        lifecycle.artifacts_of_images(spark, a.images, a.out, {"email": None, **patterns})
    elif a.job == "slices":
        done = read_slices(spark, a.out).select("image").distinct() if a.append else None
        lifecycle.slices_of_images(spark, a.images, a.out, done)
    elif a.job == "blocks":
        lifecycle.block_tables(spark, a.images, a.hashes, a.media_to_block, a.block_to_media, a.put)
    elif a.job == "count":
        _save_lines(read_only_pass(read_raw(spark, a.images)), a.out)
    elif a.job == "regroup":
        reshard(read_artifacts(spark, a.table), a.n).write.mode("errorifexists").parquet(a.out)
    elif a.job == "addresses":
        cells = scan_cells(spark, a.table, a.family).groupBy("row_key").agg(F.count("*").alias("n"))
        _save_lines(cells.orderBy(F.desc("n"), "row_key"), a.out)
    elif a.job == "ingest":
        ingest_stream(spark, a.slices, a.table, a.checkpoint).awaitTermination()
    elif a.job == "throughput":
        buckets = throughput(read_log(spark, a.log, "executor"), a.bucket)
        _save_lines((cumulative_throughput(buckets) if a.cumulative else buckets).orderBy("bucket"), a.out)
    elif a.job == "progress":
        _save_lines(cumulative_bytes(read_log(spark, a.log, "progress")).orderBy("seconds"), a.out)
    elif a.job == "counters":
        _save_lines(log_counters(spark.read.text(a.log), a.prefix), a.out)


if __name__ == "__main__":
    main()
