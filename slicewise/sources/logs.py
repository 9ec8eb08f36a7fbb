"""Executor and progress logs as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column positions (from 1) of the log layouts.
PROGRESS_DATE, PROGRESS_CLOCK, PROGRESS_BYTES = 1, 12, 25
EXECUTOR_CLOCK, EXECUTOR_TEXT = 10, 19
# Texts that mark the events of an executor log.
STARTED = "INFO Executor: Running task"
FINISHED = "INFO Executor: Finished task"
#: shorter lines of an executor log hold no event
EXECUTOR_MIN_LINE = 47


def log_filter(df: DataFrame, position: int, text: str, line: str = "value") -> DataFrame:
    """Lines that hold `text` at a fixed column (from 1)."""
    if position == 1:
        return df.where(F.col(line).startswith(text))
    return df.where(F.substring(line, position, len(text)) == text)


def _seconds(line: Column, date: Column, clock_at: int) -> Column:
    """Seconds of a date and an hh?mm?ss clock, the same in every time zone."""
    hour = F.substring(line, clock_at, 2).try_cast("long")
    minute = F.substring(line, clock_at + 3, 2).try_cast("long")
    second = F.substring(line, clock_at + 6, 2).try_cast("long")
    return F.unix_date(date) * F.lit(86400) + hour * 3600 + minute * 60 + second


def parse_progress(line: Column) -> list[Column]:
    """`YYYY-MM-DD hh-mm-ss.tsv <bytes>` as (t, event, bytes)."""
    date = F.try_to_date(F.substring(line, PROGRESS_DATE, 10), "yyyy-MM-dd")
    return [
        _seconds(line, date, PROGRESS_CLOCK).alias("t"),
        F.lit("progress").alias("event"),
        F.substring(line, PROGRESS_BYTES, 20).try_cast("long").alias("bytes"),
    ]


def parse_executor(line: Column) -> list[Column]:
    """`YY/MM/DD hh:mm:ss INFO Executor: Running|Finished task` as (t, event, bytes).

    A line whose first columns hold no date counts from the start of the day.
    """
    date = F.try_to_date(F.concat(F.lit("20"), F.substring(line, 1, 8)), "yyyy/MM/dd")
    text = F.substring(line, EXECUTOR_TEXT, 64)
    event = F.when(text.startswith(STARTED), "started").when(text.startswith(FINISHED), "finished")
    return [
        _seconds(line, F.coalesce(date, F.lit("1970-01-01").cast("date")), EXECUTOR_CLOCK).alias("t"),
        event.alias("event"),
        F.lit(None).cast("long").alias("bytes"),
    ]


def parse_log(lines: DataFrame, layout: str, line: str = "value") -> DataFrame:
    """Lines of layout "progress" or "executor" as (t, event, bytes); other and malformed lines are left out."""
    text = F.col(line)
    if layout == "progress":
        rows = lines.where(F.length(text) >= PROGRESS_BYTES).select(*parse_progress(text))
        return rows.where(F.col("t").isNotNull() & F.col("bytes").isNotNull())
    if layout == "executor":
        rows = lines.where(F.length(text) >= EXECUTOR_MIN_LINE - 1).select(*parse_executor(text))
        return rows.where(F.col("event").isNotNull() & F.col("t").isNotNull())
    raise ValueError(f"unknown log layout {layout!r}")


def read_log(spark: SparkSession, path: str, layout: str) -> DataFrame:
    return parse_log(spark.read.text(path), layout)
