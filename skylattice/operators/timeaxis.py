"""Time axes of many files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse_times(text: Column) -> Column:
    """``2023-02-12_06:00:00`` to a timestamp without zone, cut to the minute."""
    return F.date_trunc("MINUTE", F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd_HH:mm:ss"))).cast("timestamp_ntz")


def to_time(text: str) -> Column:
    """A literal from ISO text; a date alone is its midnight."""
    return F.lit(text).cast("timestamp_ntz")


def parsed(text: str) -> datetime:
    """The same on the driver."""
    return datetime.fromisoformat(text)


def first_of_each_time(rows: DataFrame, time: str, *order: str) -> DataFrame:
    """Of rows with equal times the first by ``order``.

    An aggregate rather than a window: partial results are merged before the
    shuffle, and a time that very many rows share isn't sorted in one task.
    """
    others = [c for c in rows.columns if c not in (time, *order)]
    best = F.min(F.struct(*order, *others)).alias("_first")
    return rows.groupBy(time).agg(best).select(time, *(F.col(f"_first.{c}").alias(c) for c in (*order, *others)))


def time_axis(times: DataFrame) -> DataFrame:
    """(file, t_idx, time) of all files to the axis: each time once, from the first
    file that has it, with g_idx in time order.  An axis has a row for each time
    step, not for each cell, so numbering it in one task is in order."""
    first = first_of_each_time(times.select("file", "t_idx", "time"), "time", "file", "t_idx")
    return first.withColumn("g_idx", F.row_number().over(W.orderBy("time")) - 1).select("g_idx", "time", "file", "t_idx")


def between_times(df: DataFrame, start: str | None, end: str | None, time: str = "time") -> DataFrame:
    """Both ends included, either may be missing."""
    if start is not None:
        df = df.filter(F.col(time) >= to_time(start))
    if end is not None:
        df = df.filter(F.col(time) <= to_time(end))
    return df


def output_index(axis: DataFrame) -> DataFrame:
    """The position of each time step among those that are left."""
    return axis.withColumn("out_idx", F.row_number().over(W.orderBy("time")) - 1)


def locate(axis: DataFrame, wanted: DataFrame) -> DataFrame:
    """File and index within it of global time indices (a column g_idx).  An index
    that the axis hasn't is left out; ``locate_one`` raises for it."""
    return wanted.join(axis.select("g_idx", "file", "t_idx"), "g_idx")


def locate_one(axis: DataFrame, g_idx: int) -> tuple[str, int]:
    """The same for one index; IndexError past either end."""
    found = axis.filter(F.col("g_idx") == g_idx).select("file", "t_idx").collect()
    if not found:
        raise IndexError(f"time index {g_idx} is out of range")
    return found[0].file, found[0].t_idx
