"""Increments of accumulated quantities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .timeaxis import between_times, to_time


def total(columns: Sequence[Column]) -> Column:
    """The sum of the sources; missing if one is."""
    first, *rest = (c.cast("double") for c in columns)
    for c in rest:
        first = first + c
    return first


def increments(df: DataFrame, value: Column, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``value`` less the one before it in each cell; null at a cell's first row.
    Filter times after this, not before."""
    return df.withColumn(name, value - F.lag(value).over(W.partitionBy(*by).orderBy(*order)))


def increments_between(df: DataFrame, axis: DataFrame, value: Column, by: Sequence[str], name: str, start: str | None, end: str | None, time: str = "time") -> DataFrame:
    """Increments of a time range, from rows no earlier than one step before it.

    All cells share the axis, so the step before ``start`` is the same for all;
    one small query over the axis finds it, and earlier data aren't scanned.
    """
    halo = start
    if start is not None:
        before = axis.filter(F.col("time") < to_time(start)).agg(F.max("time")).collect()[0][0]
        halo = str(before) if before is not None else start
    return between_times(increments(between_times(df, halo, end, time), value, by, [time], name), start, end, time)


# --- by segments: files, or whatever comes one after another -----------------


def segment_edges(df: DataFrame, value: Column, segment: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """segment, by, first, last (the order's columns as a struct), first_total and
    last_total: a row for each segment of a cell, merged before the shuffle."""
    rows = df.select(segment, *by, F.struct(*order).alias("_at"), value.alias("_total"))
    at = F.col("_at")
    return rows.groupBy(segment, *by).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.min_by("_total", at).alias("first_total"), F.max_by("_total", at).alias("last_total"))


def first_increments(edges: DataFrame, by: Sequence[str], order: Sequence[str], name: str, earlier: DataFrame | None = None) -> DataFrame:
    """by, order and the increment of each segment's first row: its total less the last
    one of the cell's segment before, from edges alone.  ``earlier`` has the edges of
    segments that were done before, of which only the last of a cell counts."""
    rows = edges.select(*by, "first", "first_total", "last_total", F.lit(True).alias("_own"))
    if earlier is not None:
        newest = earlier.groupBy(*by).agg(F.max(F.struct("first", "first_total", "last_total")).alias("e"))
        rows = rows.unionByName(newest.select(*by, "e.*", F.lit(False).alias("_own")))
    before = F.lag("last_total").over(W.partitionBy(*by).orderBy("first"))
    found = rows.withColumn(name, F.col("first_total") - before).filter("_own")
    return found.select(*by, *(F.col("first")[c].alias(c) for c in order), name)


def increments_by_segment(df: DataFrame, value: Column, segment: str, by: Sequence[str], order: Sequence[str], name: str, earlier: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """As ``increments`` (by, order and ``name``), for segments that follow each other:
    all rows of one come before all of the next.

    Within a segment each row has the one before it; across segments only edges meet, a
    row for each segment of a cell.  To add a segment, give its rows and as ``earlier``
    the edges of those before (or of the last one, where every cell is in every
    segment): their rows aren't read again.  ``edges`` are those of ``df`` if they are
    known, as a written table keeps them from being worked out twice.
    """
    edges = segment_edges(df, value, segment, by, order) if edges is None else edges
    w = W.partitionBy(segment, *by).orderBy(*order)
    inner = df.select(*by, *order, (value - F.lag(value).over(w)).alias(name), (F.row_number().over(w) > 1).alias("_later"))
    return inner.filter("_later").drop("_later").unionByName(first_increments(edges, by, order, name, earlier))
