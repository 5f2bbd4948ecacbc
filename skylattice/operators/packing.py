"""Chunk ids of a cube, and packing of floats into scaled integers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_ids(shape: Mapping[str, int]) -> dict[str, Column]:
    """For each axis a column ``<axis>_chunk``: the chunk that an index lies in."""
    return {f"{axis}_chunk": F.floor(F.col(axis) / F.lit(n)).cast("long") for axis, n in shape.items()}


def chunked(df: DataFrame, shape: Mapping[str, int], partitions: int | None = None) -> DataFrame:
    """Rows dealt by chunk and sorted within, as they are written."""
    ids = chunk_ids(shape)
    df = df.withColumns(ids)
    df = df.repartition(partitions, *ids) if partitions else df.repartition(*ids)
    return df.sortWithinPartitions(*ids, *shape)


def pack(value: Column, precision: int, offset: float) -> Column:
    """To an integer with ``precision`` decimals above ``offset``; not a number
    gives null."""
    scaled = F.rint((value.cast("double") - F.lit(float(offset))) * F.lit(10.0**precision))
    return F.when(~F.isnan(value.cast("double")), scaled).cast("int")


def unpack(packed: Column, precision: int, offset: float) -> Column:
    return packed.cast("double") / F.lit(10.0**precision) + F.lit(float(offset))
