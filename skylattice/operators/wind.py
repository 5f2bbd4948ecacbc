"""Wind components, speed and direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small


def attach_rotation(df: DataFrame, grid: DataFrame | None, keys: tuple[str, ...] = ("j", "i")) -> DataFrame:
    """``df`` with cosa and sina of its cell; without a grid, or where it has no
    cell, components aren't rotated."""
    if grid is None:
        return df.withColumns({"cosa": F.lit(1.0), "sina": F.lit(0.0)})
    joined = df.join(broadcast_if_small(grid.select(*keys, "cosa", "sina")), list(keys), "left")
    return joined.withColumns({"cosa": F.coalesce(F.col("cosa").cast("double"), F.lit(1.0)), "sina": F.coalesce(F.col("sina").cast("double"), F.lit(0.0))})


def rotate(u: Column, v: Column, cosa: Column, sina: Column) -> tuple[Column, Column]:
    """Grid components to earth components."""
    return u * cosa + v * sina, v * cosa - u * sina


def speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def direction(u: Column, v: Column) -> Column:
    """Where the wind comes from, in degrees from north; calm gives 270."""
    return F.pmod(F.lit(270.0) - F.degrees(F.atan2(v, u)), F.lit(360.0))
