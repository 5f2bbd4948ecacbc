"""Grid axes, and boxes in degrees cut out of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.projection import Projection


def axis_values(n: int, centre: float, step: float) -> list[float]:
    return [centre + (i - (n - 1) / 2) * step for i in range(n)]


def axis_frame(spark: SparkSession, n: int, centre: float, step: float, index: str = "i", name: str = "x") -> DataFrame:
    """The same as rows."""
    return spark.range(n).select(F.col("id").cast("int").alias(index), (F.lit(centre) + (F.col("id") - (n - 1) / 2) * step).alias(name))


def axes(attrs: dict, projection: Projection, lon_row: Sequence[float] | None = None, lat_column: Sequence[float] | None = None) -> tuple[list[float], list[float]]:
    """x and y of the mass points, from global attributes; grids in degrees have
    them as data."""
    if projection.kind == "latlon":
        return list(map(float, lon_row)), list(map(float, lat_column))
    nx = int(attrs["WEST-EAST_PATCH_END_UNSTAG"]) - int(attrs["WEST-EAST_PATCH_START_UNSTAG"]) + 1
    ny = int(attrs["SOUTH-NORTH_PATCH_END_UNSTAG"]) - int(attrs["SOUTH-NORTH_PATCH_START_UNSTAG"]) + 1
    cx, cy = projection.forward(float(attrs["CEN_LON"]), float(attrs["CEN_LAT"]))
    return axis_values(nx, cx, float(attrs["DX"])), axis_values(ny, cy, float(attrs["DY"]))


def geographic(projection: Projection, x: Sequence[float], y: Sequence[float]) -> tuple[float, float, float, float]:
    """(min lon, min lat, max lon, max lat) of the four corners."""
    corners = [projection.inverse(a, b) for a in (x[0], x[-1]) for b in (y[0], y[-1])]
    lons, lats = zip(*corners, strict=True)
    return min(lons), min(lats), max(lons), max(lats)


def to_indices(projection: Projection, bbox: Sequence[float], x: Sequence[float], y: Sequence[float]) -> tuple[int, int, int, int]:
    """First and last j and i within a box (min lon, min lat, max lon, max lat).

    The box's corners and the middles of its edges are projected, and the
    rectangle around them cuts the axes, both ends included.
    """
    west, south, east, north = map(float, bbox)
    if west > east or south > north:
        raise ValueError("the box must be (min lon, min lat, max lon, max lat); boxes across 180 degrees aren't supported")
    middle_x, middle_y = (west + east) / 2, (south + north) / 2
    points = [(a, b) for a in (west, middle_x, east) for b in (south, middle_y, north) if (a, b) != (middle_x, middle_y)]
    px, py = zip(*(projection.forward(a, b) for a, b in points), strict=True)
    i = [k for k, v in enumerate(x) if min(px) <= v <= max(px)]
    j = [k for k, v in enumerate(y) if min(py) <= v <= max(py)]
    if not i or not j:
        raise ValueError("the box does not overlap the grid")
    return j[0], j[-1], i[0], i[-1]


def within(df: DataFrame, window: tuple[int, int, int, int] | None, stagger_x: int = 0, stagger_y: int = 0, j: str = "j", i: str = "i") -> DataFrame:
    """Rows of the window, as literal bounds that reach the scan.  Staggered grids
    need one more column or row at the end."""
    if window is None:
        return df
    j0, j1, i0, i1 = window
    return df.filter(F.col(j).between(j0, j1 + stagger_y) & F.col(i).between(i0, i1 + stagger_x))


def bounds(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Least and greatest of each column."""
    return df.groupBy(*by).agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))
