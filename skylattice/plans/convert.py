"""From model files to a cube: one lazy plan for each output variable."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Variable
from ..operators import accum, bbox, derive, levels, merge, resolve, stagger, timeaxis, wind
from ..sources.model import ModelSource
from ..sources.sink import write_cube

CELL = ["time", "j", "i"]


@dataclass
class Request:
    """What is asked for, checked before any data is read."""

    source: ModelSource
    keys: list[str]
    levels: list[float]
    start: str | None
    end: str | None
    window: tuple[int, int, int, int] | None
    above_ground: bool

    def times(self, df: DataFrame) -> DataFrame:
        return timeaxis.between_times(df, self.start, self.end)

    def cells(self, table: str, columns: Sequence[str], step_before: bool = False, **halo: int) -> DataFrame:
        """Rows of the box; times are the range's, or those and the step before it.
        ``columns`` are the variables that are used."""
        names = {"u_stag": {"i": "i_stag"}, "v_stag": {"j": "j_stag"}}.get(table, {})
        start = self.source.before(self.start) if step_before else self.start
        return bbox.within(self.source.timed(table, start, self.end, columns), self.window, **halo, **names)


def request(source: ModelSource, variables=None, start=None, end=None, bbox_degrees=None, target_levels=None, above_ground=False) -> Request:
    keys = resolve.resolve(variables, source.variables)
    resolve.check_levels(keys, source.variables, target_levels)
    window = bbox.to_indices(source.projection, bbox_degrees, *source.axes) if bbox_degrees is not None else None
    needed = {s for k in keys for s in source.variables[k].sources} | ({"HGT"} if above_ground and target_levels else set())
    accumulated = any(source.variables[k].transform == "accumulation_increment" for k in keys)
    source.check(needed, source.before(start) if accumulated else start, end)
    return Request(source, keys, sorted({float(x) for x in target_levels or ()}), start, end, window, above_ground)


# --- surface variables: one row in, one value out


def _rotated(r: Request) -> DataFrame:
    df = wind.attach_rotation(r.cells("surface", ["U10", "V10"]), r.source.rotation)
    u, v = wind.rotate(F.col("U10").cast("double"), F.col("V10").cast("double"), F.col("cosa"), F.col("sina"))
    return df.withColumns({"_ue": u, "_ve": v})


WINDS = {
    "wind_speed": lambda: wind.speed(F.col("_ue"), F.col("_ve")),
    "wind_direction": lambda: wind.direction(F.col("_ue"), F.col("_ve")),
    "u_wind": lambda: F.col("_ue"),
    "v_wind": lambda: F.col("_ve"),
}


def _surface(r: Request, v: Variable) -> DataFrame:
    """time, j, i, value of a variable at a fixed height."""
    if v.transform is None:
        return r.times(r.cells("surface", v.sources)).select(*CELL, F.col(v.sources[0]).alias("value"))
    if v.transform in WINDS:
        return r.times(_rotated(r)).select(*CELL, WINDS[v.transform]().alias("value"))
    if v.transform == "sea_level_pressure":
        return r.times(r.cells("surface", v.sources)).select(*CELL, derive.sea_level_pressure(*(F.col(s).cast("double") for s in v.sources)).alias("value"))
    if v.transform == "accumulation_increment":
        total = accum.total([F.col(s) for s in v.sources])
        df = accum.increments_between(r.cells("surface", v.sources, step_before=True), r.source.axis, total, ["j", "i"], "value", r.start, r.end)
        return df.select(*CELL, "value")
    raise ValueError(f"Unknown transform {v.transform!r}")


# --- level variables: one column of the model in, one value for each level out


def _columns(r: Request, v: Variable) -> DataFrame:
    """Mass columns with the height of each level."""
    df = r.times(r.cells("columns3d", v.sources))
    terrain = None
    if r.above_ground:
        df = df.join(r.times(r.cells("surface", ["HGT"])).select(*CELL, "HGT"), CELL)
        terrain = F.col("HGT")
    return df.withColumn("_z", derive.geo_height(F.col("PH"), F.col("PHB"), terrain))


def _winds_3d(r: Request, variable: Variable) -> DataFrame:
    """Heights and rotated components of each mass column.  All four winds are made of
    the same rows, so in one job they share its shuffles."""
    df = _columns(r, variable)
    if not r.source.unstaggered:
        u = r.times(r.cells("u_stag", ["U"], stagger_x=1)).select(*CELL[:2], "i_stag", "U")
        v = r.times(r.cells("v_stag", ["V"], stagger_y=1)).select("time", "j_stag", "i", "V")
        df = stagger.on_mass_points(df.select(*CELL, "_z"), u, v)
    df = wind.attach_rotation(df, r.source.rotation)
    pairs = F.arrays_zip(F.col("U").cast("array<double>").alias("u"), F.col("V").cast("array<double>").alias("v"))
    turned = lambda part: F.transform(pairs, lambda x: wind.rotate(x["u"], x["v"], F.col("cosa"), F.col("sina"))[part])
    return df.withColumns({"_ue": turned(0), "_ve": turned(1)})


def _both(f) -> Column:
    return F.zip_with("_ue", "_ve", f)


LEVELS = {
    "potential_to_actual_temp": (_columns, lambda: derive.actual_temperature(F.col("T"), F.col("P"), F.col("PB"))),
    "mixing_ratio_to_specific_humidity": (_columns, lambda: derive.humidity_levels(F.col("QVAPOR"))),
    "wind_speed_3d": (_winds_3d, lambda: _both(wind.speed)),
    "wind_direction_3d": (_winds_3d, lambda: _both(wind.direction)),
    "u_wind_3d": (_winds_3d, lambda: F.col("_ue")),
    "v_wind_3d": (_winds_3d, lambda: F.col("_ve")),
}


def _on_levels(r: Request, v: Variable, heights: Sequence[float]) -> DataFrame:
    if v.transform not in LEVELS:
        raise ValueError(f"Unknown transform {v.transform!r}")
    rows, values = LEVELS[v.transform]
    df = rows(r, v).withColumn("_v", values())
    return df.select(*CELL, F.inline(levels.at_levels(F.col("_z"), F.col("_v"), heights)))


# --- the cube


def variable(r: Request, out: str) -> DataFrame:
    """(time, height, y, x, value) of an output name, with indices t, h, j, i."""
    have = r.source.variables
    keys = merge.group_keys(r.keys, have)[out]
    parts = []
    for key, heights in merge.winners(keys, have, r.levels).items():
        v = have[key]
        if v.on_levels and heights:
            parts.append(_on_levels(r, v, heights))
        elif heights:
            parts.append(_surface(r, v).withColumn("height", F.lit(v.height)))
    rows = parts[0].select(*CELL, "height", F.col("value").cast("float").alias("value"))
    for p in parts[1:]:
        rows = rows.unionByName(p.select(*CELL, "height", F.col("value").cast("float").alias("value")))
    return rows


def convert(source: ModelSource, variables=None, start: str | None = None, end: str | None = None, bbox_degrees=None, target_levels=None, above_ground: bool = False) -> dict[str, DataFrame]:
    """Output name to rows (time, height, y, x, t, h, j, i, value), all lazy.

    ``target_levels`` are metres above the sea, or above the ground with
    ``above_ground``.  Values out of a column's range are null.
    """
    r = request(source, variables, start, end, bbox_degrees, target_levels, above_ground)
    coords = coordinates(r)
    have = source.variables
    heights = merge.heights_of(r.keys, have, r.levels)
    x, y = source.axes
    at = lambda values, index: F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col(index) + 1).cast("float")
    out = {}
    for name in merge.group_keys(r.keys, have):
        rows = merge.height_index(variable(r, name), heights)
        rows = rows.join(coords["time"], "time").withColumnRenamed("h_idx", "h")
        out[name] = rows.select("time", "height", at(y, "j").alias("y"), at(x, "i").alias("x"), "t", "h", "j", "i", "value")
    return out


def coordinates(r: Request) -> dict[str, DataFrame]:
    """The axes of the cube: time steps, heights, y and x that are left."""
    spark = r.source.spark
    x, y = r.source.axes
    j0, j1, i0, i1 = r.window or (0, len(y) - 1, 0, len(x) - 1)
    time = timeaxis.output_index(timeaxis.between_times(r.source.axis, r.start, r.end)).select(F.col("out_idx").cast("int").alias("t"), "time")
    heights = merge.heights_of(r.keys, r.source.variables, r.levels)
    return {
        "time": time,
        "height": spark.createDataFrame([*enumerate(heights)], "h int, height double"),
        "y": spark.createDataFrame([(j, y[j]) for j in range(j0, j1 + 1)], "j int, y float"),
        "x": spark.createDataFrame([(i, x[i]) for i in range(i0, i1 + 1)], "i int, x float"),
    }


def write(source: ModelSource, path: str, variables=None, start=None, end=None, bbox_degrees=None, target_levels=None, above_ground=False, chunk_shape=None, dataset_type: str = "grid", compression: str = "zstd", packing=None) -> None:
    """``convert`` to chunked Parquet; the default chunk is one time and height."""
    x, y = source.axes
    r = request(source, variables, start, end, bbox_degrees, target_levels, above_ground)
    shape = tuple(chunk_shape or (1, 1, len(y), len(x)))
    if len(shape) != 4 or min(shape) < 1:
        raise ValueError("chunk_shape must be four positive numbers: time, height, y, x")
    cube = convert(source, variables, start, end, bbox_degrees, target_levels, above_ground)
    write_cube(source.spark, path, cube, coordinates(r), source.projection, shape, dataset_type, compression, packing)
