"""Cubes written as dense chunk blocks with their coordinates and attributes.

    <path>/manifest             which version is the cube, and all that describes it
    <path>/v-<name>/blocks      ``blocks``, a folder for each variable
    <path>/v-<name>/coordinates time, height, y, x

A write makes a new version beside the one that stands, with Spark's own writers, so
a failed or repeated task leaves no rows; then one rename puts the new manifest in
the place of the old, and what it doesn't name is removed.  A write that fails
before the rename leaves the older cube as it was.  One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import attributes, stored_name
from ..functions import crs
from ..functions.projection import Projection
from ..operators.packing import pack, unpack
from ..session import broadcast_if_small
from . import blocks
from .blocks import AXES

#: Rows of a page of a file: filters on chunks open only pages that hold some.
PAGE_ROWS = 4


def write_cube(spark: SparkSession, path: str, variables: Mapping[str, DataFrame], coordinates: Mapping[str, DataFrame], projection: Projection, chunk_shape: Sequence[int], dataset_type: str = "grid", compression: str = "zstd", packing: Mapping[str, tuple[int, float]] | None = None) -> None:
    """Replaces the cube at ``path``.  All variables are one job, so what they have in
    common is shuffled once."""
    shape = dict(zip(AXES, chunk_shape, strict=True))
    packing = packing or {}
    version = f"v-{uuid.uuid4().hex}"
    meta = {
        "version": version, "dataset_type": dataset_type, "chunk_shape": list(chunk_shape), "projection": projection.parameters(), "crs": crs.to_projjson(projection),
        "variables": {stored_name(o): attributes(o) for o in variables}, "packing": {stored_name(o): list(p) for o, p in packing.items() if o in variables},
    }
    try:
        for name, rows in coordinates.items():
            rows.coalesce(1).write.option("compression", compression).parquet(f"{path}/{version}/coordinates/{name}")
        parts = []
        for out, df in variables.items():
            value = pack(F.col("value"), *packing[out]) if out in packing else F.col("value")
            parts.append(blocks.encoded(df.withColumn("value", value), shape, out in packing).withColumn("variable", F.lit(stored_name(out))))
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        whole.write.option("compression", compression).option("parquet.page.row.count.limit", PAGE_ROWS).partitionBy("variable").parquet(f"{path}/{version}/blocks")
        _swap(spark, path, meta)
    except BaseException:
        _remove(spark, f"{path}/{version}")
        raise
    for name in _names(spark, path):
        if name.startswith("v-") and name != version:
            _remove(spark, f"{path}/{name}")


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    return [s.getPath().getName() for s in _files(spark, path).listStatus(_path(spark, path))]


def _remove(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(_path(spark, path), True)


def _swap(spark: SparkSession, path: str, meta: Mapping) -> None:
    """Puts a manifest in place by one rename, which either happens or doesn't."""
    fs, jvm = _files(spark, path), spark._jvm
    new, old = (fs.makeQualified(_path(spark, f"{path}/{n}")) for n in (f"{meta['version']}/manifest", "manifest"))
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(meta, sort_keys=True).encode()))
    out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration()).rename(new, old, how)


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest").collect()))


def read_projection(spark: SparkSession, path: str) -> Projection:
    """From the CRS that is written as a standard text."""
    return crs.from_projjson(read_meta(spark, path)["crs"])


def read_coordinate(spark: SparkSession, path: str, name: str, meta: dict | None = None) -> DataFrame:
    return spark.read.parquet(f"{path}/{(meta or read_meta(spark, path))['version']}/coordinates/{name}")


def read_blocks(spark: SparkSession, path: str, name: str, meta: dict | None = None) -> DataFrame:
    meta = meta or read_meta(spark, path)
    if name not in meta["variables"]:
        raise KeyError(f"{path} has no variable {name!r}; it has {', '.join(meta['variables'])}")
    return spark.read.schema(blocks.SCHEMA).parquet(f"{path}/{meta['version']}/blocks/variable={name}")


def read_variable(spark: SparkSession, path: str, name: str, box: Mapping[str, tuple[int, int]] | None = None, dense: bool = False) -> DataFrame:
    """time, height, y, x, t, h, j, i and the values of a written variable, unpacked, its
    attributes as the column's metadata.

    ``box`` has the first and last index of some axes: only chunks that it touches are
    read.  ``dense`` gives every cell of the axes, those without a value as nulls.
    """
    meta = read_meta(spark, path)
    shape = dict(zip(AXES, meta["chunk_shape"], strict=True))
    axes = {a: read_coordinate(spark, path, c, meta).select(F.col(a).cast("int").alias(a), c) for a, c in zip(AXES, ("time", "height", "y", "x"), strict=True)}
    packing = meta["packing"].get(name)
    rows = blocks.within(read_blocks(spark, path, name, meta), shape, box or {})
    extent = None
    if dense:
        ends = [tuple(df.agg(F.min(a), F.max(a)).first()) for a, df in axes.items()]
        extent = [(max(lo, box[a][0]), min(hi, box[a][1])) if box and a in box else (lo, hi) for a, (lo, hi) in zip(AXES, ends, strict=True)]
        rows = blocks.every_chunk(rows, shape, extent)
    cells = blocks.decoded(rows, shape, packing is not None, extent)
    for axis, (lo, hi) in (box or {}).items():
        cells = cells.filter(F.col(axis).between(lo, hi))
    for axis, coordinate in axes.items():
        cells = cells.join(broadcast_if_small(coordinate), axis)
    value = unpack(F.col("value"), *packing).cast("float") if packing else F.col("value")
    described = meta["variables"][name] | ({"precision": packing[0], "offset": packing[1]} if packing else {})
    return cells.select("time", "height", "y", "x", *AXES, value.alias(name, metadata=described))
