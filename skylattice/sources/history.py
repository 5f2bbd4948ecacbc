"""History files read where they lie: a data source over HDF5, planned by chunks.

    spark.read.format("history").options(paths=json, table="columns3d", variables="U,V,PH,PHB").load()

Tables and columns are those of ``sources.model``, with ``file``, the place of the path
among ``paths``.  A partition is a box of (t, j, i) made of whole chunks of the files, of
at most ``max_mem`` bytes unless one chunk has more, so no chunk is read by two tasks.
Bounds of t_idx, j, i and file that Spark pushes cut the boxes before anything is read.

Components of the wind, which lie on the edges of cells, come out at their middles: a
box reads one more column or row than it has, and takes means of neighbours.  So all
winds are a scan, without a shuffle.

A file that lacks a variable is a KeyError, and one that has it in another shape or type
than the first a TypeError, before any data is read.  Files are opened by ``library`` (h5py),
on the driver for their shapes and in tasks for data, at paths that all of them see.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..session import BROADCAST_BYTES
from .model import ModelSource

MAX_MEM = 2**27
#: Rows of a batch that goes to Spark.
BATCH_CELLS = 1 << 15
#: Components on the edges of cells: the axis along which they are one longer.
EDGES = {"U": 3, "V": 2}
#: Tables of one value or column for each cell, by the rank of their variables.
RANK = {"surface": 3, "columns3d": 4}
STATIC = {"grid": ("COSALPHA", "SINALPHA"), "geo": ("XLONG", "XLAT")}


@dataclass
class Box(InputPartition):
    """First and one past the last of each axis, in one file."""

    file: int
    t: tuple[int, int]
    j: tuple[int, int]
    i: tuple[int, int]


class History(DataSource):
    @classmethod
    def name(cls) -> str:
        return "history"

    def schema(self) -> str:
        table, variables = self.options["table"], names(self.options)
        if table == "attrs":
            return "file int, name string, value string"
        if table == "times":
            return "file int, t_idx int, text string"
        kind = "array<float>" if RANK.get(table) == 4 else "float"
        return ("file int, j int, i int" if table in STATIC else "file int, t_idx int, j int, i int") + "".join(f", `{v}` {kind}" for v in variables)

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))


def names(options: dict) -> list[str]:
    return list(STATIC.get(options["table"], ())) or [v for v in options.get("variables", "").split(",") if v]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.table, self.variables = options["table"], names(options)
        self.paths = json.loads(options["paths"])
        self.max_mem = int(options.get("max_mem", MAX_MEM))
        self.library = options.get("library", "h5py")
        self.files = json.loads(options.get("files") or "null")
        self.low: dict[str, int] = {}
        self.high: dict[str, int] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes bounds of the axes; what is left goes back to Spark."""
        for f in filters:
            axis = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if axis not in ("file", "t_idx", "j", "i") or not isinstance(getattr(f, "value", None), int):
                yield f
            elif isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low[axis] = max(self.low.get(axis, 0), f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high[axis] = min(self.high.get(axis, f.value), f.value - isinstance(f, LessThan))
            else:
                yield f

    def _cut(self, axis: str, n: int) -> tuple[int, int]:
        """The asked part of an axis of ``n``."""
        return max(0, self.low.get(axis, 0)), min(n, self.high.get(axis, n - 1) + 1)

    def open(self, file: int):
        return importlib.import_module(self.library).File(self.paths[file], "r")

    # --- planning

    def partitions(self) -> list[InputPartition]:
        files = [k for k in range(*self._cut("file", len(self.paths))) if self.files is None or k in self.files]
        if self.table in ("attrs", "times"):
            return [Box(k, (0, 0), (0, 0), (0, 0)) for k in files]
        out: list[InputPartition] = []
        first: dict[str, tuple] = {}
        for k in files:
            with self.open(k) as h5:
                self._check(k, h5, first)
                if self.variables:
                    out += self._boxes(k, h5)
        return out

    def _check(self, file: int, h5, first: dict[str, tuple]) -> None:
        """Each variable is there, and is what it is in the first file but for its steps."""
        for v in self.variables:
            if v not in h5:
                raise KeyError(f"{self.paths[file]} has no variable {v!r}")
            own = (h5[v].shape[1:], str(h5[v].dtype))
            if own != first.setdefault(v, own):
                raise TypeError(f"{self.paths[file]} has {v!r} as {own}, not as {first[v]}")

    def _boxes(self, file: int, h5) -> Iterator[Box]:
        shapes = {v: h5[v].shape for v in self.variables}
        sizes = [min(s[k] for s in shapes.values()) for k in (0, -2, -1)]  # staggered ones are longer
        if self.table in STATIC:
            sizes[0] = min(1, sizes[0])
        # The coarsest chunk of all variables; a contiguous one counts as a step's plane.
        chunks = [(c[0], c[-2], c[-1]) for v in self.variables for c in [h5[v].chunks or (1, *shapes[v][1:])]]
        unit = [min(n, max(c[k] for c in chunks)) for k, n in enumerate(sizes)]
        cell = sum(int(np.prod(s[1:-2])) * h5[v].dtype.itemsize for v, s in shapes.items())
        # Whole chunks, first along i, then j, then t, as many as fit.
        box = list(unit)
        for k in (2, 1, 0):
            rest = int(np.prod(box)) // box[k] * cell
            box[k] = min(-(-sizes[k] // unit[k]), max(1, self.max_mem // max(1, rest) // unit[k])) * unit[k]
        t, j, i = (self._cut(a, n) for a, n in zip(("t_idx", "j", "i"), sizes, strict=True))
        spans = [[(max(lo, a), min(hi, a + step)) for a in range(lo // step * step, hi, step)] for (lo, hi), step in zip((t, j, i), box, strict=True)]
        yield from (Box(file, a, b, c) for a in spans[0] for b in spans[1] for c in spans[2])

    # --- reading

    def read(self, box: Box | None) -> Iterator[pa.RecordBatch]:
        if box is None:  # nothing was planned
            return
        with self.open(box.file) as h5:
            if self.table == "attrs":
                rows = [(k, str(v.item() if getattr(v, "size", 1) == 1 and hasattr(v, "item") else v)) for k, v in h5.attrs.items()]
                yield self._batch(box, len(rows), [pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["name", "value"])
            elif self.table == "times":
                steps = range(*self._cut("t_idx", h5["Times"].shape[0]))
                text = [b"".join(h5["Times"][t].tolist()).decode() for t in steps]
                yield self._batch(box, len(text), [pa.array(steps, pa.int32()), pa.array(text, pa.string())], ["t_idx", "text"])
            else:
                yield from self._cells(box, h5)

    def _cells(self, box: Box, h5) -> Iterator[pa.RecordBatch]:
        data = {v: self._values(box, h5[v], v) for v in self.variables}
        ny, nx = box.j[1] - box.j[0], box.i[1] - box.i[0]
        rows = max(1, BATCH_CELLS // max(1, nx))
        for t in range(box.t[1] - box.t[0]):
            for at in range(0, ny, rows):
                n = min(rows, ny - at)
                place = [np.repeat(np.arange(at, at + n) + box.j[0], nx), np.tile(np.arange(box.i[0], box.i[1]), n)]
                columns = [] if self.table in STATIC else [np.full(n * nx, box.t[0] + t)]
                arrays = [pa.array(x.astype(np.int32)) for x in (*columns, *place)] + [_column(d[t, ..., at : at + n, :]) for d in data.values()]
                yield self._batch(box, n * nx, arrays, ([] if self.table in STATIC else ["t_idx"]) + ["j", "i", *self.variables])

    def _values(self, box: Box, stored, name: str) -> np.ndarray:
        """A box of a variable as (t, ..., j, i); those on edges as means of neighbours."""
        edge = EDGES.get(name) if len(stored.shape) == 4 else None
        j, i = (box.j[0], box.j[1] + (edge == 2)), (box.i[0], box.i[1] + (edge == 3))
        got = np.asarray(stored[box.t[0] : box.t[1], ..., j[0] : j[1], i[0] : i[1]])
        if edge is None:
            return got
        low, high = (got[..., :-1], got[..., 1:]) if edge == 3 else (got[..., :-1, :], got[..., 1:, :])
        return (low + high) / 2

    def _batch(self, box: Box, n: int, arrays: list, columns: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, box.file, np.int32)), *arrays], ["file", *columns])


def _column(values: np.ndarray) -> pa.Array:
    """(j, i) as floats, (z, j, i) as a list for each cell."""
    if values.ndim == 2:
        return pa.array(values.reshape(-1).astype(np.float32))
    flat = np.ascontiguousarray(values.reshape(values.shape[0], -1).T.astype(np.float32))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.reshape(-1)))


def read(spark: SparkSession, paths: list[str], table: str, variables: Sequence[str] = (), max_mem: int = MAX_MEM, library: str = "h5py", files: Sequence[int] | None = None) -> DataFrame:
    """A table of history files, or of those whose places are in ``files``, as rows."""
    spark.dataSource.register(History)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"paths": json.dumps(list(paths)), "table": table, "variables": ",".join(variables), "max_mem": max_mem, "library": library}
    return spark.read.format("history").options(**options, files=json.dumps(None if files is None else sorted(files))).load()


@dataclass
class HistorySource(ModelSource):
    """``ModelSource`` over HDF5 files themselves: nothing is copied first."""

    max_mem: int = MAX_MEM
    library: str = "h5py"

    unstaggered = True

    @cached_property
    def shapes(self) -> dict[str, tuple]:
        """The shape of each variable of the first file."""
        with importlib.import_module(self.library).File(self.input_paths[0], "r") as h5:
            return {v: h5[v].shape for v in h5}

    @cached_property
    def rotation(self) -> DataFrame | None:
        """As of other sources; its size is that of a plane, which the optimizer can't know."""
        grid = ModelSource.rotation.func(self)
        small = grid is not None and 24 * int(np.prod(self.shapes["COSALPHA"][-2:])) < BROADCAST_BYTES
        return grid.hint("broadcast") if small else grid

    def has(self, table: str) -> bool:
        return table in ("attrs", "times", *RANK) or table in STATIC and all(v in self.shapes for v in STATIC[table])

    def columns(self, table: str, path: str) -> dict[str, str]:
        sources = {s for v in self.catalogue.values() for s in v.sources} | {"HGT"}
        return {v: "array<float>" if RANK[table] == 4 else "float" for v in sorted(sources) if len(self.shapes.get(v, ())) == RANK[table]}

    def read(self, table: str, files: Iterable | None = None, columns: Iterable[str] | None = None) -> DataFrame:
        own = [v for v in self.columns(table, "") if columns is None or v in columns] if table in RANK else []
        return read(self.spark, self.input_paths, table, own, self.max_mem, self.library, files)

    def path_of(self, file) -> str:
        return self.input_paths[file]

    @property
    def first(self) -> list:
        return [0]

    def check(self, needed: Iterable[str], start: str | None = None, end: str | None = None) -> None:
        """As the reader does when it plans."""
        files = {s.file for s in self.within(start, end)}
        for table, own in self.tables.items():
            if use := [v for v in own if v in {*needed}]:
                Reader({"paths": json.dumps(self.input_paths), "table": table, "variables": ",".join(use), "library": self.library, "files": json.dumps(sorted(files | {0}))}).partitions()
