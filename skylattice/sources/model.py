"""Model history files as tables.

A source file is a folder of Parquet tables, each with ``t_idx`` for the step in
the file:

    attrs      name, value                       global attributes
    times      t_idx, text                       2023-02-12_06:00:00
    surface    t_idx, j, i, one column each      surface variables
    columns3d  t_idx, j, i, one array each       mass levels; PH, PHB staggered in z
    u_stag     t_idx, j, i_stag, U array         optional, staggered in x
    v_stag     t_idx, j_stag, i, V array         optional, staggered in y
    grid       j, i, COSALPHA, SINALPHA          optional, static
    geo        j, i, XLONG, XLAT                 grids in degrees

All files of a dataset are one scan.  Box bounds reach it as literals; of a time
range, the axis (one row a step) says which steps of which files it has: files with
the same steps are a scan with these as bounds, and other files aren't opened.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property, reduce
from operator import or_
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..catalog import CATALOGUE, Variable, available
from ..functions.projection import Projection, from_attributes
from ..functions.text import attribute
from ..operators import bbox, timeaxis
from ..session import broadcast_if_small


#: Tables whose variables the catalogue is asked for, and columns that aren't variables.
TABLES = ("surface", "columns3d", "u_stag", "v_stag")
INDICES = ("t_idx", "j", "i", "j_stag", "i_stag")
#: Up to so many scans for files that have different steps of a time range.
MOST_SCANS = 8
#: Footers that are read at once.
READERS = 16


def _place(file) -> tuple[str, str]:
    """Host and path of a location: what its spellings have in common."""
    if isinstance(file, tuple):
        return file
    parts = urlsplit(file)
    return parts.netloc, parts.path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in any store that Spark can read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@dataclass
class ModelSource:
    """What subclasses for other models give: their catalogue and how global
    attributes become a projection.  Tables are the same for all."""

    spark: SparkSession
    input_paths: Iterable[str] | str
    catalogue: dict[str, Variable] = field(default_factory=lambda: CATALOGUE)

    def __post_init__(self) -> None:
        paths = [self.input_paths] if isinstance(self.input_paths, str) or hasattr(self.input_paths, "__fspath__") else list(self.input_paths)
        self.input_paths = sorted(str(p).rstrip("/") for p in paths)
        for p in self.input_paths:
            if not exists(self.spark, p):
                raise FileNotFoundError(p)

    # --- hooks

    def parse_projection(self, attrs: dict) -> Projection:
        return from_attributes(attrs)

    # --- tables

    #: Whether ``columns3d`` has the components of the wind at the cells' middles.
    unstaggered = False

    @cached_property
    def tables(self) -> dict[str, dict[str, str]]:
        """The variables of the first file, with their types, by table."""
        return {t: self.columns(t, self.input_paths[0]) for t in TABLES if self.has(t)}

    def columns(self, table: str, path: str) -> dict[str, str]:
        """Names and types of a table of one file, from its footer."""
        return {f.name: f.dataType.simpleString() for f in self.spark.read.parquet(f"{path}/{table}.parquet").schema if f.name not in INDICES}

    def has(self, table: str) -> bool:
        return exists(self.spark, f"{self.input_paths[0]}/{table}.parquet")

    def read(self, table: str, files: Iterable | None = None, columns: Iterable[str] | None = None) -> DataFrame:
        """A table of all files, or of those named, with ``file``: where it lies, as Spark
        says it.  ``columns`` are those that will be used, for sources that can't tell
        from the plan."""
        paths = [p for p in self.input_paths if files is None or p in {*map(self.path_of, files)}]
        df = self.spark.read.parquet(*(f"{p}/{table}.parquet" for p in paths))
        return df.withColumn("file", F.substring_index("_metadata.file_path", f"/{table}.parquet", 1))

    def path_of(self, file) -> str:
        """The input path of a value of ``file``."""
        return self._paths[_place(file)]

    @cached_property
    def _paths(self) -> dict[tuple[str, str], str]:
        fs = self.spark._jvm.org.apache.hadoop.fs
        made = {p: fs.Path(p) for p in self.input_paths}
        conf = self.spark._jsc.hadoopConfiguration()
        return {_place(q.getFileSystem(conf).makeQualified(q).toUri().toString()): p for p, q in made.items()}

    @cached_property
    def steps(self) -> list:
        """The axis on the driver, in time order: a row for each step, however large
        the grid.  Of files that overlap, the first input has a time."""
        times = self.read("times").select("file", F.col("t_idx").cast("int").alias("t_idx"), timeaxis.parse_times(F.col("text")).alias("time")).collect()
        place = {p: n for n, p in enumerate(self.input_paths)}
        first: dict = {}
        for s in sorted((r for r in times if r.time is not None), key=lambda r: (place[self.path_of(r.file)], r.t_idx)):
            first.setdefault(s.time, s)
        return [Row(g_idx=n, time=t, file=first[t].file, t_idx=first[t].t_idx) for n, t in enumerate(sorted(first))]

    @cached_property
    def axis(self) -> DataFrame:
        """The same as rows."""
        kind = dict(self.read("times").dtypes)["file"]
        columns = [pa.array([s[n] for s in self.steps], t) for n, t in enumerate((pa.int32(), pa.timestamp("us"), pa.string() if kind == "string" else pa.int32(), pa.int32()))]
        # From Arrow, its size is known to the optimizer.
        return self.spark.createDataFrame(pa.table(columns, ["g_idx", "time", "file", "t_idx"]), f"g_idx int, time timestamp_ntz, file {kind}, t_idx int")

    def runs(self, own: list) -> list[tuple[tuple, list]]:
        """Of steps: (runs of t_idx that count by one, the files that have just these)."""
        by_file: dict = {}
        for s in own:
            by_file.setdefault(s.file, set()).add(s.t_idx)
        groups: dict[tuple, list] = {}
        for file, at in by_file.items():
            at = sorted(at)
            cuts = [0, *(k for k in range(1, len(at)) if at[k] != at[k - 1] + 1), len(at)]
            groups.setdefault(tuple((at[a], at[z - 1]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)), []).append(file)
        if len(groups) > MOST_SCANS:  # one scan with the bounds of all
            whole = [t for runs in groups for t in runs]
            return [(((min(a for a, _ in whole), max(z for _, z in whole)),), [f for files in groups.values() for f in files])]
        return [*groups.items()]

    def timed(self, table: str, start: str | None = None, end: str | None = None, columns: Iterable[str] | None = None) -> DataFrame:
        """A table with ``time`` in place of file and step; of files that overlap,
        the first has a time.  Files with the same steps of the range are one scan, with
        these steps as literal bounds; others aren't opened."""
        own = self.within(start, end)
        axis = self.axis
        if start is None and end is None:
            rows = self.read(table, None, columns)
        else:
            axis = axis.filter(F.col("g_idx").between(own[0].g_idx, own[-1].g_idx)) if own else axis.filter("false")
            parts = []
            for runs, files in self.runs(own or self.steps[:1]):
                bounds = [F.col("t_idx").between(a, z) for a, z in runs]
                parts.append(self.read(table, files, columns).filter(reduce(or_, bounds)))
            rows = reduce(DataFrame.unionByName, parts)
        return rows.join(broadcast_if_small(axis.select("file", "t_idx", "time")), ["file", "t_idx"]).drop("file", "t_idx")

    def check(self, needed: Iterable[str], start: str | None = None, end: str | None = None) -> None:
        """Raises KeyError where a file of the range lacks one of the variables, and
        TypeError where it has another type there than in the first file, before any
        plan is made.  Footers are read by small jobs side by side."""
        tables = {t: {n: k for n, k in own.items() if n in {*needed}} for t, own in self.tables.items()}
        paths = {self.path_of(s.file) for s in self.within(start, end)} - {self.input_paths[0]}
        asked = [(p, t) for p in sorted(paths) for t, own in tables.items() if own]
        with ThreadPoolExecutor(READERS) as pool:
            found = [*pool.map(lambda x: self.columns(x[1], x[0]) if exists(self.spark, f"{x[0]}/{x[1]}.parquet") else {}, asked)]
        for (path, table), have in zip(asked, found, strict=True):
            for name, kind in tables[table].items():
                if name not in have:
                    raise KeyError(f"{path} has no variable {name!r}")
                if have[name] != kind:
                    raise TypeError(f"{path} has {name!r} as {have[name]}, not as {kind}")

    def within(self, start: str | None, end: str | None) -> list:
        """The steps of a time range, both ends included."""
        lo, hi = (x and timeaxis.parsed(x) for x in (start, end))
        return [s for s in self.steps if (lo is None or s.time >= lo) and (hi is None or s.time <= hi)]

    def before(self, start: str | None) -> str | None:
        """The last step before a time, as text; without one, the time itself."""
        earlier = [s.time for s in self.steps if start is not None and s.time < timeaxis.parsed(start)]
        return str(earlier[-1]) if earlier else start

    # --- metadata, from the first file but for times

    @property
    def first(self) -> list:
        """The value of ``file`` of the first input."""
        return [next(k for k, p in self._paths.items() if p == self.input_paths[0])]

    @cached_property
    def attrs(self) -> dict:
        rows = self.read("attrs", self.first).collect()  # global attributes: some dozens
        return {r["name"]: attribute(r["value"]) for r in rows}

    @cached_property
    def projection(self) -> Projection:
        return self.parse_projection(self.attrs)

    @cached_property
    def axes(self) -> tuple[list[float], list[float]]:
        if self.projection.kind != "latlon":
            return bbox.axes(self.attrs, self.projection)
        geo = self.read("geo", self.first)
        row = [r[0] for r in geo.filter("j = 0").orderBy("i").select("XLONG").collect()]  # one axis each
        column = [r[0] for r in geo.filter("i = 0").orderBy("j").select("XLAT").collect()]
        return bbox.axes(self.attrs, self.projection, row, column)

    @cached_property
    def bbox_geographic(self) -> tuple[float, float, float, float]:
        return bbox.geographic(self.projection, *self.axes)

    @cached_property
    def variables(self) -> dict[str, Variable]:
        """Catalogue entries whose sources the first file has."""
        return available({n for own in self.tables.values() for n in own}, self.catalogue)

    @cached_property
    def rotation(self) -> DataFrame | None:
        """The static rotation of the first file, or None."""
        if not self.has("grid"):
            return None
        grid = self.read("grid", self.first)
        if not {"COSALPHA", "SINALPHA"} <= {*grid.columns}:
            return None
        return grid.select("j", "i", F.col("COSALPHA").cast("double").alias("cosa"), F.col("SINALPHA").cast("double").alias("sina"))
