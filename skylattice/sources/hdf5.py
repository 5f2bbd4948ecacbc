"""HDF5 history files to the tables of ``sources.model``.  Needs h5py, which this
repository's tests don't have: they run this adapter over a stand-in for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SURFACE = 3
COLUMNS = 4
#: Static fields, of which the first step is taken: the winds' rotation, and the
#: axes of grids in degrees.
STATIC = {"grid": ("COSALPHA", "SINALPHA"), "geo": ("XLONG", "XLAT")}
#: Rows of a grid that a task turns into table rows at once.
ROWS_AT_ONCE = 64


def to_tables(spark: SparkSession, paths: list[str], out: str, variables: list[str]) -> None:
    """Writes a folder for each file below ``out``, one task for each file and
    time step, and the static fields that a file has.  Folders are numbered in
    the order of the paths, as two files may share a name."""
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 needs h5py") from e
    for n, path in enumerate(sorted(paths)):
        name = f"{n:06d}-{path.rsplit('/', 1)[-1]}"
        with h5py.File(path, "r") as h5:
            steps = h5["Times"].shape[0]
            attrs = [(k, str(v.item() if hasattr(v, "item") and getattr(v, "size", 1) == 1 else v)) for k, v in h5.attrs.items()]
            times = [(i, b"".join(h5["Times"][i].tolist()).decode()) for i in range(steps)]
            kinds = {v: len(h5[v].shape) for v in variables if v in h5}
            static = {t: own for t, own in STATIC.items() if all(v in h5 for v in own)}
        spark.createDataFrame(attrs, "name string, value string").write.parquet(f"{out}/{name}/attrs.parquet")
        spark.createDataFrame(times, "t_idx int, text string").write.parquet(f"{out}/{name}/times.parquet")
        for table, own in static.items():
            _slabs(spark, path, 1, [*own], "float").drop("t_idx").write.parquet(f"{out}/{name}/{table}.parquet")
        flat = [v for v, n in kinds.items() if n == SURFACE]
        _slabs(spark, path, steps, flat, "float").write.parquet(f"{out}/{name}/surface.parquet")
        for table, j, i, own in (("columns3d", "j", "i", [v for v, n in kinds.items() if n == COLUMNS and v not in "UV"]), ("u_stag", "j", "i_stag", ["U"]), ("v_stag", "j_stag", "i", ["V"])):
            own = [v for v in own if v in kinds]
            if own:
                _slabs(spark, path, steps, own, "array<float>", j, i).write.parquet(f"{out}/{name}/{table}.parquet")


def _slabs(spark: SparkSession, path: str, steps: int, variables: list[str], kind: str, j: str = "j", i: str = "i") -> DataFrame:
    schema = f"t_idx int, {j} int, {i} int, " + ", ".join(f"{v} {kind}" for v in variables)

    def read(batches):
        import h5py
        import numpy as np
        import pyarrow as pa

        with h5py.File(path, "r") as h5:
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    ny, nx = h5[variables[0]].shape[-2:]
                    for at in range(0, ny, ROWS_AT_ONCE):  # so many rows of all variables are in memory
                        data = [np.asarray(h5[v][t, ..., at : at + ROWS_AT_ONCE, :]) for v in variables]
                        own = np.arange(at, min(ny, at + ROWS_AT_ONCE), dtype=np.int32)
                        cells = [np.repeat(own, nx), np.tile(np.arange(nx, dtype=np.int32), len(own))]
                        values = [pa.array(d.reshape(-1)) if d.ndim == 2 else pa.array(list(d.reshape(d.shape[0], -1).T), pa.list_(pa.float32())) for d in data]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells[0]), t, np.int32)), *map(pa.array, cells), *values], ["t_idx", j, i, *variables])

    return spark.range(steps, numPartitions=max(1, steps)).mapInArrow(read, schema)
